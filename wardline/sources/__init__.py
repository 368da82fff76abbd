"""Table declarations, loaders, seeds and sinks."""
