"""Relational building blocks the datasets and jobs are composed of."""
