"""Batch jobs: the state-changing rules applied to tables of requests.

A job returns a ``JobResult``: every request with its decision, the rows to append
and the new state of updated tables. Nothing is written; ``wardline.jobs.result``
has ``store`` for that.
"""
