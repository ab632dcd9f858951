"""Composed jobs (dashboard, completion path, retraining, verification) and the
query catalogue shared by ``__spark_entry__`` and ``bench.py``."""
