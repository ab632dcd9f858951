"""Operators: each is ``DataFrame -> DataFrame`` built from Spark built-ins."""
