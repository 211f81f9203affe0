"""vectorloom: text-vector and co-occurrence analytics written as Spark DataFrame jobs."""

from vectorloom.runtime import local_session

__all__ = ["local_session"]
