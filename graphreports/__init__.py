"""Monitoring reports over linked data, as set-based Spark jobs."""

from graphreports.runtime import configure

__all__ = ["configure"]
