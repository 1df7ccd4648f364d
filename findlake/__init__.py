"""Code-review findings analytics as Spark jobs."""

from findlake.session import configure, materialize

__all__ = ["configure", "materialize"]
