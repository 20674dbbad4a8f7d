"""tessella: a Spark-first analytics library (DataFrame, SQL, streaming and data-source building blocks)."""

from tessella.session import build_session, load

__all__ = ["build_session", "load"]
