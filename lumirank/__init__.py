"""Image and text embedding, vector search and run analysis as Spark jobs."""

from lumirank.session import build_session, prepare

__all__ = ["build_session", "prepare"]
