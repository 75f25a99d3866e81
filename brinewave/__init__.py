"""Spark jobs that turn station recordings and annotations into scored detections."""

from brinewave.session import configure, get_session

__all__ = ["configure", "get_session"]
