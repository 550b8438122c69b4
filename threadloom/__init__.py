"""Threadloom: conversation analytics as Spark DataFrames and streams."""

from threadloom.session import session

__all__ = ["session"]
