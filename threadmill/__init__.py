"""threadmill: conversation search and corpus processing as Spark plans."""

from threadmill.config import Settings

__all__ = ["Settings"]
