"""Sources."""

from threadmill.sources.transcripts import Tail, register  # noqa: F401
