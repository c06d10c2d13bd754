"""Settings shared by the operators."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    rrf_k: int = 60
    recency_weight: float = 0.3
    overfetch: int = 3
    max_turn_chars: int = 8000
    min_turn_chars: int = 20
    document_chars: int = 65535
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    expire_days: int = 365
    expire_every_seconds: int = 86400
    trigger_seconds: float = 2.0
    #: Bytes of one transcript that a task orders at once; longer transcripts are scanned block by block.
    block_bytes: int = 64 << 20
    skipped_types: tuple = field(default=("file-history-snapshot", "progress", "system", "queue-operation"))
