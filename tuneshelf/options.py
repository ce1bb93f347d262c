"""Job settings passed explicitly to every job (no module-level state)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .functions import fixed


@dataclass(frozen=True)
class Settings:
    top_k: int = field(default_factory=lambda: int(os.getenv("TOP_K", str(fixed.TOP_K))))
    batch_top_k: int = fixed.BATCH_TOP_K
    overfetch: int = fixed.SEMANTIC_OVERFETCH
    vocab_size: int = fixed.VOCAB_SIZE
    w_cosine: float = fixed.WEIGHT_COSINE
    w_popularity: float = fixed.WEIGHT_POPULARITY
    embed_dim: int = 64
    null_text: str = fixed.MISSING_CELL
    # size bounds for broadcasting a data-dependent side (rows, checked at plan time)
    broadcast_max_rows: int = 2_000_000
    # and bytes: the driver holds a table several times over while it builds it
    broadcast_max_bytes: int = 32 << 20
    # dense top-k blocking: questions and documents per cogroup cell
    question_block: int = 4096
    document_block: int = 32768
    # pivots of the exact dense top-k beyond one document block, and the rows they are fitted on
    pivots: int = 64
    pivot_sample: int = 4096
    # product codes: documents of a cell
    code_block: int = 131_072
    # term blocks: documents of a block, questions of a cell
    term_block: int = 16_384
    question_part: int = 4096
    bound_cells: int = 20_000
    # write per-document term counts once (read by vocabulary and postings)
    checkpoint_counts: bool = True


DEFAULT = Settings()
