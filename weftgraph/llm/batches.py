"""The size of the batches in which rows reach Python."""

from __future__ import annotations

from weftgraph.batches import BATCH_BYTES, bounded

__all__ = ["BATCH_BYTES", "bounded"]
