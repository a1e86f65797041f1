"""Operators for large-scale training-data pipelines (independent of the ledger engine)."""
