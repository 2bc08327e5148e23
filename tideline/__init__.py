"""Sharded, append-only record streams on Spark: records, pages, handlers, checkpoints, lineage, leases, metrics."""
