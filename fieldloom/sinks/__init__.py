"""Writing snapshots and documents: deterministic, whatever the order and partitioning of the rows."""
