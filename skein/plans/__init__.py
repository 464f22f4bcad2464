"""How a query runs: keys and lineage, choice of strategy, partitioning, batches."""
