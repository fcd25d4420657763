"""Plan helpers: joins that stand hot keys, dense ids, lineage cuts, and the two table flows."""
