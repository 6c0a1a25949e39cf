"""Readers and writers: accounting dumps, queue snapshots, node inventories,
group mappings and the date-partitioned Parquet store."""
