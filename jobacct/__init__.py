"""jobacct: batch-job accounting analytics as Spark DataFrame jobs.

Layers
------
functions/  Column expressions (text parsers, node-list expansion, job metrics)
sources/    readers and writers (accounting dumps, queue snapshots, node
            inventories, the date-partitioned Parquet store)
operators/  DataFrame -> DataFrame jobs (normalise, dedupe, incremental
            filter, reports, node usage, queue usage, pseudonymisation)
plans/      what a user runs end to end (collect, analyze, current, nodes)
streaming/  the collect plan as a Structured Streaming query
checks/     derivation of accounting dumps from the shared test tables and
            the DuckDB oracle SQL used by the correctness gate
"""

__version__ = "0.1.0"
