"""Batch-scheduler accounting analytics as Spark DataFrame jobs.

Layers, lowest first:

``functions``  column expressions (parsing, arithmetic, display)
``operators``  DataFrame -> DataFrame steps (per-job roll-up, daily metrics, rule statistics, log records)
``sources``    readers and writers
``plans``      the user-facing reports, each one a single DataFrame graph
``streaming``  incremental ingest of daily dumps
"""
