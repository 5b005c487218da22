"""Governed-ledger analytics as Spark jobs: reconciliation, data quality, exceptions, enrollment and audit."""

__version__ = "0.1.0"
