"""Ledger replication, integrity and state-commitment operators for PySpark."""
