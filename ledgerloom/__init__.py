"""Ledgerloom: billing documents to a checked ledger, as Spark DataFrame jobs."""
