"""Corpus, run-log and ledger analytics as Spark DataFrame jobs."""
