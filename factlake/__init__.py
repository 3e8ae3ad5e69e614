"""Bi-temporal fact ledger and hybrid retrieval as Spark DataFrame operators."""
