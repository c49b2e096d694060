"""Spark jobs that reconcile payment requests with invoices, and tools for text corpora."""
