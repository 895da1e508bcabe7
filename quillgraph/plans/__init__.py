"""Compositions of operators: retrieval, ingestion, evaluation, the facade and the query list."""
