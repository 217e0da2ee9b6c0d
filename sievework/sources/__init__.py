"""Readers, writers and ingest jobs."""
