"""Incremental ingestion of files, and sessions whose histories are compressed as they grow."""
