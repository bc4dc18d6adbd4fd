"""Structured Streaming: resumable ingest of post files (T1/S12) and maintained tag counts."""
