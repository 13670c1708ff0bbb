"""Structured Streaming: resumable ingestion and keyed state machines."""
