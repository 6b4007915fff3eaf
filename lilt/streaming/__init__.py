"""Structured Streaming jobs: live words, session finalisation, progress."""
