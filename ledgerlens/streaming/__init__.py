"""Structured Streaming jobs (the reference runs once per arriving export; we run continuously)."""
