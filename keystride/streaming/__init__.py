"""Structured Streaming jobs: counter maintenance, decayed scores, entry expiry."""
