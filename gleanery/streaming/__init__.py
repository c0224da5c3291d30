"""Structured Streaming jobs. Functions without state run on batch frames too."""
