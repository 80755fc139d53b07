"""Larger plans: full-text search, boxes, change sets."""
