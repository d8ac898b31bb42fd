"""Canonicalisation over streams."""
