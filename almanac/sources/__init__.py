"""Readers of listing feeds and pages: text in, one row per listing out."""
