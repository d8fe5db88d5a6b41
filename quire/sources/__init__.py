"""Readers of cached pages, EPUB archives, PDF blocks and test tables."""
