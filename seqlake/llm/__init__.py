"""Operators for building training corpora: deduplication, scans, tokenisation, media and archives."""
