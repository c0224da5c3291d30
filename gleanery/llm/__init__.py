"""Operators for preparing text corpora: quality, de-duplication, mixing, tokens, shards, archives."""
