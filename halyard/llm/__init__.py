"""Corpus preparation operators: search, deduplication, tokens, pages, filters, shards and packing."""
