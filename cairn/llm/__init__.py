"""Operators for preparing training corpora: search, sharding, language, dedup, tokens, mixing, quality."""
