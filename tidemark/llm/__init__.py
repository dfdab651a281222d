"""Operators for preparing training data at scale: deduplication, quality, mixing, sharding, tokens and language-model scores."""
