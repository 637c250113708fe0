"""Operators for training corpora: near and exact duplicates, language, toxicity, archives, mixing, shards, tokens."""
