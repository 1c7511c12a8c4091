"""Operators of a training-data pipeline: near duplicates, substrings, quality, search, mixing,
tokenization, extraction and sharding. Nothing outside this subpackage imports it."""
