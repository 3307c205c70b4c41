"""Training-data operators: language, quality, toxicity, deduplication, tokens.

Nothing outside this subpackage imports it.
"""
