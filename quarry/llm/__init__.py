"""Training-data operators: dedup, language, quality, extraction, tokens, mixing.

Nothing else in the library imports this subpackage.
"""
