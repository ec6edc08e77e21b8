"""Training-data operators: text classification, search, deduplication, scanning and tokenization.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
