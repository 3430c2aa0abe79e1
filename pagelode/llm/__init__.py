"""Training-data operators: dedup, tokenisation, extraction, filtering, archiving, sharding.

Nothing else in the library imports this subpackage.
"""
