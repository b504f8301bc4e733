"""Training-data operators: packing, secrets, pseudonyms, URL and quality filters, tokens, de-duplication, search, shards.

Nothing else in the library imports this subpackage.
"""
