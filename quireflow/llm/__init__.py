"""Training-data operators: recognition, extraction, selection, deduplication, mixing, packing and archives.

Nothing outside this subpackage imports it.
"""
