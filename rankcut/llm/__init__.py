"""Training-data operators: packing, filtering, near-duplicates, search, counting, scoring, record files.

Nothing outside this subpackage imports it.
"""
