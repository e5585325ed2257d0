"""Training-data operators: dedup, mixing, filtering, search, sharding and packing.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
