"""Training-data operators: fingerprints, near-duplicates, packing, mixing and the like.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
