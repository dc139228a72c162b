"""Training-data operators: language ID, sharding, mixing, token counts, quality,
audio fingerprints, token stores, packing, near-duplicates and vector search.

Nothing outside this subpackage (but for the guarded import in the driver entry
module and the corpus pipeline) depends on it.
"""
