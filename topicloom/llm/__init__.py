"""Training-data operators: extraction, deduplication, filtering, mixing, packing.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
