"""Training-data operators: deduplication, filtering, scanning, mixing, packing.

Nothing else in the library imports this subpackage.
"""
