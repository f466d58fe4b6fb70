"""Training-data operators: text scans, tokenising, deduplication, packing, sharding and archiving.

Nothing else in the library imports this subpackage.
"""
