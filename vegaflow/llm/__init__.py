"""Training-data operators: packing, decontamination, deduplication, filters and scorers.

Nothing else in the library imports this subpackage.
"""
