"""Training-data operators: language-model scoring, deduplication, decontamination, packing.

Nothing else in the library imports this subpackage.
"""
