"""Training-data operators: packing, de-duplication, scoring and decontamination.

Nothing else in the library imports this subpackage.
"""
