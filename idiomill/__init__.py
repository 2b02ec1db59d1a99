"""A PySpark engine that builds and mines a bilingual lexicon of figurative expressions."""
