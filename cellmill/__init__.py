"""Spark operators for sparse count data, annotations, variants and signatures."""
