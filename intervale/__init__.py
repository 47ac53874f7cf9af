"""Spark-first analytics for genomic intervals."""
