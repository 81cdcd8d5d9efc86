"""Alignment-free sequence analytics on Spark: k-mer matching, repeat structure, containment and interval mapping."""

__version__ = "0.1.0"
