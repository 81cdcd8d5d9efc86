"""Operators for preparing text corpora: one module for each, and `registry` with their queries."""
