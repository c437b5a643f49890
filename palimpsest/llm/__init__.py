"""Operators for building training-data corpora. Nothing outside this subpackage imports it."""
