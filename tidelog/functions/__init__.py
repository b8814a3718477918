"""Scalar functions on keys, ids and statuses, as Column expressions."""
