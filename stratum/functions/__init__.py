"""Scalar and aggregate functions as Catalyst expressions."""
