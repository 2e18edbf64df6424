"""Catalog, CSV loading and immutable parquet versions."""
