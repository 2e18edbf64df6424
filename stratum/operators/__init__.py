"""Operators over symbolic handles, batches of them, and data changes."""
