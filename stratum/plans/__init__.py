"""Statements, symbolic handles and sessions."""
