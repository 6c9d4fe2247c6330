"""Operators over operation logs."""
