"""Operators over coordinate tables: encoding, screening, pruning, duplicates, solving, reports."""
