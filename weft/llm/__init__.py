"""Operators of a training-data pipeline: media, text, embeddings and mixing.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
