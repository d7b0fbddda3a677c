"""Fits along a path of penalties, their saved states, and the command line."""
