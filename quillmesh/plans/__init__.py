"""Queries and whole runs composed from the operators."""
