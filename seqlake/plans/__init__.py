"""Queries made of operators, and their SQL twins."""
