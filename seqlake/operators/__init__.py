"""Relational operators over reads, k-mers, graphs and contigs."""
