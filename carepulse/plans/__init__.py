"""Analyses (one function per key) and their SQL oracles."""
