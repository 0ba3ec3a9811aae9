"""Axiomata: indexing and search of mathematical formulas, as Spark plans."""

__version__ = "0.2"
