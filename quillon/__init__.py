"""Interpretable classification over large tables, as DataFrame plans."""
