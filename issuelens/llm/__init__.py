"""Operators for preparing large training corpora, one module per operator."""
