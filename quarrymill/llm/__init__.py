"""Operators for preparing large training corpora, each a plain DataFrame function."""
