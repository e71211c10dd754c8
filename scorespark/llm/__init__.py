"""Operators for language-model training corpora. Nothing else in the package imports this folder."""
