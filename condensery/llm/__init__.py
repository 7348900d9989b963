"""Operators for preparing language-model training corpora; see the README for their contracts."""
