"""Operators over text corpora; nothing else in the package imports them."""
