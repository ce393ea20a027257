"""Operators for preparing large text corpora. Nothing else in heaplens imports this subpackage."""
