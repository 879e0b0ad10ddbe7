"""Corpus-preparation operators: one module for each operator, one query module under queries/."""
