"""Scalar functions: text normalisation, digits, URLs, paths, similarity."""
