"""Whole pipelines and reports built from the functions, sources and operators."""
