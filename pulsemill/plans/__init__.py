"""Whole workflows as chains of operators."""
