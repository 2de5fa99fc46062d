"""Kernel and Gaussian-process regression on Spark DataFrames, and operators for large text corpora (subpackage llm)."""
