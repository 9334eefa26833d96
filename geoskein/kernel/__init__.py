"""Numpy kernels for one polygon at a time; nothing here imports Spark."""
