"""Scalar functions and small kernels."""
