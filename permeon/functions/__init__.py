"""Scalar functions: NumPy kernels and column expressions."""
