"""Scalar formulas and tile kernels."""
