"""Numeric kernels in numpy."""
