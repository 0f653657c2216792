"""Numerical kernels on p x p matrices: numpy alone, no Spark."""
