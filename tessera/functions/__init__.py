"""Column functions and string kernels."""
