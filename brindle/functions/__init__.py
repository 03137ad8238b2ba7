"""Column builders and Arrow kernels."""
