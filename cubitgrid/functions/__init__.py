"""Column expressions and geometry kernels."""
