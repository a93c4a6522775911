"""Column expressions and small dense numeric kernels."""
