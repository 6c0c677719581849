"""Kernel functions, in vectorised Python and as column expressions."""
