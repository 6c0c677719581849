"""Nonparametric kernel smoothing of mixed data types on Spark."""
