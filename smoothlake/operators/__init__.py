"""Estimators, searches and tests on kernel sums."""
