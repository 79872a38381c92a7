"""Compositions of operators: trial lists and the feature-to-score flow."""
