"""Statistic, permutation, inference, enhancement, similarity and spatial operators."""
