"""Differentially private marginals and synthetic tables on Spark."""
