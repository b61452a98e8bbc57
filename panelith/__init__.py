"""Counterfactual means on short panels, and data-quality operators, on Spark."""
