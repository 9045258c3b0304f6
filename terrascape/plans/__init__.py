"""Stages, their order, and the facade that runs them."""
