"""DataFrame operators on instance tables."""
