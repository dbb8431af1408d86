"""DataFrame operators on typed decisions."""
