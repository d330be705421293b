"""streaming of the secret-discovery engine."""
