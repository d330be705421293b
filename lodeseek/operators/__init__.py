"""operators of the secret-discovery engine."""
