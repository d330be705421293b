"""sources of the secret-discovery engine."""
