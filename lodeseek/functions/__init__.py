"""functions of the secret-discovery engine."""
