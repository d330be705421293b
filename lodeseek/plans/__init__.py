"""plans of the secret-discovery engine."""
