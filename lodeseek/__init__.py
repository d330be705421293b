"""lodeseek: leaked-credential discovery and training-data preparation on Spark."""
