"""Portfolio queries composed from the operators."""
