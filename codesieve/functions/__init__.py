"""Part of the code-quality engine."""
