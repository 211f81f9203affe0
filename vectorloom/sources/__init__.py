"""Sources of the text-vector engine."""
