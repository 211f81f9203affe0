"""Plans of the text-vector engine."""
