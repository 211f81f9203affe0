"""Functions of the text-vector engine."""
