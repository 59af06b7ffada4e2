"""Functions on texts and numbers."""
