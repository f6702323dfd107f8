"""Column rules and the small step functions that folds share."""
