"""Model formulas, and how a model is to be estimated."""
