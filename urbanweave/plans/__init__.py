"""Ready-made jobs built from the operators."""
