"""Driver-side planning: transformation language, intermediate form, table order."""
