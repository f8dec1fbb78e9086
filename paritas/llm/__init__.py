"""Operators on the text of documents for language-model data. Nothing else in the library imports this."""
