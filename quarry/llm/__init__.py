"""Operators that prepare code and text for language-model training."""
