"""The pattern language: text to syntax tree to DataFrame."""
