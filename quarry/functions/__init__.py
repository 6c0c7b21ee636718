"""Scalar functions and text rules shared by sources and operators."""
