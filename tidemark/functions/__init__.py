"""Scalar expressions and accessors."""
