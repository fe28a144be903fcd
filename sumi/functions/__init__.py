"""Scalar functions as columns; `register` makes them SQL functions."""

from .text import register  # noqa: F401
