"""Scalar functions of queries: names to builders of column expressions."""

from . import collections, conversion, dates, mathematics, network, strings  # noqa: F401
from .registry import FUNCTIONS, register, user_function

__all__ = ["FUNCTIONS", "register", "user_function"]
