"""Predicates and assignment values of columns, aggregates and calls by name."""
from .calls import Call, any_value, avg, count, distinct, first, func, last, max_, min_, sum_  # noqa: F401
from .predicates import *  # noqa: F403
