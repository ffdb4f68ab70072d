"""Column functions: no Python is run per row in any of them."""

from . import calendar, numeric, text, timeaxis

__all__ = ["calendar", "numeric", "text", "timeaxis"]
