"""Plan-level helpers: size checks, skew-safe ordered columns, exact quantiles, fixpoints."""

from .durable import pin
from .ordered import ordered_columns
from .quantiles import group_quantiles
from .sizing import group_limit, group_sizes, large_groups

__all__ = ["pin", "ordered_columns", "group_quantiles", "group_limit", "group_sizes", "large_groups"]
