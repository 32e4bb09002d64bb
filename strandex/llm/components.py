"""Connected components, as the graph operators have them."""

from ..operators.components import components

__all__ = ["components"]
