"""Connected components, as the library has them."""

from ..functions.graphs import connected_components

__all__ = ["connected_components"]
