"""Connected components, as the core has them."""

from tessella.operators.components import components  # noqa: F401
