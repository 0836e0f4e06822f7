"""Import every catalogue module so that all queries are registered."""

from chainlens.plans import catalog  # noqa: F401
from chainlens.plans import catalog2  # noqa: F401
from chainlens.plans import catalog3, catalog4  # noqa: F401
