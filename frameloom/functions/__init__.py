"""Column functions: each takes and returns Columns, so Catalyst sees plain expressions."""

from .colour import *  # noqa: F403
from .depth import *  # noqa: F403
from .geometry import *  # noqa: F403
from .scalar import *  # noqa: F403
