"""All queries of the core package with their SQL equivalents."""

from framewright.plans import capture, evaluate  # noqa: F401  (they register themselves)
from framewright.plans.base import ORACLES, QUERIES  # noqa: F401
