"""All registered queries."""

from palisade.plans import feeds, learning, reads, streams, workflow  # noqa: F401
from palisade.plans.registry import CATALOG  # noqa: F401
