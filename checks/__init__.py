"""The registered queries and the SQL they are compared with."""

from checks.registry import ORACLES, QUERIES  # noqa: F401
from checks import ideas, votes, users, decisions, quality, streams, models  # noqa: F401, E402
