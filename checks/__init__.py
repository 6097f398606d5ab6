from checks import alerting, baselining, drifting, modelling, quality, sourcing  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
