"""Imports every plan module, which fills the registry."""

from pulsewake.plans import (  # noqa: F401
    graphs,
    histories,
    scores,
    series,
    storage,
    tables,
    texts,
)
from pulsewake.plans.registry import ORACLES, QUERIES  # noqa: F401
