from . import files, quality, series, sqlforms  # noqa: F401  (each module adds its queries)
from .registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
