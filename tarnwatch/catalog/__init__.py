"""Registered queries, one or more per operator, each with SQL that must give the same rows where SQL can say it."""

from . import (  # noqa: F401  (importing a module registers its queries)
    intake,
    grading,
    windows,
    detection,
    airquality,
    lakes,
    forecasting,
    evaluation,
    reporting,
    fitted,
    roundtrips,
)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
