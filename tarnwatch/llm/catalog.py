"""All text operators' queries and SQL; importing this module registers them."""

from . import (  # noqa: F401
    arc_warc, brown_lm, decontaminate, filter_audit, hard_negatives, language_models, mixing, multiset_print, ordinal_quality, recompress, reshard,
    set_join, topk_search)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
