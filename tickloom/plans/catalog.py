"""All registered market queries: importing this module loads every module that registers some."""

from __future__ import annotations

from . import queries_attribution, queries_core, queries_events, queries_models, queries_more, queries_rules  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
