"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame; every computed
column is aliased to the same name as in the oracle SQL.  Doubles are
rounded to 6 decimals on both sides (sums in different orders differ in the
last bits).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def load_all():
    # importing the plan modules fills REGISTRY
    from convgraph.plans import (q_relations, q_text, q_labels, q_graph,  # noqa: F401
                                 q_stats, q_eval, q_runs, q_models, q_sources, q_lexicons)
    return REGISTRY
