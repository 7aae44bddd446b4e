"""The driver's entry points."""

from __future__ import annotations

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
