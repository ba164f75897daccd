"""Every registered query runs on the small tables and agrees with its SQL."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.parity import DATA, compare

ALL = entry.queries()
SQL = entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).columns == ["heading", "rank", "entity_id", "entity_type", "salience"]
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", [n for n in ALL if not re.match(r"p\d_", n)] + ["p2_found", "p6_found"])
def test_agrees_with_sql(spark, name):
    said = compare(spark, name, ALL[name], SQL.get(name), f"{DATA}/sf0.001")
    assert said.startswith(("ok", "rows")), said
