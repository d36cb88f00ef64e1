import pytest

import __spark_entry__ as entry
from textloom import queries as core

NAMES = sorted(core.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in core.oracle_sql()])
def test_same_as_sql(same_as_sql, name):
    same_as_sql(name, core.queries(), core.oracle_sql())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in core.oracle_sql()])
def test_runs(spark, name):
    assert core.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_highlights_of_all_hits(spark):
    folder = "/root/testdata/sf0.01"
    hits = {r["id"] for r in core._hits(spark, folder, core.MatchQuery("content", "stale snapshot")).collect()}
    got = core.queries()["highlight_basic"](spark, folder).collect()
    assert len(hits) > 10 and {r["id"] for r in got} == hits
    assert core.queries()["highlight_page"](spark, folder).select("id").distinct().count() == 10


def test_contract(spark):
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "score"]
