import pytest

from textloom.llm import queries as q

COLUMNS = {
    "p1_found": {"seq_a": "bigint", "seq_b": "bigint"}, "p2_found": {"probe_id": "bigint", "term": "string"}, "p3_found": {"term": "string", "mark": "string"},
    "p4_found": {"seq_a": "bigint", "seq_b": "bigint"}, "p5_found": {"seq": "bigint", "para": "bigint", "lang": "string"},
    "p9_found": {"doc_id": "bigint", "kind": "string", "start_char": "bigint", "end_char": "bigint"},
}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(name, q.queries(), q.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, name):
    df = q.queries()[name](spark, "/root/testdata/sf0.001")
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert df.count() == df.distinct().count()
    else:
        df.count()
