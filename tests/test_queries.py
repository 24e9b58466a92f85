"""Every query that has SQL gives what DuckDB gives for it."""

import difflib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quern.operators import metrics
from quern.plans import metrics as metric_plans
from quern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else repr(float(v))

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    mine, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 3


def test_change_ratio(spark):
    """Every pair of the query against a plain loop."""
    got = {(r.doc_id, r.place): r.changed for r in registry.QUERIES["token_change_ratio"](spark, SF).collect()}
    pairs = metric_plans.answer_pairs(spark, SF).collect()
    assert len(got) == len(pairs)
    for r in pairs:
        assert got[r.doc_id, r.place] == round(1 - difflib.SequenceMatcher(None, r.reference.split(), r.hypothesis.split()).ratio(), 6)


@pytest.mark.parametrize(
    ("a", "b", "changed"),
    [("a b c", "a b c", 0.0), ("a b c", "a b", 0.2), ("a b", "c d", 1.0), ("", "", 0.0), ("", "a", 1.0), ("a b c d", "c d a b", 0.5), ("x " * 199, "x " * 199, 0.0), ("x " * 250, "x " * 214, 36 / 464), ("y " + "x " * 250, "z " + "x " * 214, 1.0), (None, "a", None)],
)
def test_change_ratio_of_pairs(spark, a, b, changed):
    """From 200 tokens on, a token that fills over a hundredth of them is no anchor."""
    pair = spark.createDataFrame([(a, b)], "a string, b string")
    assert pair.select(metrics.change_ratio("a", "b").alias("c")).first().c == (None if changed is None else pytest.approx(changed))


def test_determinism_check_compares_every_user(spark):
    """1,500 users a mode, more than any small table has."""
    sf = "/root/testdata/sf0.1"
    sql = f"WITH m AS (SELECT user_id AS id, event_type AS mode, max(floor(value / 40)) AS hyp FROM '{sf}/events.parquet' GROUP BY 1, 2), b AS (SELECT id, hyp FROM m WHERE mode = 'view') SELECT mode, count(*) AS compared, count(*) FILTER (WHERE m.hyp <> b.hyp) AS different, coalesce(array_to_string(list_slice(list(m.id ORDER BY m.id) FILTER (WHERE m.hyp <> b.hyp), 1, 20), ';'), '') AS first_ids FROM m JOIN b USING (id) WHERE mode <> 'view' GROUP BY mode"
    mine, theirs = registry.QUERIES["determinism_check"](spark, sf).toPandas(), duckdb.sql(sql).df()
    assert min(mine["compared"]) > 500
    assert plain(mine) == plain(theirs)
