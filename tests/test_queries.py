"""Registered queries against their SQL, on the smallest of the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from refloom.plans import served, wider
from refloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = Path("/root/testdata/sf0.001")
CHECKED = ["page_text", "entry_fields", "sorted_entries", "cited_not_listed", "doi_cascade", "usage_by_period", "cost_log", "latest_state", "ris_records", "user_sessions", "finished_lists"] + [n for n, f in QUERIES.items() if f.__module__ in (wider.__name__, served.__name__) and n in ORACLE_SQL]


def rows(records):
    def plain(v):
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 4)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(r[k]) for k in sorted(r)) for r in records)


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    found = [r.asDict() for r in QUERIES[name](spark, str(TABLES)).collect()]
    assert rows(found) == rows(expected)


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_without_the_text_operators(monkeypatch):
    """The rest works when the optional folders are gone."""
    import importlib
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("refloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
