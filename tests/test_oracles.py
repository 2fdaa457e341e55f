"""Every query with equivalent SQL, on the smallest tables, in both engines."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from cubitgrid import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values, order):
    at = [names.index(c) for c in order]
    return Counter(tuple(float(r[i]) if isinstance(r[i], Decimal) else r[i] for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, engine, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    other = engine.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in other.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert rows(df.columns, got, order) == rows(names, other.fetchall(), order)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_a_library_of_the_corpus_operators():
    """Whatever keeps the subpackage from being imported, the other queries stay."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules.update(ahocorasick=None, xxhash=None); import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert "city_summary" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
