"""Every query that SQL can express gives the rows of its SQL."""

import collections
from pathlib import Path

import duckdb
import pytest

from planewise import catalogue


@pytest.fixture(scope="module")
def tables(sf_dir):
    with duckdb.connect() as db:
        for p in Path(sf_dir).glob("*.parquet"):
            db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        yield db


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, sf_dir, tables, name):
    df = catalogue.queries()[name](spark, sf_dir)
    found = tables.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(str, map(tuple, df.collect()))) == collections.Counter(map(str, found))


def test_what_has_no_sql():
    """Iterations whose path, not only their end, would have to be the same, and a search that may miss (its recall has SQL)."""
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"baseline_classifier", "guided_view_frames", "guided_view_integrity", "knn_approximate"}
