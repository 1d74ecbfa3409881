"""Every named query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import normal

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot express, with the test that holds their operator against brute force or a round trip.
WITHOUT_SQL = {
    "random_nuc": ("test_functions.py", "random_sequence"), "maf_calls": ("test_column_walk.py", "by_columns"), "maf_fill_haplotypes": ("test_functions.py", "fill_haplotypes"),
    "mutate_point": ("test_further_operators.py", "mutations.mutate"), "mutate_delete": ("test_further_operators.py", "mutations.mutate"), "mutate_insert": ("test_further_operators.py", "mutations.mutate"),
    "p5_found": ("test_packed.py", "test_round_trip_of_quoted_values"), "p5_places": ("test_packed.py", "test_places_are_those_of_the_values"), "p1_bisected": ("llm/test_bisected.py", "bisect_pieces"),
    "p8_ids": ("llm/test_tokens.py", "encode"), "p9_found": ("llm/test_leaks.py", "brute"), "p9_passages": ("llm/test_leaks.py", "brute"), "p9_proximity": ("llm/test_leaks.py", "brute_near"), "p10_found": ("llm/test_sentences.py", "CASES"),
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        file, word = WITHOUT_SQL[name]
        assert word in (Path(__file__).parent / file).read_text()
        return
    a, b = normal(got), normal(con.execute(sql).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert all((a[c].isna() & b[c].isna() | (a[c] == b[c])).all() for c in a.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
