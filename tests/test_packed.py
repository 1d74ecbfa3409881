import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genomespark.operators.packed import explode_packed, parse_alleles, parse_attributes
from tests.helpers import rows

CASES = [
    ("ID=a;Parent=b,c", [("ID", "a"), ("Parent", "b"), ("Parent", "c")]),
    (' ID = "a" ; rank = 3;;', [("ID", "a"), ("rank", "3")]),
    ('ID "a"; Parent "b"; Parent "c"; rank 3', [("ID", "a"), ("Parent", "b"), ("Parent", "c"), ("rank", "3")]),
    ('Note "alias=old name"; x "a;b"', [("Note", "alias=old name"), ("x", "a;b")]),
    ('ID=a|Note="left|right",plain words', [("ID", "a"), ("Note", "left|right"), ("Note", "plain words")]),
    ('ID=a&Note="binds ""zinc"" ions","x, y"', [("ID", "a"), ("Note", 'binds "zinc" ions'), ("Note", "x, y")]),
    ("Alias=al%2C5,,x", [("Alias", "al%2C5"), ("Alias", "x")]),
    ("Note=a=b", [("Note", "a=b")]),
    (None, []), ("", []), (" . ", []), (";;", []), ("ID=", []),
]


@pytest.mark.parametrize("field, want", CASES)
def test_attributes(field, want):
    assert [(t, v) for t, v, *_ in parse_attributes(field)] == want


@pytest.mark.parametrize(
    "field, want",
    [("A,T", "A T"), ("[A | <INS:ME>]", "A <INS:ME>"), ('"<INS:ME,L2>"/G', "<INS:ME,L2> G"), ('"A" "C";T', "A C T"), ("A,,T,", "A T"), ("G GT", "G GT"), (".", ""), (None, ""), ('"",A', "A"), ("<DEL>|C", "<DEL> C")],
)
def test_alleles(field, want):
    assert " ".join(v for _, v, *_ in parse_alleles(field)) == want


def test_malformed_quotes_are_flagged():
    assert parse_attributes('ID=a;Note="x;N=y') == [("ID", "a", False, 3, 4), ("Note", '"x', True, 10, 12), ("N", "y", False, 15, 16)]
    assert parse_alleles('A,"C') == (("", "A", False, 0, 1), ("", '"C', True, 2, 4))


value = st.text(st.sampled_from('ab "=;|&,.'), min_size=1, max_size=6).map(str.strip).filter(lambda v: v and not set(v) <= {'"'})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ID", "Note", "x"]), st.lists(value, min_size=1, max_size=3)), min_size=1, max_size=4), st.sampled_from([";", "; ", "|", "&", ";;"]))
def test_round_trip_of_quoted_values(items, sep):
    field = sep.join(t + "=" + ",".join('"' + v.replace('"', '""') + '"' for v in vs) for t, vs in items)
    found = parse_attributes(field)
    assert [f[:3] for f in found] == [(t, v, False) for t, vs in items for v in vs]
    assert [field[a:b] for *_, a, b in found] == ['"' + v.replace('"', '""') + '"' for _, vs in items for v in vs]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('ab "=;|&,.[]<>\t'), max_size=20))
def test_places_are_those_of_the_values(field):
    for parse in (parse_attributes, parse_alleles):
        found = parse(field)
        assert all(field[a:b] == v or field[a:b].strip('"').replace('""', '"').strip() == v.strip('"') or '"' in v for _, v, _, a, b in found)
        assert all(x[4] <= y[3] for x, y in zip(found, found[1:])) and all(a < b for *_, a, b in found)


def test_rows(spark):
    df = spark.createDataFrame([(1, "ID=a;P=b", "x"), (2, None, "x"), (3, "ID=" + "a" * 300_000, "x"), (4, "ID=a;P=b", "x"), (None, "a=1;b=2", "x")], "row_id long, f string, item_no string")
    got = explode_packed(df, "row_id", "f", "attributes", least=2)
    assert rows(got.select("row_id", "item_no", "item_tag", "item_value")) == [(1, 1, "ID", "a"), (1, 2, "P", "b"), (4, 1, "ID", "a"), (4, 2, "P", "b"), (None, 1, "a", "1"), (None, 2, "b", "2")]
    assert explode_packed(df.limit(0), "row_id", "f", "alleles").count() == 0
