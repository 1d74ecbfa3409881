import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from genomespark.operators.rejects import reject_lines, valid_lines
from tests.helpers import rows


def outside(text, sep):
    parts, quoted = [""], False
    for c in text:
        quoted ^= c == '"'
        if c == sep and not quoted:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def brute(line):
    if line is None:
        return None
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip() or line.startswith("#"):
        return None
    if line.count('"') % 2:
        return "quoting"
    c = outside(line, "\t")
    if len(c) != 9:
        return "columns"
    pos = []
    for x in c[3:5]:
        if not re.fullmatch("[0-9]+", x) or not 1 <= int(x) <= 2147483647:
            return "coordinates"
        pos.append(int(x))
    if pos[0] > pos[1]:
        return "coordinates"
    if c[5] != "." and not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", c[5]):
        return "score"
    if c[6] not in ("+", "-", ".", "?"):
        return "strand"
    if c[7] not in ("0", "1", "2", ".") or c[7] == "." and c[2] == "CDS":
        return "phase"
    a = c[8][:-1] if outside(c[8], ";")[-1] == "" and c[8].endswith(";") else c[8]
    tags = []
    for part in outside(a, ";"):
        kv = outside(part, "=")
        if len(kv) != 2:
            return "attributes"
        tags.append(kv[0].strip())
        if tags[-1] == "ID" and len(outside(kv[1], ",")) > 1:
            return "attributes"
    return "attributes" if len(set(tags)) < len(tags) else None


cell = st.sampled_from(["1", "9", "0", "007", "99999999999", "2147483647", "2147483648", ".", "+", "-", "?", "CDS", "gene", "1e5", "-.5", "x", "", "ID=a", "ID=a;N=b", 'N="x;y"', "ID=a,b", 'ID="a,b"', "N=a;N=b", "N", "N==a", "ID=a;", '"', "１", "3 "])
good = ["c", "s", "gene", "1", "9", ".", "+", ".", "ID=a"]
line = st.one_of(st.none(), st.sampled_from(["", " \t ", "#x", "\r", "a\tb"]), st.lists(st.tuples(st.integers(0, 8), cell), max_size=3).map(lambda e: "\t".join([dict(e).get(i, g) for i, g in enumerate(good)])), st.lists(cell, min_size=8, max_size=10).map("\t".join))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(line, st.sampled_from(["", "\r"])), min_size=20, max_size=60))
def test_against_brute_force(spark, lines):
    data = [(i, None if x is None else x + end) for i, (x, end) in enumerate(lines)]
    got = dict(rows(reject_lines(spark.createDataFrame(data, "line_key long, line_text string"))))
    assert got == {i: r for i, x in data if (r := brute(x))}


def test_edges(spark):
    assert reject_lines(spark.createDataFrame([], "line_key long, line_text string")).count() == 0
    text = "\t".join(good)
    data = [(1, text, "a", datetime(2024, 1, 1)), (2, text + "\tx", "b", None), (3, text[:-1] + "x" * 200_000, "c", None), (4, 'c\ts\tgene\t1\t9\t.\t+\t.\tID="a\tb"', "d", None)]
    df = spark.createDataFrame(data, "line_key long, line_text string, reason string, start_pos timestamp")
    assert rows(reject_lines(df)) == [(2, "columns")]
    got = valid_lines(df)
    assert sorted(r.line_key for r in got.collect()) == [1, 3, 4]
    assert [r.attributes for r in got.where("line_key = 4").collect()] == ['ID="a\tb"']
