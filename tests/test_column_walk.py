"""The walk along stretches of an alignment block, held against a walk column by column."""

import random
import time

import pytest

from genomespark.operators.alignments import Call, call_blocks, call_variants


def by_columns(ref: str, alt: str, start0: int, asm_start0: int = 0, strand: str = "+", asm_size: int = 0, base_before: str = "") -> list[Call]:
    """The same walk column by column, with texts that grow letter by letter."""
    columns = [(r, a) for r, a in zip(ref.upper(), alt.upper()) if not (r == "-" == a)]
    step = -1 if strand == "-" else 1
    asm = asm_start0 + 1 if step > 0 else asm_size - asm_start0
    at, out, i = start0 + 1, [], 0

    def push(kind: str, r: str, a: str, begin: int, asm_begin: int) -> None:
        n = max(len(a.replace("-", "")), 1)
        out.append(Call(begin, begin + len(r) - 1, r, a, kind, asm_begin, asm_begin + step * (n - 1)))

    def extend(kind: str, r: str, a: str, begin: int, asm_begin: int) -> None:
        last = out[-1] if out else None
        if last and last.kind == kind and last.end == begin - 1 and kind in ("ref", "missing"):
            last.end, last.ref, last.alt, last.asm_end = begin, last.ref + r, last.alt + a, asm_begin
        else:
            push(kind, r, a, begin, asm_begin)

    while i < len(columns):
        r, a = columns[i]
        if r != "-" and a != "-":
            extend("ref" if r == a else "missing" if a == "N" else "variant", r, a, at, asm)
            at, asm, i = at + 1, asm + step, i + 1
            continue
        refs, alts = "", ""
        while i < len(columns) and "-" in columns[i]:
            refs += columns[i][0].strip("-")
            alts += columns[i][1].strip("-")
            i += 1
        begin, asm_begin = at, asm
        at, asm = at + len(refs), asm + step * len(alts)
        if begin == 1 and not out:
            if i < len(columns):
                refs, alts = refs + columns[i][0], alts + columns[i][1]
                at, asm, i = at + 1, asm + step, i + 1
        else:
            if not out:
                refs, alts, begin = base_before + refs, base_before + alts, begin - len(base_before)
            while out and begin == out[-1].end + 1:
                last = out[-1]
                if last.kind == "ref":
                    refs, alts, begin, asm_begin = last.ref[-1] + refs, last.alt[-1] + alts, last.end, asm_begin - step
                    last.end, last.ref, last.alt, last.asm_end = last.end - 1, last.ref[:-1], last.alt[:-1], last.asm_end - step
                    if not last.ref:
                        out.pop()
                    break
                refs, alts, begin, asm_begin = last.ref + refs, last.alt + alts, last.start, last.asm_start
                out.pop()
                if last.kind == "variant":
                    break
        if refs == alts:
            push("ref", refs, alts, begin, asm_begin)
        elif len(refs) == len(alts):
            for k, (x, y) in enumerate(zip(refs, alts)):
                extend("ref" if x == y else "missing" if y == "N" else "variant", x, y, begin + k, asm_begin + step * k)
        else:
            push("variant", refs, alts, begin, asm_begin)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_stretches_give_what_columns_give(seed):
    r = random.Random(seed)
    for _ in range(400):
        n = r.randrange(0, 40)
        ref = "".join(r.choice("ACGTACGTacgtN--") for _ in range(n))
        alt = "".join(x if r.random() < 0.6 else r.choice("ACGTN---") for x in ref)
        args = (r.choice([0, 0, 5, 700]), r.choice([0, 9]), r.choice("+-"), 5_000, r.choice(["", "A"]))
        assert call_variants(ref, alt, *args) == by_columns(ref, alt, *args)


def test_a_long_block_takes_linear_time():
    r = random.Random(1)
    ref = "".join(r.choices("ACGT", k=1_000_000))
    alt = "".join("-" if i % 997 == 0 else "A" if i % 499 == 0 else c for i, c in enumerate(ref))
    begun = time.time()
    calls = call_variants(ref, alt, 0)
    assert time.time() - begun < 5 and sum(len(c.ref) for c in calls) == 1_000_000


def test_blocks_on_the_minus_strand(spark):
    data = [(1, "c1", "ACGTA", "ACCTA", 10, 3, "-", 100, "g"), (2, "c1", "--ACG", "TTACG", 20, 0, "+", 50, "g"), (3, "c1", None, "A", 5, 0, "+", 9, None)]
    df = spark.createDataFrame(data, "block int, contig string, ref string, qry string, start0 int, q0 int, qs string, qn int, base string")
    got = sorted(tuple(x) for x in call_blocks(df, ["block"], assembly=("q0", "qs", "qn"), base_before="base").collect())
    assert got == [(1, 11, 12, "AC", "AC", "ref", 97, 96), (1, 13, 13, "G", "C", "variant", 95, 95), (1, 14, 15, "TA", "TA", "ref", 94, 93), (2, 20, 20, "G", "GTT", "variant", 1, 3), (2, 21, 23, "ACG", "ACG", "ref", 3, 5)]
