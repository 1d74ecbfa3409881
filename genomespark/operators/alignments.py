"""Pairwise alignment blocks: runs of columns, coverage and identity, and variant calls along the reference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomespark.operators.intervals import depth
from genomespark.operators.ordered import Chunks
from genomespark.operators.skew import ROWS
from genomespark.runtime import cut


def states(ref: Column, qry: Column) -> Column:
    """A letter per column: M match, X mismatch, D gap in the query, I gap in the reference, _ gap in both."""
    state = lambda r, q: F.when((r == "-") & (q == "-"), "_").when(r == "-", "I").when(q == "-", "D").when(F.upper(r) == F.upper(q), "M").otherwise("X")
    return F.array_join(F.zip_with(F.split(ref, ""), F.split(qry, ""), state), "")


def column_runs(blocks: DataFrame, block: str = "block", ref: str = "ref", qry: str = "qry", start0: str = "start0") -> DataFrame:
    """(block, other columns, n, state, r_start, r_end, c_start, width): maximal runs of columns of one state.

    ``r_start`` to ``r_end`` are 1-based reference positions; an insertion has r_end = r_start - 1.  ``c_start`` is the
    0-based column.  A row per run, not per base.
    """
    rest = [c for c in blocks.columns if c not in (ref, qry)]
    runs = blocks.select(*rest, F.posexplode(F.regexp_extract_all(states(F.col(ref), F.col(qry)), F.lit("M+|X+|D+|I+|_+"), F.lit(0))).alias("n", "run"))
    order = Window.partitionBy(block).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    state, width = F.substring("run", 1, 1), F.length("run")
    used = F.when(state.isin("M", "X", "D"), width).otherwise(0)
    before, at = F.coalesce(F.sum(used).over(order), F.lit(0)), F.coalesce(F.sum(width).over(order), F.lit(0))
    first = F.col(start0) + 1 + before
    return runs.select(*rest, "n", state.alias("state"), first.alias("r_start"), (first + used - 1).alias("r_end"), at.alias("c_start"), width.alias("width"))


def coverage(runs: DataFrame, contig: str, identical: bool = False) -> DataFrame:
    """(contig, r_start, r_end, depth): how many blocks cover (or equal) the reference there."""
    wanted = ["M"] if identical else ["M", "X"]
    return depth(runs.where(F.col("state").isin(*wanted)), [contig], "r_start", "r_end")


def coverage_percent(runs: DataFrame, sizes: DataFrame, contig: str) -> DataFrame:
    """(contig, num_region_bps, percent_cov, percent_id) over whole contigs; ``sizes`` is (contig, num_region_bps)."""
    runs = cut(runs.where("state IN ('M', 'X')").select(contig, "state", "r_start", "r_end"))  # read for both shares
    total = lambda d, name: d.groupBy(contig).agg(F.sum(F.col("r_end") - F.col("r_start") + 1).alias(name))
    both = sizes.join(total(coverage(runs, contig), "c"), contig, "left").join(total(coverage(runs, contig, True), "i"), contig, "left")
    share = lambda n: F.coalesce(F.col(n), F.lit(0)) * F.lit(100.0) / F.col("num_region_bps")
    return both.select(contig, "num_region_bps", share("c").alias("percent_cov"), share("i").alias("percent_id"))


@dataclass
class Call:
    """A reference block, missing block or variant; positions are 1-based and closed."""

    start: int
    end: int
    ref: str
    alt: str
    kind: str  # ref, missing, variant
    asm_start: int
    asm_end: int


def call_variants(ref: str, alt: str, start0: int, asm_start0: int = 0, strand: str = "+", asm_size: int = 0, base_before: str = "") -> list[Call]:
    """Walk the stretches of columns of one block: reference blocks, blocks of unknown letters, SNPs and left-anchored indels.

    An indel takes the base before it as its anchor, which leaves the call that held it; a leading indel at position 1 is
    anchored on the base after it.  ``base_before`` is the reference base before the block.  Columns with gaps on both
    sides are skipped.  On the minus strand assembly positions run backwards.  Time is linear in the columns.
    """
    r_all, a_all = (np.frombuffer(x.upper().encode("latin-1", "replace"), np.uint8) for x in (ref, alt))
    n = min(len(r_all), len(a_all))
    some = (r_all[:n] != _GAP) | (a_all[:n] != _GAP)
    r_col, a_col = r_all[:n][some], a_all[:n][some]
    r_text, a_text = (x.tobytes().decode("latin-1") for x in (r_col, a_col))
    step = -1 if strand == "-" else 1
    asm = asm_start0 + 1 if step > 0 else asm_size - asm_start0
    at, out = start0 + 1, []
    # stretches of columns of one kind: gaps, equal, unknown and different letters
    kinds = np.where((r_col == _GAP) | (a_col == _GAP), 0, np.where(r_col == a_col, 1, np.where(a_col == ord("N"), 2, 3)))
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)] if len(kinds) else []

    def push(kind: str, r: str, a: str, begin: int, asm_begin: int) -> None:
        out.append(Call(begin, begin + len(r) - 1, r, a, kind, asm_begin, asm_begin + step * (max(len(a), 1) - 1)))

    def extend(kind: str, r: str, a: str, begin: int, asm_begin: int) -> None:
        """A stretch of one kind; blocks go on with a block of their kind right before them, each variant is its own."""
        last = out[-1] if out else None
        if kind == "variant":
            for k in range(len(r)):
                push(kind, r[k], a[k], begin + k, asm_begin + step * k)
        elif last and last.kind == kind and last.end == begin - 1:
            last.end, last.ref, last.alt, last.asm_end = begin + len(r) - 1, last.ref + r, last.alt + a, asm_begin + step * (len(a) - 1)
        else:
            push(kind, r, a, begin, asm_begin)

    used = 0  # columns that an indel at the start of the sequence took for its anchor
    for i, j in zip(edges, edges[1:]):
        i = max(i, used)
        if i == j:
            continue
        if kinds[i]:
            extend(_KINDS[kinds[i]], r_text[i:j], a_text[i:j], at, asm)
            at, asm = at + j - i, asm + step * (j - i)
            continue
        refs, alts = r_text[i:j].replace("-", ""), a_text[i:j].replace("-", "")
        begin, asm_begin = at, asm
        at, asm = at + len(refs), asm + step * len(alts)
        if begin == 1 and not out:
            if j < len(kinds):
                refs, alts = refs + r_text[j], alts + a_text[j]
                at, asm, used = at + 1, asm + step, j + 1
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


_GAP, _KINDS = ord("-"), ("gap", "ref", "missing", "variant")
CALL_SCHEMA = "v_start int, v_end int, ref string, alt string, kind string, asm_start int, asm_end int"


def call_blocks(blocks: DataFrame, keys: list[str], ref: str = "ref", qry: str = "qry", start0: str = "start0", assembly: tuple[str, str, str] | None = None, base_before: str | None = None) -> DataFrame:
    """The calls of every alignment block, a row each: keys and :data:`CALL_SCHEMA`.

    ``assembly`` names the columns of the query's 0-based start, its strand and the size of its sequence (none: from 0 on the
    plus strand), ``base_before`` the column of the reference base before the block.  Blocks without a text give no row.
    """
    schema = T.StructType([*[blocks.schema[k] for k in keys], *T._parse_datatype_string(CALL_SCHEMA).fields])
    a0, strand, size = [F.col(c) for c in assembly] if assembly else [F.lit(0), F.lit("+"), F.lit(0)]
    before = F.col(base_before) if base_before else F.lit("")
    inputs = [F.col(ref), F.col(qry), F.col(start0).cast("long"), F.coalesce(a0.cast("long"), F.lit(0)), F.coalesce(strand, F.lit("+")), F.coalesce(size.cast("long"), F.lit(0)), F.coalesce(F.upper(before), F.lit(""))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows, calls = [], []
            for i, (r, q, s, *more) in enumerate(zip(*[batch.column(len(keys) + j).to_pylist() for j in range(7)])):
                if r is None or q is None or s is None:
                    continue
                found = [(c.start, c.end, c.ref, c.alt, c.kind, c.asm_start, c.asm_end) for c in call_variants(r, q, s, *more)]
                rows += [i] * len(found)
                calls += found
            columns = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(len(keys))]
            parts = list(zip(*calls)) if calls else [()] * 7
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(list(p), k) for p, k in zip(parts, kinds)]], names=[f.name for f in schema])

    return blocks.select(*keys, *[c.alias(f"_i{n}") for n, c in enumerate(inputs)]).mapInArrow(work, schema)


def fill_gaps(calls: DataFrame, sizes: DataFrame, contig: str, start: str = "v_start", end: str = "v_end", rows: int = ROWS) -> DataFrame:
    """(contig, start, end) of what lies before, between and after the calls of a contig; ``sizes`` is (contig, size)."""
    c = Chunks(calls.select(contig, start, end), [contig], [start, end], rows)
    known = c.carried(c.df, {"_e": F.max(end)}, {"_to": F.max("_e").over(c.earlier)})
    reach = known.select(contig, start, end, F.greatest(F.max(end).over(c.before), "_to").alias("_r"))
    inner = reach.select(contig, (F.coalesce("_r", F.lit(0)) + 1).alias("a"), (F.col(start) - 1).alias("b"))
    last = c.df.groupBy(contig).agg((F.max(end) + 1).alias("a")).join(sizes, contig).select(contig, "a", F.col("size").alias("b"))
    return inner.unionByName(last).where("a <= b").select(contig, F.col("a").alias(start), F.col("b").alias(end))


def split_haplotypes(starts_ends: list[tuple[int, int]]) -> list[int]:
    """1 or 2 for each interval in order of start: one that overlaps the last of the first haplotype goes to the second."""
    out, last, second = [], -1, -1
    for s, e in starts_ends:
        if s > last:
            out.append(1)
            last = e
        elif s > second:
            out.append(2)
            second = e
        else:
            raise ValueError("more than two alignments overlap")
    return out


def rebuilt(calls: DataFrame, key: str) -> DataFrame:
    """(key, seq): the query sequence that the calls of a key spell, in order of start; symbolic ``*`` spells nothing.

    One key's calls come together in one row, as its sequence does.
    """
    ordered = F.array_sort(F.collect_list(F.struct("v_start", "v_end", "alt")))
    return calls.groupBy(key).agg(F.replace(F.array_join(F.transform(ordered, lambda c: c["alt"]), ""), F.lit("*"), F.lit("")).alias("seq"))


def variant_columns(ref: Column, alt: Column, missing: Column, max_deletion: int | None = None) -> dict[str, Column]:
    """Allele text, genotype, depths and likelihoods of a variant row.

    A row without a real alternative is a reference row; deletions longer than ``max_deletion`` become symbolic; missing
    rows have no genotype and no depth.
    """
    is_ref = (alt == ".") | (alt == ref)
    long = F.lit(False) if max_deletion is None else F.length(ref) - F.length(alt) > max_deletion
    alleles = F.when(is_ref, F.concat(ref, F.lit(",<NON_REF>"))).when(long, F.concat(F.substring(ref, 1, 1), F.lit(",<DEL>,<NON_REF>"))).otherwise(F.concat(ref, F.lit(","), alt, F.lit(",<NON_REF>")))
    return {
        "alleles": alleles,
        "gt": F.when(missing, ".").when(is_ref, "0").otherwise("1"),
        "dp": F.when(missing, 0).otherwise(30),
        "ad": F.when(missing, "0,0").when(is_ref, "30,0").otherwise("0,30,0"),
        "pl": F.when(is_ref, "0,90,90").otherwise("90,90,0"),
    }


def assign_haplotypes(blocks: DataFrame, contig: str, start: str, end: str, key: str) -> DataFrame:
    """(contig, key, haplotype): 1, 2, or 0 where a third alignment overlaps both.

    Where no block reaches over a block's start, both haplotypes are free again: such stretches of blocks are dealt by
    themselves, by many tasks.  The blocks of a stretch stream through in order of start; only two open ends are held.
    """
    from genomespark.operators.intervals import with_stretch

    schema = T.StructType([blocks.schema[contig], blocks.schema[key], T.StructField("haplotype", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, second = None, -1, -1
        for batch in batches:
            out = []
            for c, s, e, stretch in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                if (c, stretch) != at:
                    at, first, second = (c, stretch), -1, -1
                if s > first:
                    first = e
                    out.append(1)
                elif s > second:
                    second = e
                    out.append(2)
                else:
                    out.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=[f.name for f in schema])

    placed = with_stretch(blocks.select(contig, key, start, end), [contig], start, end)
    return placed.repartition(contig, "_stretch").sortWithinPartitions(contig, "_stretch", start, end, key).mapInArrow(work, schema)


def sub_block(ref: str, qry: str, start0: int, first: int, last: int) -> tuple[str, str, int]:
    """The columns of a block from reference position ``first`` to ``last`` (1-based), and their 0-based start."""
    place = start0 + np.cumsum(np.frombuffer(ref.encode("latin-1", "replace"), np.uint8) != ord("-"))
    a, b = int(np.searchsorted(place, first)), int(np.searchsorted(place, last, "right"))
    while b > a and ref[b - 1] == "-":
        b -= 1
    return ref[a:b], qry[a:b], first - 1


def fill_haplotypes(blocks: DataFrame, contig: str = "contig", block: str = "block") -> DataFrame:
    """(contig, block, haplotype, start0, ref, qry): the blocks of two haplotypes, each completed by what only the other
    covers.

    ``blocks`` has contig, block, start0, ref, qry.  A block that overlaps both haplotypes (a third alignment) comes back
    whole under haplotype 0 and completes neither.  The positions to fill are an interval difference; each piece is then cut from its block by itself.
    """
    from genomespark.operators.intervals import subtract

    end = F.col("start0") + F.length(F.replace(F.col("ref"), F.lit("-"), F.lit("")))
    placed = blocks.withColumn("_a", (F.col("start0") + 1).cast("long")).withColumn("_b", end.cast("long"))
    dealt = placed.join(assign_haplotypes(placed, contig, "_a", "_b", block), [contig, block])
    side = lambda h: dealt.where(F.col("haplotype") == h)
    own = dealt.select(contig, block, "haplotype", "_a", "_b")
    gaps = [subtract(side(3 - h), side(h), block, contig, "_a", "_b").select(contig, block, F.lit(h).alias("haplotype"), "_a", "_b") for h in (1, 2)]
    wanted = own.unionByName(gaps[0]).unionByName(gaps[1]).join(blocks.select(block, "start0", "ref", "qry"), block)
    schema = T.StructType([blocks.schema[contig], blocks.schema[block], T.StructField("haplotype", T.IntegerType()), T.StructField("start0", T.LongType()), T.StructField("ref", T.StringType()), T.StructField("qry", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [sub_block(r, q, s, a, b) for a, b, s, r, q in zip(*[batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()), pa.array([c[2] for c in cut], pa.int64()), pa.array([c[0] for c in cut], pa.string()), pa.array([c[1] for c in cut], pa.string())], names=[f.name for f in schema])

    return wanted.select(contig, block, "haplotype", "_a", "_b", "start0", "ref", "qry").mapInArrow(work, schema)
