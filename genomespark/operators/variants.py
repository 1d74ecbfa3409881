"""Variant records: genotypes, classes, re-indexed alleles, positional merge and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def genotype_indices(genotype: Column) -> Column:
    """Allele indices of the first token of a genotype, ``.`` as -1."""
    return F.transform(F.split(F.substring_index(genotype, ":", 1), "[/|]"), lambda x: F.when(x == ".", -1).otherwise(x.try_cast("int")))


def is_phased(genotype: Column) -> Column:
    """No slash in the first token (a single index counts as phased)."""
    return ~F.contains(F.substring_index(genotype, ":", 1), F.lit("/"))


def classify(ref: Column, alts: Column, genotype: Column) -> dict[str, Column]:
    """ref block, variant, SNP, deletion, insertion, indel of a record with an array of alternative alleles."""
    used = genotype_indices(genotype)
    ref_block = F.forall(used, lambda i: i == 0)
    symbolic = lambda a: F.startswith(a, F.lit("<"))
    plain = F.forall(alts, lambda a: symbolic(a) | (F.length(a) == 1))
    deletion = F.exists(alts, lambda a: (a == "<DEL>") | (~symbolic(a) & (F.length(a) < F.length(ref))))
    insertion = F.exists(alts, lambda a: (a == "<INS>") | (~symbolic(a) & (F.length(a) > F.length(ref))))
    variant = ~ref_block
    return {
        "is_ref_block": ref_block, "is_variant": variant, "is_snp": variant & (F.length(ref) == 1) & plain,
        "is_del": variant & deletion, "is_ins": variant & insertion, "is_indel": variant & (deletion | insertion),
    }


def reindexed(alts: Column, genotype: Column) -> tuple[Column, Column]:
    """The alternative alleles that the genotype uses, and the genotype's indices counted anew over them."""
    used = F.array_sort(F.array_distinct(F.filter(genotype_indices(genotype), lambda i: i > 0)))
    kept = F.transform(used, lambda i: F.get(alts, i - 1))
    sep = F.when(F.contains(genotype, F.lit("|")), "|").otherwise("/")
    parts = F.transform(genotype_indices(genotype), lambda i: F.when(i < 0, F.lit(".")).when(i == 0, F.lit("0")).otherwise(F.array_position(used, i).cast("string")))
    return kept, F.when(sep == "|", F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))


def used_alleles(indices: Column) -> Column:
    """The alternative alleles that some of several lists of allele indices use, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(indices), lambda i: i > 0)))


def covering(positions: DataFrame, variants: DataFrame, contig: str, pos: str, start: str, end: str, width: int = 1024) -> DataFrame:
    """Each position with the records that cover it (binned equi-join; a record is put into each bin it touches)."""
    left = positions.withColumn("_b", F.floor(F.col(pos) / width))
    right = variants.where(F.col(start) <= F.col(end)).withColumn("_vb", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))).withColumnRenamed(contig, "_vc")
    return left.join(right, (F.col(contig) == F.col("_vc")) & (F.col("_b") == F.col("_vb")) & (F.col(start) <= F.col(pos)) & (F.col(end) >= F.col(pos))).drop("_b", "_vb", "_vc")


def out_of_order(df: DataFrame, file: str, order: str, contig: str, start: str, end: str) -> DataFrame:
    """Records that start at or before the end of the record before them on the same contig of a file."""
    w = Window.partitionBy(file).orderBy(order)
    before = df.withColumn("_c", F.lag(contig).over(w)).withColumn("_e", F.lag(end).over(w))
    return before.where((F.col("_c") == F.col(contig)) & (F.col(start) <= F.col("_e"))).drop("_c", "_e")


def contig_order(lists: dict[str, list[str]]) -> list[str]:
    """One order of contigs that agrees with the order of every file; contigs on circles are left out."""
    after: dict[str, set[str]] = {}
    for contigs in lists.values():
        for c in contigs:
            after.setdefault(c, set())
        for a, b in zip(contigs, contigs[1:]):
            after[a].add(b)
    waiting = {c: sum(c in s for s in after.values()) for c in after}
    ready, out = sorted(c for c, n in waiting.items() if not n), []
    while ready:
        c = ready.pop(0)
        out.append(c)
        for b in sorted(after[c]):
            waiting[b] -= 1
            if not waiting[b]:
                ready.append(b)
    return out


def valid_files(lists: dict[str, list[str]]) -> dict[str, bool]:
    """Whether each file's contigs come without repeats and in the order common to all files."""
    merged = contig_order(lists)
    return {f: len(set(cs)) == len(cs) and cs == [c for c in merged if c in set(cs)] for f, cs in lists.items()}


def merged_calls(cover: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, alts, genotypes): merged SNP sites from the record of each sample that covers a position.

    ``cover`` has the keys (contig, pos), sample_name, start_pos, end_pos, ref_allele, alts and genotype, one row per
    sample.  The first known reference base by sample name is the site's; a sample with another one drops the site, and
    so does N.  A site needs one sample with a SNP.  Indels show as ``<INS>``, ``<DEL>`` or the base before a deletion;
    reference blocks show the reference; all else is ``.``.  Alternatives come in the order in which they appear by sample
    name, symbolic ones last.
    """
    at = F.col("pos") - F.col("start_pos")
    base = F.when(at < F.length("ref_allele"), F.substring("ref_allele", at + 1, F.lit(1)))
    kinds = classify(F.col("ref_allele"), F.col("alts"), F.col("genotype"))
    alleles = F.transform(genotype_indices(F.col("genotype")), lambda i: F.when(i < 0, ".").when(i == 0, F.col("ref_allele")).otherwise(F.coalesce(F.get(F.col("alts"), i - 1), F.lit("."))))
    kind = F.when(kinds["is_indel"], "indel").when(kinds["is_snp"], "snp").when(kinds["is_ref_block"], "ref").otherwise("none")
    rows = cover.select(*keys, F.struct("sample_name", base.alias("base"), (at == 0).alias("first"), (F.col("end_pos") - F.col("start_pos") + 1).alias("n"), alleles.alias("g"), kind.alias("kind"), is_phased(F.col("genotype")).alias("phased")).alias("c"))
    sites = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("l")).withColumn("ref", F.get(F.filter("l", lambda c: c["base"].isNotNull()), F.lit(0))["base"])
    good = sites.where((F.col("ref") != "N") & F.forall("l", lambda c: c["base"].isNull() | (c["base"] == F.col("ref"))) & F.exists("l", lambda c: c["kind"] == "snp"))

    def shown(c: Column) -> Column:
        ins = lambda g: (g == "<INS>") | (~F.startswith(g, F.lit("<")) & (F.length(g) > c["n"]))
        gone = lambda g: (g == "<DEL>") | (F.length(g) < c["n"])
        first = lambda g: F.when(c["first"] & (F.substring(g, 1, 1) == F.col("ref")), F.substring(g, 1, 1)).otherwise("<DEL>")
        indel = F.transform(c["g"], lambda g: F.when(g == ".", ".").when(ins(g), "<INS>").when(gone(g), first(g)).when(F.length(g) == 1, g).otherwise("."))
        return F.when(c["kind"] == "indel", indel).when(c["kind"] == "snp", c["g"]).when(c["kind"] == "ref", F.transform(c["g"], lambda _: F.col("ref"))).otherwise(F.transform(c["g"], lambda _: F.lit(".")))

    calls = good.withColumn("s", F.transform("l", lambda c: F.struct(c["sample_name"].alias("sample"), shown(c).alias("g"), c["phased"].alias("phased"))))
    seen = F.array_except(F.array_distinct(F.flatten(F.transform("s", lambda x: x["g"]))), F.array(F.col("ref"), F.lit(".")))
    symbolic = lambda a: F.startswith(a, F.lit("<"))
    alts = F.concat(F.filter(seen, lambda a: ~symbolic(a)), F.filter(seen, symbolic))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["sample"], F.lit("="), F.array_join(x["g"], "/"))), ";")
    return calls.select(*keys, "ref", F.array_join(alts, ",").alias("alts"), text.alias("genotypes"))
