"""Type ontologies: stanza text, synonyms, is-a and part-of closures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomespark.operators.hierarchy import closure
from genomespark.runtime import cut

# Some types of the public sequence ontology, in its stanza format.
MINI = """
[Term]
id: SO:0000110
name: sequence_feature
[Term]
id: SO:0000001
name: region
is_a: SO:0000110
[Term]
id: SO:0000340
name: chromosome
is_a: SO:0000001
[Term]
id: SO:0000148
name: supercontig
synonym: "scaffold" EXACT []
is_a: SO:0000001
[Term]
id: SO:0000704
name: gene
synonym: "INSDC_feature:gene" EXACT []
is_a: SO:0000001
relationship: member_of SO:0005855
[Term]
id: SO:0005855
name: gene_group
is_a: SO:0000001
[Term]
id: SO:0000673
name: transcript
synonym: "INSDC_feature:misc_RNA" BROAD []
is_a: SO:0000831
relationship: part_of SO:0000704
[Term]
id: SO:0000831
name: gene_member_region
is_a: SO:0000001
relationship: member_of SO:0000704
[Term]
id: SO:0000234
name: mRNA
synonym: "messenger RNA" EXACT []
is_a: SO:0000673
[Term]
id: SO:0000147
name: exon
is_a: SO:0000833
[Term]
id: SO:0000833
name: transcript_region
is_a: SO:0000001
relationship: part_of SO:0000673
[Term]
id: SO:0000316
name: CDS
synonym: "coding sequence" EXACT []
synonym: "coding_sequence" RELATED []
is_a: SO:0000836
[Term]
id: SO:0000836
name: mRNA_region
is_a: SO:0000833
relationship: part_of SO:0000234
[Term]
id: SO:0000203
name: UTR
is_a: SO:0000836
[Term]
id: SO:0000204
name: five_prime_UTR
synonym: "5' UTR" EXACT []
is_a: SO:0000203
[Term]
id: SO:0000205
name: three_prime_UTR
synonym: "3' UTR" EXACT []
is_a: SO:0000203
"""


def parse(text: str) -> dict[str, list[tuple]]:
    """Rows of ``types`` (id, name), ``synonyms`` (id, name, exact), ``is_a`` and ``part_of`` (id, of)."""
    out: dict[str, list[tuple]] = {"types": [], "synonyms": [], "is_a": [], "part_of": []}
    for stanza in re.split(r"(?m)^\[", text):
        if not stanza.startswith("Term]"):
            continue
        lines = [x.partition(":")[::2] for x in stanza.splitlines()[1:] if ":" in x]
        values = lambda tag: [v.partition("!")[0].strip() for k, v in lines if k == tag]
        ident = values("id")[0]
        out["types"].append((ident, values("name")[0]))
        out["synonyms"] += [(ident, ident, True), (ident, values("name")[0], True)]
        for v in values("synonym"):
            m = re.match(r'"(.*)"\s+(\w+)', v)
            if m:
                out["synonyms"].append((ident, m.group(1), m.group(2) == "EXACT"))
        out["is_a"] += [(ident, v) for v in values("is_a")]
        out["part_of"] += [(ident, v.split()[1]) for v in values("relationship") if v.split()[0] in ("part_of", "member_of", "integral_part_of")]
    return out


def tables(spark: SparkSession, text: str = MINI) -> dict[str, DataFrame]:
    """The ontology as DataFrames."""
    rows = parse(text)
    return {
        "types": spark.createDataFrame(rows["types"], "id string, name string"),
        "synonyms": spark.createDataFrame(rows["synonyms"], "id string, name string, exact boolean"),
        "is_a": spark.createDataFrame(rows["is_a"], "node string, parent string"),
        "part_of": spark.createDataFrame(rows["part_of"], "node string, parent string"),
    }


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The ontology of a file in stanza format; type ontologies are a few megabytes, and are read on the driver."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    return tables(spark, text)


def contains(onto: dict[str, DataFrame], name: str) -> bool:
    """Whether a type has this id, name or exact synonym."""
    return not onto["synonyms"].where(F.col("exact") & (F.col("name") == name)).isEmpty()


def is_a(onto: dict[str, DataFrame]) -> DataFrame:
    """(node, ancestor, dist): all super-types, the type itself with 0."""
    return closure(onto["types"].select(F.col("id").alias("node")), onto["is_a"])


def part_of(onto: dict[str, DataFrame]) -> DataFrame:
    """(node, goal): a type is part of a goal if something it reaches by is-a or part-of is directly part of a super-type
    of the goal."""
    nodes = onto["types"].select(F.col("id").alias("node"))
    either = onto["is_a"].unionByName(onto["part_of"]).distinct()
    reach = cut(closure(nodes, either)).select("node", F.col("ancestor").alias("via"))
    goals = cut(is_a(onto)).select(F.col("node").alias("goal"), F.col("ancestor").alias("super"))
    direct = onto["part_of"].select(F.col("node").alias("via"), F.col("parent").alias("super"))
    return reach.join(direct, "via").join(goals, "super").select("node", "goal").distinct()


def define(onto: dict[str, DataFrame], ident: str, name: str, is_a_of: str | None = None, part_of_of: str | None = None, synonyms: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The ontology with one more type; a name that is taken, an unknown relative or a circle raises."""
    spark = onto["types"].sparkSession
    taken = onto["synonyms"].where("exact").select("name").where(F.col("name").isin(ident, name, *synonyms)).collect()
    if taken:
        raise ValueError(f"name is taken: {taken[0].name}")
    known = {r.id for r in onto["types"].select("id").where(F.col("id").isin([x for x in (is_a_of, part_of_of) if x] or [""])).collect()} | {ident}
    lost = [x for x in (is_a_of, part_of_of) if x and x not in known]
    if lost:
        raise ValueError(f"no such type: {lost[0]}")
    out = dict(onto)
    row = lambda cols, *values: spark.createDataFrame([values], cols)
    out["types"] = onto["types"].unionByName(row("id string, name string", ident, name))
    for s in (ident, name, *synonyms):
        out["synonyms"] = out["synonyms"].unionByName(row("id string, name string, exact boolean", ident, s, True))
    for kind, of in (("is_a", is_a_of), ("part_of", part_of_of)):
        if of:
            out[kind] = out[kind].unionByName(row("node string, parent string", ident, of))
    check_circles(out)
    return out


def check_circles(onto: dict[str, DataFrame]) -> None:
    """Raise if a type is its own super-type."""
    from genomespark.operators.hierarchy import CYCLE, expand_hierarchy

    found = expand_hierarchy(onto["types"].select(F.col("id").alias("node")), onto["is_a"]).where(F.col("root") == CYCLE).limit(1).collect()
    if found:
        raise ValueError(f"circle through {found[0].node}")


def graph_text(onto: dict[str, DataFrame]) -> DataFrame:
    """(line): the ontology as lines of graph text, is-a drawn whole and part-of dashed."""
    node = onto["types"].select(F.concat(F.lit('"'), "id", F.lit('" [label="'), "name", F.lit('"];')).alias("line"))
    edge = lambda df, style: df.select(F.concat(F.lit('"'), "node", F.lit('" -> "'), "parent", F.lit(f'" [style={style}];')).alias("line"))
    return node.unionByName(edge(onto["is_a"], "solid")).unionByName(edge(onto["part_of"], "dashed"))
