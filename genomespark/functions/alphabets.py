"""Alphabets, residue weights and codon tables."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nucleotide complements, ambiguity codes and weights.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTUMRWSYKVHDBXN-", "TGCAAKYWSRMBDHVXN-"
AMBIGUITY = {"M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "X": "ACGT", "N": "ACGT"}
DNA_WEIGHT = {"A": 331.2218, "C": 307.1971, "G": 347.2212, "T": 322.2085}
RNA_WEIGHT = {"A": 347.2212, "C": 323.1965, "G": 363.2206, "U": 324.1813}
# Amino acids (letter, name, weight); letters without a weight are ambiguous, stop or gap.
AMINO = {
    "A": ("Ala", 89.0932), "C": ("Cys", 121.1582), "D": ("Asp", 133.1027), "E": ("Glu", 147.1293), "F": ("Phe", 165.1891),
    "G": ("Gly", 75.0666), "H": ("His", 155.1546), "I": ("Ile", 131.1729), "K": ("Lys", 146.1876), "L": ("Leu", 131.1729),
    "M": ("Met", 149.2113), "N": ("Asn", 132.1179), "P": ("Pro", 115.1305), "Q": ("Gln", 146.1445), "R": ("Arg", 174.201),
    "S": ("Ser", 105.0926), "T": ("Thr", 119.1192), "V": ("Val", 117.1463), "W": ("Trp", 204.2252), "Y": ("Tyr", 181.1885),
    "X": ("Xaa", None), "B": ("Asx", None), "Z": ("Glx", None), "*": ("Stp", None), "-": ("Gap", None),
}
ALPHABETS = {"DNA": "ACGT", "RNA": "ACGU", "AmbiguousDNA": "ACGTMRWSYKVHDBXN-", "AmbiguousRNA": "ACGUMRWSYKVHDBXN-", "Protein": "ACDEFGHIKLMNPQRSTVWYXBZ*-"}

# The universal code in the order of bases T, C, A, G.
_BASES = "TCAG"
_UNIVERSAL = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# The public genetic codes: id, names, starts, stops, differences from the universal code ("-" removes a codon).
CODES = [
    (1, "Standard,SGC0", "TTG CTG ATG", "TAA TAG TGA", ""),
    (2, "Vertebrate Mitochondrial,SGC1", "ATT ATC ATA ATG GTG", "TAA TAG AGA AGG", "AGA- AGG- ATAM TGAW"),
    (3, "Yeast Mitochondrial,SGC2", "ATA ATG GTG", "TAA TAG", "ATAM CTAT CTCT CTGT CTTT TGAW"),
    (4, "Mold Mitochondrial,Protozoan Mitochondrial,Coelenterate Mitochondrial,Mycoplasma,Spiroplasma,SGC3", "TTA TTG CTG ATT ATC ATA ATG GTG", "TAA TAG", "TGAW"),
    (5, "Invertebrate Mitochondrial,SGC4", "TTG ATT ATC ATA ATG GTG", "TAA TAG", "AGAS AGGS ATAM TGAW"),
    (6, "Ciliate Nuclear,Dasycladacean Nuclear,Hexamita Nuclear,SGC5", "ATG", "TGA", "TAAQ TAGQ"),
    (9, "Echinoderm Mitochondrial,Flatworm Mitochondrial,SGC8", "ATG GTG", "TAA TAG", "AAAN AGAS AGGS TGAW"),
    (10, "Euplotid Nuclear,SGC9", "ATG", "TAA TAG", "TGAC"),
    (11, "Bacterial,Archaeal,Plant Plastid", "TTG CTG ATT ATC ATA ATG GTG", "TAA TAG TGA", ""),
    (12, "Alternative Yeast Nuclear", "CTG ATG", "TAA TAG TGA", "CTGS"),
    (13, "Ascidian Mitochondrial", "TTG ATA ATG GTG", "TAA TAG", "AGAG AGGG ATAM TGAW"),
    (14, "Alternative Flatworm Mitochondrial", "ATG", "TAG", "AAAN AGAS AGGS TAAY TGAW"),
    (15, "Blepharisma Macronuclear", "ATG", "TAA TGA", "TAGQ"),
    (16, "Chlorophycean Mitochondrial", "ATG", "TAA TGA", "TAGL"),
    (21, "Trematode Mitochondrial", "ATG GTG", "TAA TAG", "AAAN AGAS AGGS ATAM TGAW"),
    (22, "Scenedesmus obliquus Mitochondrial", "ATG", "TCA TAA TGA", "TAGL TCA-"),
    (23, "Thraustochytrium Mitochondrial", "ATT ATG GTG", "TTA TAA TAG TGA", "TTA-"),
    (24, "Pterobranchia Mitochondrial", "TTG CTG ATG GTG", "TAA TAG", "AGAS AGGK TGAW"),
    (25, "Candidate Division SR1,Gracilibacteria", "TTG ATG GTG", "TAA TAG", "TGAG"),
    (26, "Pachysolen tannophilus Nuclear", "CTG ATG", "TAA TAG TGA", "CTGA"),
    (27, "Karyorelict Nuclear", "ATG", "TGA", "TAAQ TAGQ TGAW"),
    (28, "Condylostoma Nuclear", "ATG", "TAA TAG TGA", "TAAQ TAGQ TGAW"),
    (29, "Mesodinium Nuclear", "ATG", "TGA", "TAAY TAGY"),
    (30, "Peritrich Nuclear", "ATG", "TGA", "TAAE TAGE"),
    (31, "Blastocrithidia Nuclear", "ATG", "TAA TAG", "TAAE TAGE TGAW"),
    (32, "Balanophoraceae Plastid", "TTG CTG ATT ATC ATA ATG GTG", "TAA TGA", "TAGW"),
    (33, "Cephalodiscidae Mitochondrial", "TTG CTG ATG GTG", "TAG", "AGAS AGGK TAAY TGAW"),
]


@lru_cache
def codon_map(table: int = 1) -> dict[str, str]:
    """Codon -> amino acid of a table, stops as ``*`` (they overlay amino acids)."""
    _, _, _, stops, diffs = next((c for c in CODES if c[0] == table), (None,) * 5)
    if stops is None:
        raise KeyError(f"no codon table {table}")
    out = {"".join(c): a for c, a in zip(product(_BASES, repeat=3), _UNIVERSAL) if a != "*"}
    for d in diffs.split():
        if d[3] == "-":
            out.pop(d[:3], None)
        else:
            out[d[:3]] = d[3]
    return out | dict.fromkeys(stops.split(), "*")


def starts(table: int = 1) -> list[str]:
    """The start codons of a table."""
    return next(c for c in CODES if c[0] == table)[2].split()


def table_by_name(name: str) -> int:
    """The id of a table by any of its names."""
    for number, names, *_ in CODES:
        if name in names.split(","):
            return number
    raise KeyError(f"no codon table {name!r}")


def codon_rows() -> list[tuple[int, str, str | None, bool, bool]]:
    """(table_id, codon, aa, is_start, is_stop) of all tables; aa is what the codon gives before stops overlay it."""
    out = []
    for number, _, begin, stops, _ in CODES:
        for codon, aa in sorted(codon_map(number).items()):
            out.append((number, codon, aa, codon in begin.split(), codon in stops.split()))
    return out


def codon_tables(spark: SparkSession) -> DataFrame:
    """The codon tables as a DataFrame."""
    return spark.createDataFrame(codon_rows(), "table_id int, codon string, aa string, is_start boolean, is_stop boolean")


def codon_grid(table: int = 1) -> str:
    """A table as text: four rows of blocks by first base, columns by second, lines by third; stops named, starts marked."""
    aa, begin = codon_map(table), set(starts(table))
    cell = lambda c: f"{c} {'Stop' if aa.get(c) == '*' else aa.get(c, '-') + ('(s)' if c in begin else '')}"
    blocks = ["\n".join(" | ".join(f"{cell(x + y + z):<8}" for y in "TCAG").rstrip() for z in "TCAG") for x in "TCAG"]
    return "\n\n".join(blocks)


def literal_map(values: dict) -> Column:
    """A map literal of a small dictionary."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def nucleotide_weight(letter: str, rna: bool = False) -> float:
    """Weight of a nucleotide letter; ambiguous letters have the mean of their members, gaps -1."""
    weights = RNA_WEIGHT if rna else DNA_WEIGHT
    if letter == "-":
        return -1.0
    members = AMBIGUITY.get(letter, letter).replace("T", "U") if rna else AMBIGUITY.get(letter, letter).replace("U", "T")
    return sum(weights[m] for m in members) / len(members)
