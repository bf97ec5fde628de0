"""The standard genetic code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Amino acids of the 64 codons, bases in the order T, C, A, G; and the names of their letters.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
NAMES = {"A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "*": "Stop"}


def table(spark: SparkSession) -> DataFrame:
    """codon, letter, name."""
    rows = [(a + b + c, CODE[16 * i + 4 * j + k]) for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")]
    return spark.createDataFrame([(c, x, NAMES[x]) for c, x in rows], "codon string, letter string, name string")


def amino_acid(codon: Column) -> Column:
    """The letter of a codon in either case, U read as T; null if it is none."""
    c = F.translate(F.upper(codon), "U", "T")
    place = lambda i: F.call_function("instr", F.lit("TCAG"), F.substring(c, i, 1)) - 1
    return F.when(c.rlike("^[ACGT]{3}$"), F.call_function("substring", F.lit(CODE), place(1) * 16 + place(2) * 4 + place(3) + 1, F.lit(1)))
