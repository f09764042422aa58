"""What the corpus operators share: white space, keys of lines, and written cuts.

White space means the six ASCII characters of `[\\x20\\x09-\\x0D]` everywhere in this
subpackage; a word is a longest run of other characters.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.runtime import new_folder

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once under the shared folder and go on from the written table."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; the general function serves where all is ASCII."""
    return F.when(
        F.octet_length(text) == F.char_length(text), F.lower(text)
    ).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, with A to Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def lines_of(text: Column) -> Column:
    """Lines between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def two_hashes(value: Column) -> list[Column]:
    """128 bits that stand for a value: the second hash is seeded by another."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
