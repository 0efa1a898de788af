r"""N-Triples files to triples and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkedframe.functions import terms as T

# Possessive: a repeated group that may give back is matched by recursion, a call for each character of a long literal.
_SUBJECT = r"(<[^<>\s]*>|_:[^\s<>\"]+)"
_PROPERTY = r"(<[^<>\s]*>)"
_OBJECT = r"(<[^<>\s]*>|_:[^\s<>\"]+|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*+|\^\^<[^<>\s]*>)?)"
LINE = rf"^\s*{_SUBJECT}\s+{_PROPERTY}\s+{_OBJECT}\s*\.\s*$"

MODES = ("failfast", "dropmalformed", "permissive")


def canonical(o: str) -> F.Column:
    """A term with literals written by one set of escapes and language tags in lower case."""
    c = F.col(o)
    literal = T.to_n3(F.lit("literal"), T.term_value(c), T.term_lang(c), T.term_datatype(c))
    return F.when(c.startswith('"'), literal).when(c.startswith("<"), T.unescape_unicode(c)).otherwise(c)


def parse_lines(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Lines (seq, value) to triples (seq, s, p, o), in permissive mode also ``_corrupt`` with each malformed line.

    Blank lines and comments are no triples in any mode; ``failfast`` raises on another malformed line.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    value = F.col("value")
    rows = lines.where(~value.rlike(r"^\s*(#.*)?$"))
    good = value.rlike(LINE)
    parts = {c: F.when(good, F.regexp_extract(value, LINE, i)) for i, c in enumerate(("s", "p", "o"), 1)}
    if mode == "failfast":
        parts["s"] = F.when(good, parts["s"]).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), value)))
    elif mode == "dropmalformed":
        rows = rows.where(good)
    out = rows.select("seq", *[c.alias(n) for n, c in parts.items()], F.when(~good, value).alias("_corrupt"))
    kept = ["seq", canonical("s").alias("s"), canonical("p").alias("p"), canonical("o").alias("o")]
    return out.select(*kept, "_corrupt") if mode == "permissive" else out.select(*kept)


def read_ntriples(spark: SparkSession, path: str | list[str], mode: str = "failfast") -> DataFrame:
    """Triples of N-Triples files, plain or gzipped by suffix.

    ``seq`` orders lines as the files have them, files by path: (path, start of the split, number in the split).  A
    gzipped file is read by one task; the triples are dealt out behind the parse when they are next shuffled.
    """
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("seq"), "value"
    )
    return parse_lines(lines, mode)


def as_lines(triples: DataFrame) -> DataFrame:
    """One column ``value``: the N-Triples line of each triple."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, compression: str = "gzip") -> None:
    as_lines(triples).write.mode("overwrite").option("compression", compression).text(path)
