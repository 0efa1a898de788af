"""Ordinary tables: as triples, over JDBC with types, and by parameterised queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkedframe.functions.terms import escape_literal


@dataclass(frozen=True)
class Mapped:
    """How one column becomes triples: property URI, and the object as a URI pattern or a literal with a tag.

    ``uri`` has ``{}`` where the value goes; ``lang`` (a tag, or a column's name in ``lang_column``) and ``datatype`` are for
    literals; ``term`` says that the column holds terms already.
    """

    column: str
    prop: str
    uri: str | None = None
    lang: str | None = None
    datatype: str | None = None
    lang_column: str | None = None
    term: bool = False

    def present(self) -> Column:
        """Whether the column's value becomes an object, without making it."""
        return F.col(self.column).isNotNull() & (F.col(self.lang_column).isNotNull() if self.lang_column else F.lit(True))

    def object(self, value: Column | None = None) -> Column:
        """The object of the column's value, or of another ``value`` in its place."""
        value = (F.col(self.column) if value is None else value).cast("string")
        if self.term:
            return value
        if self.uri is not None:
            before, _, behind = self.uri.partition("{}")
            return F.concat(F.lit(f"<{before}"), value, F.lit(f"{behind}>"))
        tag = f"@{self.lang.lower()}" if self.lang else f"^^<{self.datatype}>" if self.datatype else ""
        if self.lang_column:
            return F.concat(F.lit('"'), escape_literal(value), F.lit('"@'), F.lower(self.lang_column))
        return F.concat(F.lit('"'), escape_literal(value), F.lit(f'"{tag}'))


def _subject(pattern: str | Column, value: Column | None = None) -> Column:
    if not isinstance(pattern, str):
        return pattern
    before, _, rest = pattern.partition("{")
    key, _, behind = rest.partition("}")
    return F.concat(F.lit(f"<{before}"), (F.col(key) if value is None else value).cast("string"), F.lit(f"{behind}>"))


def triplify(df: DataFrame, subject: str | Column, columns: Sequence[Mapped]) -> DataFrame:
    """(s, p, o) for each non-null mapped column.

    ``subject`` is a URI pattern ``…{column}…``, or a column of terms.  Each property is a projection of its own, so a
    filter on ``p`` leaves out the others, with their columns and tables, when the query is planned.
    """
    s = _subject(subject)
    parts = [df.select(s.alias("s"), F.lit(f"<{m.prop}>").alias("p"), m.object().alias("o")) for m in columns]
    return reduce(DataFrame.union, parts).where("s IS NOT NULL AND o IS NOT NULL")


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table brought together by their keys: each other column is the set of its values there."""
    sets = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.collect_set(c).alias(c) for c in sets]) if sets else df.distinct()


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each value of the given columns where these are the sets of :func:`by_key`; others stay as they are."""
    sets = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    for c in columns:
        rows = rows.withColumn(c, F.explode(c)) if c in sets else rows
    return rows


def triplify_once(rows: DataFrame, keys: Sequence[str], subjects: Sequence[tuple[str | Column, Sequence[Mapped]]], **further: Column) -> DataFrame:
    """The triples of several subjects of one table as by :func:`triplify`, from a single pass over its rows, each triple once.

    ``rows`` are those of :func:`by_key`, and ``further`` columns made of these.  A triple takes its subject and object from
    keys and from one set at most.  Two of a table's properties may be the same only if their subjects tell them apart.
    """
    sets = [c for c in rows.columns if c not in keys]

    def found(subject: str | Column, m: Mapped) -> Column:
        key = subject.partition("{")[2].partition("}")[0] if isinstance(subject, str) else None

        def triple(s: Column, o: Column) -> Column:
            return F.struct(s.alias("s"), F.lit(f"<{m.prop}>").alias("p"), o.alias("o"))

        if m.column in sets:
            return F.transform(m.column, lambda v: triple(_subject(subject), m.object(v)))
        if key in sets:
            return F.transform(key, lambda v: triple(_subject(subject, v), m.object()))
        return F.array(triple(_subject(subject), m.object()))

    triples = F.concat(*[found(subject, m) for subject, columns in subjects for m in columns])
    return rows.withColumns(further).select(F.explode(triples).alias("t")).select("t.*").where("s IS NOT NULL AND o IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, table: str, schema: str, key: str | None = None, bounds: tuple | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table with the given column types; with a numeric ``key`` and its bounds, read by ``parts`` tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("customSchema", schema).options(**options)
    if key:
        low, high = bounds
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


#: Keys that are sampled for each part of a balanced read.
SAMPLED = 200


def key_bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """Rows of ``keys`` that cut it, in the order of its columns, into about equal parts; from a sample of bounded size.

    Rows with nulls are not counted.  A row stands once, so there are fewer parts where few keys differ.
    """
    rows = keys.na.drop()
    n = rows.count()
    sample = rows if n <= parts * SAMPLED else rows.sample(parts * SAMPLED / n, seed=7)
    found = sorted(tuple(r) for r in sample.limit(2 * parts * SAMPLED).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)} - {found[0]}) if found else []


def _quoted(value: object) -> str:
    if isinstance(value, (bool, int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _reaches(keys: Sequence[str], bound: tuple) -> str:
    """SQL for keys, compared one after the other, at or behind a bound."""
    (key, *others), (value, *rest) = keys, bound
    if not others:
        return f"{key} >= {_quoted(value)}"
    return f"({key} > {_quoted(value)} OR {key} = {_quoted(value)} AND {_reaches(others, tuple(rest))})"


def read_jdbc_balanced(spark: SparkSession, url: str, table: str, schema: str, keys: Sequence[str], parts: int = 8, **options: str) -> DataFrame:
    """A table with the given column types, read by about ``parts`` tasks of about equal size.

    Their bounds are quantiles of a sample of the ``keys``, columns of numbers, texts or dates, so it does not matter how
    keys are spread.  A value that many rows share is cut by the further keys; rows with a null key are read by the first
    task.  Texts are compared by the database, whose order may differ from the sample's; each row is still read once.
    """
    found = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load().select(*keys)
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    names = [quote(k) for k in keys]
    marks = [_reaches(names, b) for b in key_bounds(found, parts)]
    null = " OR ".join(f"{k} IS NULL" for k in names)
    # a row belongs to the last bound that it reaches, whatever the database's order
    having = [f"NOT ({m})" for m in marks] + [""]
    conditions = [" AND ".join(filter(None, [marks[i - 1] if i else "", *having[i:-1]])) or "1 = 1" for i in range(len(marks) + 1)]
    predicates = [f"({null}) OR ({conditions[0]})" if i == 0 else f"NOT ({null}) AND {c}" for i, c in enumerate(conditions)]
    properties = {k: str(v) for k, v in options.items()} | {"customSchema": schema}
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    """Rows appended in batches."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def rows_to_table(spark: SparkSession, rows: Sequence, schema: str, path: str) -> None:
    """Typed rows appended to a Parquet table."""
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def query(spark: SparkSession, text: str, args: Sequence | Mapping | None = None, **views: DataFrame) -> DataFrame:
    """A SQL text with bound values (``?`` or ``:name``) over the given DataFrames (``{name}`` in the text)."""
    return spark.sql(text, args=args, **views) if args is not None else spark.sql(text, **views)
