"""CSV, XML and JSON landing files to typed tables; layout changes between wide and long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import timeaxis as T
from ..functions.text import NULL_TOKENS, is_null_token, number, snake


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], sep: str = ";", encoding: str = "UTF-8",
             comment: str | None = None) -> DataFrame:
    """All columns as text, the header of every file checked against the expected names."""
    schema = Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", "true").option("sep", sep).option("encoding", encoding)
    reader = reader.option("enforceSchema", "false")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(list(paths))


def cast_if_clean(df: DataFrame, columns: Sequence[str], decimal: str | None = None, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Casts a text column to DOUBLE only if every value that is not a null token parses.

    Without ``decimal`` each column is tried as plain numbers first and with a decimal comma second. One aggregate over
    all columns decides; it returns a single row.
    """
    marks = (".", ",") if decimal is None else (decimal,)
    parsed = {(c, m): number(c, m, null_tokens=tuple(null_tokens)) for c in columns for m in marks}
    seen = df.agg(*[F.count_if(~is_null_token(c, tuple(null_tokens)) & p.isNull()).alias(f"bad {m}{c}") for (c, m), p in parsed.items()],
                  *[F.count(p).alias(f"n {m}{c}") for (c, m), p in parsed.items()]).first()
    clean = {}
    for c in columns:
        fits = next((m for m in marks if seen[f"bad {m}{c}"] == 0 and seen[f"n {m}{c}"] > 0), None)
        if fits:
            clean[c] = parsed[c, fits]
    return df.withColumns(clean) if clean else df


def snake_unique(df: DataFrame) -> DataFrame:
    return df.toDF(*snake(df.columns))


def enforce_contract(df: DataFrame, contract: Mapping[str, tuple[str, str]], max_bad: int | None = None, headers: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``column -> (new name, keyword)``: the header text of the file must contain the keyword; extra columns are errors.

    ``headers`` gives the file's header text where columns were renamed on reading; otherwise the column name is it. Returns the
    renamed numeric table and the count of cells that were not numbers per column; more than ``max_bad`` of them, where given, are an error.
    """
    text = {c: (headers or {}).get(c, c) for c in df.columns}
    extra = [c for c in df.columns if c not in contract]
    missing = [c for c in contract if c not in df.columns]
    wrong = [c for c, (_, word) in contract.items() if c in df.columns and word.lower() not in text[c].lower()]
    if extra or missing or wrong:
        raise ValueError(f"header contract broken: extra {extra}, missing {missing}, wrong {wrong}")
    names = {c: n for c, (n, _) in contract.items()}
    values = df.select(*[number(c).alias(n) for c, n in names.items()])
    counts = df.agg(*[F.count_if(~is_null_token(c) & number(c).isNull()).alias(n) for c, n in names.items()])
    found = counts.first().asDict()
    if max_bad is not None and sum(found.values()) > max_bad:
        raise ValueError(f"cells that are not numbers: {({n: k for n, k in found.items() if k})}; at most {max_bad} are allowed")
    return values, df.sparkSession.createDataFrame(list(found.items()), "column string, not_numeric long")


def unpivot_hours(df: DataFrame, keys: Sequence[str], day: str, hours: Mapping[str, str], tz: str, value: str = "value") -> DataFrame:
    """Columns per delivery hour (``3A`` / ``3B`` for the repeated one) -> one row per UTC interval."""
    from ..functions.text import delivery_window

    long = df.select(*keys, day, *[F.col(c).cast("double").alias(c) for c in hours]).unpivot([*keys, day], list(hours), "_kw_col", value)
    code = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv])[F.col("_kw_col")]
    w = delivery_window(code, day, tz)
    return long.where(F.col(value).isNotNull()).select(*keys, w["start"].alias("start_utc"), w["end"].alias("end_utc"), value)


def stack_levels(df: DataFrame, keys: Sequence[str], columns: Sequence[str], names: Sequence[str], sep: str = "|", value: str = "value") -> DataFrame:
    """Columns with composite labels -> rows with one column per level."""
    long = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        list(keys), [F.col(f"`{c}`") for c in columns], "_kw_label", value)
    levels = F.split("_kw_label", "[" + sep + "]")
    return long.select(*keys, *[F.get(levels, i).alias(n) for i, n in enumerate(names)], value)


def arrays_to_rows(df: DataFrame, keys: Sequence[str], times: str, series: str) -> DataFrame:
    """``{unix_seconds: [...], series: [{name, data: [...]}]}`` -> (time, name, value) rows."""
    rows = df.select(*keys, times, F.explode(series).alias("s"))
    rows = rows.select(*keys, F.col("s.name").alias("name"), F.explode(F.arrays_zip(F.col(times).alias("t"), F.col("s.data").alias("v"))).alias("z"))
    return rows.select(*keys, F.timestamp_seconds("z.t").cast("timestamp_ntz").alias("ts"), "name", F.col("z.v").cast("double").alias("value"))


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))


def read_xml(spark: SparkSession, paths: Sequence[str], row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(list(paths))


def parse_xml(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_xml(column, schema))


def explode_points(df: DataFrame, keys: Sequence[str], start: str, end: str, resolution: Column, points: str,
                   position: str = "position", quantity: str = "quantity") -> DataFrame:
    """Nested period -> one row per point: a point lasts until the next position (or the period end).

    Points of one period are a small array, so the next position is found inside the row.
    """
    ordered = F.array_sort(F.col(points), lambda a, b: F.when(a[position] < b[position], -1).when(a[position] > b[position], 1).otherwise(0))
    rows = df.select(*keys, start, end, resolution.alias("_kw_step"), ordered.alias("_kw_pts"))
    rows = rows.select("*", F.posexplode("_kw_pts").alias("_kw_i", "_kw_p"))
    nxt = F.get(F.col("_kw_pts"), F.col("_kw_i") + 1)[position]

    def at(p: Column) -> Column:
        return T.plus(start, (p.cast("long") - 1) * F.col("_kw_step"))

    return rows.select(*keys, at(F.col("_kw_p")[position]).alias("start_utc"), F.coalesce(at(nxt), F.col(end)).alias("end_utc"),
                       F.col("_kw_p")[quantity].cast("double").alias(quantity))


# ISO 8601 resolutions of interval documents, in microseconds.
RESOLUTIONS = {"PT1M": T.MICROS["minute"], "PT15M": 15 * T.MICROS["minute"], "PT30M": 30 * T.MICROS["minute"],
               "PT60M": T.HOUR, "P1D": T.DAY, "P7D": T.MICROS["week"]}


def resolution_micros(c: str | Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RESOLUTIONS.items() for x in kv])[T.col(c)]
