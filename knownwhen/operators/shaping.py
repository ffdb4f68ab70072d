"""Projections: renames, unit rules, mappings, flags, masks, conditional fills, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions.numeric import corr


def rename_strict(df: DataFrame, names: Mapping[str, str], source: str = "source") -> DataFrame:
    """Renames and keeps the old name in the column metadata; an absent column is an error."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[F.col(c).alias(names[c], metadata={source: c}) if c in names else F.col(c) for c in df.columns])


def convert_units(df: DataFrame, rules: Mapping[str, tuple[str, float | Column]]) -> DataFrame:
    """``new -> (old, factor)``: the old column times a constant or a Column factor."""
    return df.withColumns({new: F.col(old) * (f if isinstance(f, Column) else F.lit(float(f)))
                           for new, (old, f) in rules.items()})


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str], name: str, strict: bool = True) -> DataFrame:
    """Dictionary look-up; with ``strict`` an unknown non-null key fails the job when it is read."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.create_map(*pairs)[F.col(column)]
    if strict:
        text = F.concat(F.lit(f"no mapping for {column} = "), F.col(column))
        found = F.when(F.col(column).isNotNull() & found.isNull(), F.raise_error(text).cast("string")).otherwise(found)
    return df.withColumn(name, found)


def flag(df: DataFrame, name: str, pred: Column) -> DataFrame:
    """Never-null boolean flag."""
    return df.withColumn(name, F.coalesce(pred, F.lit(False)))


def flag_and_null(df: DataFrame, column: str, pred: Column, name: str) -> DataFrame:
    """Flags the rows that fail and removes their value."""
    hit = F.coalesce(pred, F.lit(False))
    return df.withColumns({name: hit, column: F.when(~hit, F.col(column))})


def mask_by_flags(df: DataFrame, links: Mapping[str, Sequence[str]]) -> DataFrame:
    """``column -> flags``: NULL where any flag is set."""
    cols = {}
    for c, flags in links.items():
        hit = F.lit(False)
        for f in flags:
            hit = hit | F.coalesce(F.col(f).cast("boolean"), F.lit(False))
        cols[c] = F.when(~hit, F.col(c))
    return df.withColumns(cols)


def link_flags(columns: Sequence[str], rules: Mapping[str, str]) -> dict[str, list[str]]:
    """``flag -> regex`` to ``column -> flags`` for :func:`mask_by_flags`."""
    import re

    out: dict[str, list[str]] = {}
    for f, pattern in rules.items():
        for c in columns:
            if re.search(pattern, c):
                out.setdefault(c, []).append(f)
    return out


def xor_zero(df: DataFrame, a: str, b: str) -> DataFrame:
    """Where exactly one of two complementary columns is missing, it is 0."""
    one = F.col(a).isNull() != F.col(b).isNull()
    return df.withColumns({c: F.when(one & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in (a, b)})


def null_unless(df: DataFrame, column: str, pred: Column) -> DataFrame:
    return df.withColumn(column, F.when(F.coalesce(pred, F.lit(False)), F.col(column)))


def zero_if(df: DataFrame, column: str, pred: Column) -> DataFrame:
    """Missing values become 0 where the predicate shows that the quantity existed."""
    return df.withColumn(column, F.when(F.col(column).isNull() & F.coalesce(pred, F.lit(False)), F.lit(0.0))
                         .otherwise(F.col(column)))


def prune_columns(df: DataFrame, cols: Sequence[str], max_missing: float = 0.2, min_distinct: int = 3,
                  max_corr: float = 0.8) -> list[str]:
    """Columns worth keeping: enough values, enough variation, not a near copy of an earlier one (see ``wide.column_report``)."""
    from .wide import column_report

    report = column_report(df, cols, max_missing, min_distinct, max_corr)
    return [r["column"] for r in report.where("kept").orderBy("position").collect()]


def union_all(frames: Sequence[DataFrame], label: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Union by name; columns missing on a side become NULL."""
    parts = [f.withColumn(label, F.lit(n)) for f, n in zip(frames, names)] if label else list(frames)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def join_validated(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                   one_to_one: bool = False) -> DataFrame:
    """Join whose right side must be unique on the key (and the left too for one-to-one).

    The check is part of the plan: a repeated key fails the job when it is read, so there is no
    extra pass and no row is dropped or multiplied.
    """

    def unique(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in on]
        many = F.raise_error(F.concat(F.lit(f"{side} key is not unique: "), F.to_json(F.struct(*on))))
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_kw_n"), *[F.any_value(c).alias(c) for c in others]) \
            .where(F.when(F.col("_kw_n") > 1, many.cast("boolean")).otherwise(F.lit(True))).drop("_kw_n")

    if one_to_one:
        left = unique(left, "left").select(*left.columns)
    return left.transform(match, unique(right, "right"), list(on), how)


def flag_exists(left: DataFrame, right: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Boolean: the key occurs in the other table."""
    keys = right.select(*on).distinct().withColumn(name, F.lit(True))
    return left.transform(match, keys, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def prefer_new(new: DataFrame, old: DataFrame, by: Sequence[str]) -> DataFrame:
    """All of ``new``, plus the part of ``old`` whose key (for instance the local day) is absent there."""
    return new.unionByName(old.transform(match, new.select(*by).distinct(), list(by), "left_anti"), allowMissingColumns=True)


def assemble(tables: Mapping[str, DataFrame], key: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """Column-wise full join of many tables on one key, by stacking and one grouped pass.

    All tables are stacked and regrouped, so the number of shuffles does not grow with the
    number of tables. A column in two tables is an error unless it is listed in ``shared``,
    in which case the first table that has a value wins. A key that repeats inside one table fails the job.
    """
    origin: dict[str, list[str]] = {}
    for t, df in tables.items():
        for c in df.columns:
            if c not in key:
                origin.setdefault(c, []).append(t)
    clash = {c: ts for c, ts in origin.items() if len(ts) > 1 and c not in shared}
    if clash:
        raise ValueError(f"columns in more than one table: {clash}")
    order = {t: i for i, t in enumerate(tables)}
    stacked = union_all([df.withColumn("_kw_table", F.lit(order[t])) for t, df in tables.items()])
    aggs = []
    for c, ts in origin.items():
        present = F.when(F.col(c).isNotNull(), F.col("_kw_table"))
        aggs.append((F.min_by(c, present) if len(ts) > 1 else F.first(c, ignorenulls=True)).alias(c))
    repeated = [F.count_if(F.col("_kw_table") == i).alias(f"_kw_n_{i}") for i in order.values()]
    out = stacked.groupBy(*key).agg(*aggs, *repeated)
    many = F.raise_error(F.concat(F.lit("key repeats inside one table: "), F.to_json(F.struct(*key)))).cast("boolean")
    return out.where(F.when(F.greatest(*[F.col(f"_kw_n_{i}") for i in order.values()], F.lit(0)) > 1, many).otherwise(F.lit(True))).select(*key, *origin)


def within(df: DataFrame, by: Sequence[str], cols: Sequence[str], how: str = "demean", suffix: str = "__w") -> DataFrame:
    """Removes group means (``demean``) or standardises (``zscore``) via group aggregates.

    Group statistics are aggregated map-side and joined back, so a very large group is never
    gathered as it would be by a window without order.
    """
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_kw_m_{c}") for c in cols],
                                *[F.stddev_samp(c).alias(f"_kw_s_{c}") for c in cols])
    keys = stats.select(F.struct(*by).alias("_kw_g"), *[c for c in stats.columns if c not in by])
    out = df.withColumn("_kw_k", F.struct(*by)).join(keys, F.col("_kw_k") == F.col("_kw_g"))
    new = {}
    for c in cols:
        centred = F.col(c) - F.col(f"_kw_m_{c}")
        new[c + suffix] = centred if how == "demean" else centred / F.nullif(F.col(f"_kw_s_{c}"), F.lit(0.0))
    return out.withColumns(new).select(*df.columns, *new)


def changes(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], chunk: str | int = "1 day",
            suffix: str = "__diff") -> DataFrame:
    """Difference to the previous row of the series."""
    from .ordered import previous

    rows = previous(df, by, order, {f"_kw_p_{c}": c for c in cols}, chunk=chunk)
    return rows.withColumns({c + suffix: F.col(c) - F.col(f"_kw_p_{c}") for c in cols}).drop(*[f"_kw_p_{c}" for c in cols])


def dense_rank_of(df: DataFrame, by: Sequence[str], label: str, name: str) -> DataFrame:
    """Dense rank of the distinct labels of a key; rows of one label are counted once."""
    labels = df.select(*by, label).distinct()
    ranked = labels.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(label)))
    return df.transform(match, ranked, [*by, label])
