"""Ridge-logistic models of several folds and feature blocks, fitted together.

A pass over the rows gives, for every model, the penalised log loss, its gradient and its curvature at the model's current coefficients;
tasks return one row of sums per model, Spark adds them, and the step is solved on these small matrices. A model whose loss rose goes back
half a step instead. So one pass serves all models, and their number of passes is that of the slowest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import quantiles

STEPS = 40


def _moments(rows: DataFrame, folds: Sequence, xs: Sequence[str], trains) -> dict:
    """Per held-out fold (number of training rows, positives, medians, means, deviations); deviations of 0 count as 1."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_kw_y").alias("pos")]
    aggs += [a for i, x in enumerate(xs) for a in (F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"))]
    per = {r["_kw_f"]: r for r in rows.groupBy("_kw_f").agg(*aggs).collect()}  # one row per fold
    out = {}
    for f in folds:
        own = [per[g] for g in folds if g in per and trains(g, f)]
        n = sum(r["n"] for r in own)
        if not n:
            continue
        known = np.array([[r[f"c{i}"] for i in range(len(xs))] for r in own], float)
        mean = np.array([[r[f"m{i}"] or 0.0 for i in range(len(xs))] for r in own])
        var = np.array([[r[f"v{i}"] or 0.0 for i in range(len(xs))] for r in own])
        out[f] = {"n": n, "pos": sum(r["pos"] for r in own), "known": known.sum(0), "parts": (known, mean, var), "median": np.zeros(len(xs))}
    for i, x in enumerate(xs):
        if any(m["known"][i] < m["n"] for m in out.values()):
            copies = rows.where(F.col(x).isNotNull()).withColumn("_kw_out", F.explode(F.array(*[F.lit(f) for f in out])))
            copies = copies.where(trains(F.col("_kw_f"), F.col("_kw_out")))
            for r in quantiles(copies, ["_kw_out"], x, {"m": 0.5}).collect():  # one row per fold
                out[r["_kw_out"]]["median"][i] = r["m"]
    for m in out.values():  # moments of the filled columns: the missing rows are one more part, all at the median
        known, mean, var = (np.vstack([p, extra]) for p, extra in zip(m["parts"], (m["n"] - m["known"], m["median"], np.zeros(len(xs)))))
        m["mean"] = (known * mean).sum(0) / m["n"]
        sd = np.sqrt((known * (var + (mean - m["mean"]) ** 2)).sum(0) / max(m["n"] - 1, 1))
        m["sd"] = np.where(sd > 0, sd, 1.0)
    return out


def _pass(rows: DataFrame, xs: Sequence[str], moments: dict, models: list[dict], bound: float, earlier: bool) -> dict[int, np.ndarray]:
    """Sums of every open model: log loss, gradient, curvature (flattened)."""
    jobs = [(k, m["fold"], m["columns"], m["try"]) for k, m in enumerate(models) if not m["done"]]
    scale = {f: (moments[f]["median"], moments[f]["mean"], moments[f]["sd"]) for f in {j[1] for j in jobs}}
    names = list(xs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            f, y = batch.column("_kw_f").to_numpy(), batch.column("_kw_y").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)
            z = {}
            for k, out, columns, beta in jobs:
                if out not in z:
                    median, mean, sd = scale[out]
                    own = f < out if earlier else f != out
                    z[out] = np.clip((np.where(np.isnan(x[own]), median, x[own]) - mean) / sd, -bound, bound), y[own]
                a, t = np.column_stack([np.ones(len(z[out][1])), z[out][0][:, columns]]), z[out][1]
                eta = a @ beta
                p = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
                loss = np.sum(np.logaddexp(0, eta) - t * eta)
                part = np.r_[loss, a.T @ (p - t), ((a * (p * (1 - p))[:, None]).T @ a).ravel()]
                sums[k] = sums.get(k, 0) + part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["model", "s"])

    parts = rows.mapInArrow(run, "model int, s array<double>").select("model", F.posexplode("s").alias("i", "v"))
    cells = parts.groupBy("model", "i").agg(F.sum("v").alias("v")).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
    return {r["model"]: np.array([c["v"] for c in r["s"]]) for r in cells.collect()}  # one row of sums per model


def cross_logit(df: DataFrame, fold: str, y: str, blocks: Mapping[str, Sequence[str]], penalty: float, *, earlier: bool = False,
                bound: float = 6.0, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Nested models, one per block (each with the columns of the blocks before it), for every fold from the other folds, or from
    the ``earlier`` ones.

    Returns (``df`` with ``p_<block>``, fits). Features are filled with the median of the training rows, standardised, clipped to ``bound`` deviations and
    penalised by ``penalty / 2`` times the sum of squared coefficients, the intercept excepted. The fits hold a row per (fold, model, feature, "" for the
    intercept): coef (per standard deviation), odds_ratio, z, score (the penalised score equation at the solution, near 0), n_train and
    positives. Rows without outcome train nothing but are scored; a fold without training rows of both outcomes gets NULL. Folds, models and features are few: their
    product is what reaches the driver.
    """
    xs = list(dict.fromkeys(c for block in blocks.values() for c in block))
    rows = cut_lineage(df.where(F.col(y).isNotNull() & F.col(fold).isNotNull()).select(F.col(fold).cast("long").alias("_kw_f"), F.col(y).cast("double").alias("_kw_y"), *[F.col(c).cast("double").alias(c) for c in xs]))
    spark = df.sparkSession
    folds = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(F.col(fold).cast("long")).distinct().collect())
    trains = (lambda g, out: g < out) if earlier else (lambda g, out: g != out)
    moments = {f: m for f, m in _moments(rows, folds, xs, trains).items() if 0 < m["pos"] < m["n"]}
    models: list[dict] = []
    for f, m in moments.items():
        used: list[str] = []
        for name, block in blocks.items():
            used = list(dict.fromkeys([*used, *block]))
            start = np.zeros(len(used) + 1)
            start[0] = math.log(m["pos"] / (m["n"] - m["pos"]))
            models.append({"fold": f, "name": name, "features": used, "columns": [xs.index(c) for c in used], "best": None, "try": start, "loss": math.inf, "done": False})
    for _ in range(STEPS):
        if all(m["done"] for m in models):
            break
        for k, s in _pass(rows, xs, moments, models, bound, earlier).items():
            m = models[k]
            size = len(m["try"])
            ridge = np.r_[0.0, np.full(size - 1, penalty)]
            loss = s[0] + 0.5 * float(ridge @ m["try"] ** 2)
            if loss > m["loss"] + 1e-12 * abs(m["loss"]):
                m["step"] = m["step"] / 2
            else:
                m["best"], m["loss"] = m["try"], loss
                m["score"] = s[1:1 + size] + ridge * m["best"]
                curvature = s[1 + size:].reshape(size, size) + np.diag(ridge) + 1e-12 * np.eye(size)
                m["spread"] = np.sqrt(np.diag(np.linalg.inv(curvature)))
                m["step"] = np.linalg.solve(curvature, m["score"])
            if np.abs(m["step"]).max() < tolerance:
                m["done"] = True
            m["try"] = m["best"] - m["step"]
    table = [(m["fold"], m["name"], c, float(b), float(math.exp(min(b, 700.0))), float(b / e), float(g), moments[m["fold"]]["n"], int(moments[m["fold"]]["pos"]))
             for m in models for c, b, e, g in zip(["", *m["features"]], m["best"], m["spread"], m["score"])]
    fits = spark.createDataFrame(table, "fold long, model string, feature string, coef double, odds_ratio double, z double, score double, n_train long, positives long")
    keys = []
    for f, m in moments.items():
        own = {k["name"]: np.r_[k["best"][0], [float(k["best"][1 + k["features"].index(c)]) if c in k["features"] else 0.0 for c in xs]].tolist() for k in models if k["fold"] == f}
        keys.append((f, m["median"].tolist(), m["mean"].tolist(), m["sd"].tolist(), *[own[name] for name in blocks]))
    arrays = ", ".join(f"{c} array<double>" for c in ("_kw_median", "_kw_mean", "_kw_sd", *[f"_kw_b{i}" for i in range(len(blocks))]))
    small = spark.createDataFrame(keys, f"_kw_fold long, {arrays}")  # one row per fold
    out = df.join(F.broadcast(small), F.col(fold).cast("long") == F.col("_kw_fold"), "left")
    z = F.array(*[F.greatest(F.least((F.coalesce(F.col(c).cast("double"), F.col("_kw_median")[i]) - F.col("_kw_mean")[i]) / F.col("_kw_sd")[i], F.lit(bound)), F.lit(-bound)) for i, c in enumerate(xs)])
    out = out.withColumn("_kw_z", z)
    for i, name in enumerate(blocks):
        b = F.col(f"_kw_b{i}")
        eta = b[0] + F.aggregate(F.zip_with(F.slice(b, 2, len(xs)), F.col("_kw_z"), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn(f"p_{name}", 1 / (1 + F.exp(-eta)))
    return out.select(*df.columns, *[f"p_{name}" for name in blocks]), fits
