"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, uniform, written

PART = 8.0  # largest mean of one Poisson draw; larger rates are sums of independent draws
STEPS = 64  # the chance of more copies in one such draw is below the resolution of a hashed uniform


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, *, text: str = "text", source: str = "source", temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """-> one row per source: (source, size, rate, draws, cdf). ``rate`` is the mean number of copies of its documents.

    ``size`` counts code points. Target shares are ``weights`` (sources not named there get nothing), or by default proportional to
    ``size ** temperature``; the mixture is meant to hold ``epochs`` times the input. A null source is a source; a source whose
    texts are all empty has no share to reach, so its rate is ``epochs``. ``cdf`` are the cumulated probabilities of a Poisson
    draw with mean ``rate / draws``.
    """
    size = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.col(text)).cast("long")).alias("size")).select("source", F.coalesce("size", F.lit(0)).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = written(size.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))))
    total = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    rate = (F.when(F.col("size") == 0, F.lit(float(epochs))).when(F.col("weights") == 0, F.lit(0.0))
            .otherwise(F.col("weight") / F.col("weights") * F.col("sizes") * F.lit(float(epochs)) / F.col("size")))
    mean = F.col("rate") / F.col("draws")
    start = F.exp(-mean)
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), F.concat(s["a"], F.array(s["c"] + s["p"] * mean / k)).alias("a"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("a")), step)["a"]
    return (weighed.join(F.broadcast(total)).withColumn("rate", rate).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
            .select("source", "size", "rate", "draws", cdf.alias("cdf")))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, *, text: str = "text", source: str = "source", id: str = "doc_id",
              temperature: float = 0.5, epochs: float = 1.0, seed: int = 0, shuffle: bool = True, small: int = 50_000) -> DataFrame:
    """Each row of ``docs`` as often as its Poisson draw says, with ``copy`` (from 0) and ``shuffle_key``; globally shuffled.

    The draw inverts the Poisson distribution with the source's rate at a uniform number hashed from seed and id: the same
    input gives the same mixture on any cluster, rows with equal ids are drawn alike, a null id counts as one id. Columns
    named ``copy`` or ``shuffle_key`` are replaced. Rates go to the rows by broadcast while there are at most
    ``small`` sources; beyond, by a join whose source keys are salted, so a source that holds a third of all rows is
    spread. The shuffle deals rows to partitions by a hash of seed, id and copy and orders them by it.
    """
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    table = written(rates(docs, weights, text=text, source=source, temperature=temperature, epochs=epochs)).select(F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf"))
    rows = docs.select(*kept)
    if table.count() <= small:
        rated = rows.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("__source")))
    else:
        spread = 64
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(spread)))
        copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        rated = salted.join(copies, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__part")
    draw = lambda j: F.size(F.filter("__cdf", lambda c: c <= uniform(seed, "draw", j, F.col(id))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda total, j: total + draw(j))
    drawn = (rated.withColumn("__n", F.when(F.col("__draws") == 1, draw(F.lit(1))).otherwise(count)).where("__n > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
             .select(*kept, "copy", (uniform(seed, "place", F.col(id), F.col("copy")) * F.lit(2.0**52)).cast("long").alias("shuffle_key")))
    return drawn.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key") if shuffle else drawn


def hashed(*parts: str) -> str:
    """The uniform of ``common.uniform`` in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("op4_source_mixing", f"""WITH s AS (SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(size::DOUBLE)) AS w, sum(size)::DOUBLE AS n FROM s),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE sqrt(size::DOUBLE) / w * n / size END AS rate FROM s, t),
p AS (SELECT source, rate, greatest(1, ceil(rate / 8))::INT AS draws FROM r),
c AS (SELECT source, draws, list_transform(range(0, 65), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate / draws) - rate / draws - lgamma(i + 1))))) AS cdf FROM p),
d AS (SELECT doc_id, d.source, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda x: x <= {hashed("'0'", "'draw'", "j::VARCHAR", "doc_id::VARCHAR")}))))::BIGINT AS n
      FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
e AS (SELECT doc_id, source, unnest(range(0, n)) AS copy FROM d WHERE n > 0)
SELECT doc_id, source, copy, ({hashed("'0'", "'place'", "doc_id::VARCHAR", "copy::VARCHAR")} * 4503599627370496)::BIGINT AS shuffle_key FROM e""")
def op4(t):
    return replicate(t("documents")).select("doc_id", "source", "copy", "shuffle_key")
