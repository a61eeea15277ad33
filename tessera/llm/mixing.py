"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_names, named, table

#: Sources up to this number go to every task as one small table.
MOST_BROADCAST = 100_000
#: A larger mean is drawn as the sum of independent parts, so that exp(-mean) never vanishes.
PART = 16.0


def uniform(*key: Column) -> Column:
    """In (0, 1), from the md5 of the key's parts."""
    digits = F.substring(F.md5(F.concat_ws("/", *key).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def inverse_poisson(mean: Column, u: Column) -> Column:
    """The least k whose distribution function at `mean` (at most PART) is above u."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("below"), F.lit(0).alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["below"] + p).alias("below"), F.when(u >= s["below"], k).otherwise(s["k"]).alias("k"))

    # beyond this many terms less is left than the 48 bits of u can tell
    terms = F.when(u < first, F.lit(0)).otherwise(F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int"))
    steps = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s["k"])


def temperature_weights(counts: DataFrame, power: float) -> DataFrame:
    """Target weights in proportion to each source's rows to the power given."""
    return counts.select("source", F.pow("n", F.lit(power)).alias("weight"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    power: float = 0.7,
    expected_rows: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Documents replicated so that sources reach their target weights, in a random order.

    `weights` (source, weight); without it weights are the sources' row counts
    to the power `power`. With W the sum of the weights, n_s the rows of source
    s and N the rows wanted (as many as there are, if not given), each document
    of s comes Poisson(N * weight_s / W / n_s) times: the inverse distribution
    function at a uniform number that is hashed from seed and doc_id. The copies
    are dealt out by a hash and sorted by it within each partition, which is a
    global shuffle that is the same in each run.

    Adds `copy` (from 1) and `shuffle_key`. Null source is a source like any
    other; null doc_id draws by the text's hash. Rows that repeat a doc_id draw
    the same number. Sources without a weight, or with one that is null or not
    above 0, give no rows; of a source's several weights the sum counts. An
    empty table gives no rows; further columns stay, whatever their names, but
    those named copy or shuffle_key are replaced.
    """
    counts = cut(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    weights = temperature_weights(counts, power) if weights is None else weights.select("source", "weight")
    # doubles added in any order differ; rounded they do not
    weights = weights.filter("weight > 0").groupBy(F.col("source").alias("of_source")).agg(F.sum(F.col("weight").cast("decimal(38,9)")).alias("weight"))
    sums = counts.join(weights, F.col("source").eqNullSafe(F.col("of_source"))).select("of_source", "n", F.col("weight").cast("decimal(38,9)").alias("weight"))
    w = sums.agg(F.sum("weight")).first()[0]
    rows, sources = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    wanted = float(expected_rows if expected_rows is not None else rows or 0)
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    of_source, rate, times = free_names([*names, "copy", "shuffle_key"], "of_source", "rate", "times")
    rates = sums.select(F.col("of_source").alias(of_source), (F.lit(wanted) * F.col("weight").cast("double") / F.lit(float(w or 1)) / F.col("n")).alias(rate))
    if sources <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    parts = F.greatest(F.ceil(F.col(rate) / PART), F.lit(1)).cast("int")
    draws = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda n, i: n + inverse_poisson(F.col(rate) / parts, uniform(F.lit(str(seed)), key, i.cast("string"))),
    )
    kept = [named(c) for c in names]
    drawn = (
        docs.select(*kept)
        .join(rates, F.col("source").eqNullSafe(F.col(of_source)))
        .withColumn(times, draws)
        .filter(F.col(times) > 0)
        .select(*kept, F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy"))
    )
    order = F.md5(F.concat_ws("/", F.lit(f"order{seed}"), key, F.col("copy").cast("string")).cast("binary"))
    dealt = drawn.withColumn("shuffle_key", F.substring(order, 1, 16))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op9_poisson_mix": op9_poisson_mix}

SQL = {
    "op9_poisson_mix": """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, n, CAST(pow(n, 0.7) AS DECIMAL(38, 9)) AS weight FROM counts),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * weight::DOUBLE / (SELECT sum(weight) FROM weights)::DOUBLE / n AS rate
  FROM weights
),
steps AS (
  SELECT source, rate / greatest(ceil(rate / 16.0), 1) AS mean, greatest(ceil(rate / 16.0), 1)::INT AS parts, 0 AS k,
         exp(-(rate / greatest(ceil(rate / 16.0), 1))) AS p, exp(-(rate / greatest(ceil(rate / 16.0), 1))) AS below
  FROM rates
  UNION ALL
  SELECT source, mean, parts, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 10 * sqrt(mean) + 20)
),
draws AS (
  SELECT d.doc_id, d.source, i.i,
         (('0x' || substr(md5('42/' || d.doc_id || '/' || i.i), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents d JOIN (SELECT DISTINCT source, parts FROM steps) s ON d.source = s.source
  JOIN (SELECT unnest(range(1, 65)) AS i) i ON i.i <= s.parts
),
times AS (
  SELECT doc_id, sum(k) AS times FROM (
    SELECT w.doc_id, w.i, min(s.k) AS k FROM draws w JOIN steps s ON w.source = s.source AND s.below > w.u GROUP BY w.doc_id, w.i
  ) GROUP BY doc_id
)
SELECT d.*, c.copy::INT AS copy, substr(md5('order42/' || d.doc_id || '/' || c.copy), 1, 16) AS shuffle_key
FROM documents d JOIN times t ON d.doc_id = t.doc_id
JOIN (SELECT unnest(range(1, 1001)) AS copy) c ON c.copy <= t.times
"""
}
