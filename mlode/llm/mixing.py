"""Operator 9: mixing sources to target weights by Poisson replication.

Each document gets a copy count drawn by inverting the Poisson distribution
function at a uniform number hashed from (seed, document id). The mean is the
source's target repetition rate: target weight x all rows / rows of the source.
A Poisson mean above ``MOST_MEAN`` is split in equal parts with a uniform number
each (a sum of Poisson counts is Poisson), so that exp(-mean) stays in range.
The copies are then dealt out by a hash of (seed, id, copy) and sorted by it
within each partition: a global shuffle, where no source or document is a key.

Nulls: a null source is a source of its own; a null id counts as the text
"null"; other null columns pass through. Rows with equal ids get equal counts.
An empty table gives an empty table. The new columns are named by ``names``; an input column of such a
name is replaced.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm.common import free_name, id_hash, table

MOST_MEAN = 300.0
#: Sources whose rates are sent to every task; with more, the rates come by a salted join.
MOST_SOURCES = 10_000
SALTS = 64
#: Production parameters: weights are row shares to this power, normalised.
TEMPERATURE = 0.5
SEED = 20240


def _source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source key, rate): rows of the target mixture per row of the source. Sources without a given weight get none."""
    counts = docs.groupBy(_source_key(F.col(source)).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [(("n" if k is None else f"s{k}"), float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(pairs, "_key string, _w double") if pairs else docs.sparkSession.createDataFrame([], "_key string, _w double")
        counts = counts.join(given, "_key", "left").fillna(0.0, ["_w"])
    totals = counts.agg(F.sum("_w").alias("_all_w"), F.sum("_n").alias("_all_n"))
    return counts.crossJoin(F.broadcast(totals)).select("_key", F.when(F.col("_all_w") > 0, F.col("_w") / F.col("_all_w") * F.col("_all_n") / F.col("_n")).otherwise(0.0).alias("_rate"))


def poisson_count(uniform_of, rate: Column) -> Column:
    """The count at which the Poisson distribution function first reaches the uniform number.

    uniform_of(part) gives the uniform number of each part of a split mean."""
    parts = F.greatest(F.lit(1), F.ceil(rate / MOST_MEAN)).cast("int")
    mean = rate / parts
    steps = F.ceil(mean + 14 * F.sqrt(mean) + 30).cast("int")

    def one(part: Column) -> Column:
        u = uniform_of(part)
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("f"), F.lit(0).alias("k"))
        return F.aggregate(
            F.sequence(F.lit(1), steps),
            start,
            lambda s, i: F.when(s["f"] >= u, s).otherwise(F.struct((s["p"] * mean / i).alias("p"), (s["f"] + s["p"] * mean / i).alias("f"), i.alias("k"))),
            lambda s: s["k"],
        )

    return F.when(rate > 0, F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, x: a + x)).otherwise(0)


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED, names: tuple[str, str, str] = ("copy", "n_copies", "shuffle_key")
) -> DataFrame:
    """All columns of docs for each copy, with the copy's number (from 1), the number of copies and the shuffle key."""
    copy, n_copies, shuffle_key = names
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in [x.lower() for x in names]])
    rate, key, salt = (free_name(docs, x) for x in ("_rate", "_key", "_salt"))
    rates = source_rates(docs, source, weights, temperature).select(F.col("_key").alias(key), F.col("_rate").alias(rate))
    some = rates.limit(MOST_SOURCES + 1).collect()
    keyed = docs.withColumn(key, _source_key(F.col(source)))
    if not some:
        rated = docs.withColumn(rate, F.lit(0.0))
    elif len(some) <= MOST_SOURCES:
        small = docs.sparkSession.createDataFrame([tuple(r) for r in some], f"{key} string, {rate} double")
        rated = keyed.join(F.broadcast(small), key).drop(key)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = keyed.withColumn(salt, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int")).join(salted, [key, salt]).drop(key, salt)
    counted = rated.withColumn(n_copies, poisson_count(lambda part: id_hash(F.lit(seed), F.col(doc_id), part), F.col(rate)).cast("int")).drop(rate)
    copies = counted.filter(F.col(n_copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    dealt = copies.withColumn(shuffle_key, id_hash(F.lit(seed), F.lit("order"), F.col(doc_id), F.col(copy)))
    return dealt.repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key, doc_id, copy)


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix_sources(docs)


SQL = f"""
WITH n AS (SELECT coalesce('s' || source, 'n') AS k, count(*) AS c FROM documents GROUP BY 1),
r AS (SELECT k, pow(c, {TEMPERATURE}) / (SELECT sum(pow(c, {TEMPERATURE})) FROM n) * (SELECT sum(c) FROM n) / c AS rate FROM n),
pmf AS (SELECT k, i, exp(-rate + i * ln(rate) - lgamma(i + 1)) AS p FROM r, range(0, 400) t(i)),
cdf AS (SELECT k, i, sum(p) OVER (PARTITION BY k ORDER BY i) AS f FROM pmf),
u AS (SELECT d.*, coalesce('s' || source, 'n') AS k,
  (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52} AS u FROM documents d),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.k = u.k AND f < u.u) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
  (CAST('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52} AS shuffle_key
FROM c, range(1, n + 1) t(copy)
"""
