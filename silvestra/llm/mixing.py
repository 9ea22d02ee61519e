"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row's key is -ln(u) / w, where u is uniform in (0, 1) from a hash of doc_id and the seed, and w
the row's quality weight. A source's token budget holds so many complete epochs of the source, each
with all its rows; what is left selects rows by ascending key while their running sum of tokens
stays within it.

The running sum needs no sort of a whole source: keys fall into ``BUCKETS`` ordered buckets a source,
whose totals are summed first, and only the bucket in which the budget ends is sorted.

Defined results: tokens are runs of non-space characters; a row without any (null or empty text) is
left out; a null source is a source of its own; a null weight counts as 1; a weight of 0 or less
comes last in the order; rows equal in key, doc_id and tokens go together, so repeated rows are all
selected or none; a source without a target (or one of 0 or less) has no budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, table

SEED, BUCKETS, POWER = 17, 1024, 0.5
_WORD = r"[^\t\n\f\r ]+"


def _tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")


def _key(seed: int, weight: Column) -> Column:
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    u = (digits.cast("double") + 0.5) / float(1 << 52)
    weight = F.coalesce(weight, F.lit(1.0))
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _bucket(key: Column) -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-key)) * BUCKETS)).cast("int")


def _plan(rows: DataFrame, targets: dict[str, float] | None, budget: float) -> DataFrame:
    """For each source: epochs, the bucket in which the budget ends, and the last row taken there."""
    parts = kept(rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")))
    sums = parts.groupBy("source").agg(F.sum("n").alias("total"))
    if targets is None:
        share = F.pow(F.col("total").cast("double"), F.lit(POWER))
    else:
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.greatest(F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)), F.lit(0.0)) if pairs else F.lit(0.0)
    sums = sums.withColumn("share", share)
    whole = sums.agg(F.sum("total").alias("all_tokens"), F.sum("share").alias("all_shares"))
    sums = sums.crossJoin(F.broadcast(whole)).withColumn("budget", F.when(F.col("all_shares") > 0, F.floor(F.lit(float(budget)) * F.col("all_tokens") * F.col("share") / F.col("all_shares"))).otherwise(0).cast("long"))
    sums = sums.select(F.col("source").alias("src"), F.expr("budget div total").cast("long").alias("epochs"), (F.col("budget") % F.col("total")).alias("rest"))
    run = F.sum("n").over(W.partitionBy("source").orderBy("bucket"))
    ends = parts.withColumn("upto", run).join(sums, F.col("source").eqNullSafe(F.col("src"))).where("upto > rest").groupBy("src", "epochs", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    ends = kept(ends.select("src", "epochs", "rest", F.col("end.bucket").alias("last_bucket"), F.col("end.before").alias("before")))
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("last_bucket")))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy("src").orderBy("key", "doc_id", "n_tokens"))).where("upto <= rest")
    last = inside.groupBy(F.col("src").alias("of")).agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "n_tokens")).alias("last"))
    return ends.join(last, F.col("src").eqNullSafe(F.col("of")), "left").select("src", "epochs", "last_bucket", "last")


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    own = F.struct(F.col("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("n_tokens"))
    chosen = (F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & F.coalesce(own <= F.col("last"), F.lit(False)))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("src"))).withColumn("copies", F.col("epochs") + chosen.cast("long")).where("copies > 0")


def _narrow(docs: DataFrame, weight: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _tokens().alias("n_tokens"), weight.cast("double").alias("weight"))


def _rows(narrow: DataFrame, seed: int) -> DataFrame:
    rows = narrow.where("n_tokens > 0").select("doc_id", "source", "n_tokens", _key(seed, F.col("weight")).alias("key"))
    return rows.withColumn("bucket", _bucket(F.col("key")))


def mixture(docs: DataFrame, weight: Column, targets: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, copies of every row taken at least once.

    ``targets`` gives each source's weight, or where None each weighs its tokens to the power
    ``POWER``; ``budget`` is in multiples of the corpus's tokens.
    """
    return _mixture(_narrow(docs, weight), targets, budget, seed)


def _mixture(narrow: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    rows = kept(_rows(narrow, seed))
    return _copies(rows, _plan(rows, targets, budget)).select("doc_id", "source", "n_tokens", "copies")


def mixed(docs: DataFrame, weight: Column, targets: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows themselves, each as often as it is taken; the text is never exchanged."""
    plan = kept(_plan(kept(_rows(_narrow(docs, weight), seed)), targets, budget))
    kinds = {f.name: f for f in docs.schema.fields}
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kinds]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", _tokens().alias("n_tokens"), _key(seed, weight).alias("key")).where("n_tokens > 0")
    taken = _copies(row.withColumn("bucket", _bucket(F.col("key"))), plan)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and the quality label's weight: 2 for good, 0.5 for bad, 1 where unknown.

    Texts are counted before the join, so that it exchanges numbers alone.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") > 0, 2.0).when(F.col("quality") <= 0, 0.5).otherwise(1.0)
    return _narrow(docs, F.lit(1.0)).join(known, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "source", "n_tokens", weight.alias("weight"))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return _mixture(with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP5_SQL = f"""
WITH l AS (SELECT doc_id, max(quality) q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
r AS (SELECT d.doc_id, source, CAST(len(regexp_extract_all(text, '[^\\t\\n\\f\\r ]+')) AS BIGINT) n, CASE WHEN q > 0 THEN 2.0 WHEN q <= 0 THEN 0.5 ELSE 1.0 END::DOUBLE w
      FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS key FROM r WHERE n > 0),
t AS (SELECT source, sum(n) total, pow(sum(n)::DOUBLE, {POWER}) share FROM k GROUP BY source),
b AS (SELECT source, CAST(total AS BIGINT) total, CAST(floor(sum(total) OVER () * share / sum(share) OVER ()) AS BIGINT) budget FROM t),
s AS (SELECT k.*, budget // total epochs, budget % total rest, sum(n) OVER (PARTITION BY k.source ORDER BY key, doc_id, n) upto FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, n AS n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
