"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a share of all words in proportion to its weight, but at most
``max_epochs`` times its own size; what is above goes to the others. A source's target is
made of complete epochs of all its documents, and of a fraction of one more. The documents
of that fraction come in the order of exponential keys ``-ln(u) / quality``, where ``u`` is
a hash of the id: by Efraimidis and Spirakis this draws documents without replacement with
probabilities proportional to their quality. Their sizes are summed in that order, up to
the budget.

A source may hold most of the rows. Its keys are therefore dealt to buckets by size, whole
buckets are summed, and only the one bucket in which the budget ends is sorted.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agora.llm.common import let, words_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
_PREFIX = "_mix_"


def _c(name: str) -> Column:
    return F.col(_PREFIX + name)


def draw(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on nothing but id and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents with size, key and bucket in columns that begin with ``_mix_``.

    Quality is the share of distinct words: (1 + distinct words) / (1 + words).
    """
    counts = let(
        words_of(F.col("text")),
        lambda words: F.struct(
            F.size(words).cast("bigint").alias("size"),
            F.size(F.array_distinct(words)).cast("bigint").alias("distinct"),
        ),
    )
    with_counts = docs.withColumn(_PREFIX + "counts", counts)
    quality = (F.lit(1.0) + _c("counts")["distinct"]) / (F.lit(1.0) + _c("counts")["size"])
    return (
        with_counts.withColumn(_PREFIX + "size", _c("counts")["size"])
        .withColumn(_PREFIX + "key", -F.log(draw(F.col("doc_id"), seed)) / quality)
        .drop(_PREFIX + "counts")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target per source from (source, source_size): one row per source, null last.

    The shares fill like water: with level L, a source gets min(max_epochs * size, L * weight).
    Sources are sorted by the level at which they are full; the running sums before the
    first source that isn't full give L. One row per source is sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * float(max_epochs)).withColumn(
        "full_at", F.col("most") / F.col("weight")
    )
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    # The level is the one of the first source, in this order, that isn't full at it.
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return levels.withColumn("reached", level).select(
        "source",
        "source_size",
        F.least(F.col("most"), F.coalesce(F.col("reached") * F.col("weight"), F.col("most"))).alias("target"),
    )


def plan_of(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, buckets: int) -> DataFrame:
    """Per (source, bucket): target, epochs, budget of the fraction, words in buckets before."""
    per_bucket = rows.groupBy(F.col("source"), _bucket(buckets).alias("bucket")).agg(F.sum(_c("size")).alias("words"))
    per_source = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(per_source, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)))
    targets = targets.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("bigint")).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_bucket.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    joined = placed.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    return joined.select(
        F.col("b.source").alias("p_source"),
        F.col("b.bucket").alias("p_bucket"),
        F.col("before").alias("p_before"),
        F.col("words").alias("p_words"),
        F.col("source_size").alias("p_size"),
        F.col("target").alias("p_target"),
        F.col("epochs").alias("p_epochs"),
        F.col("budget").alias("p_budget"),
    )


def _bucket(buckets: int) -> Column:
    return F.least(F.floor((F.lit(1.0) - F.exp(-_c("key"))) * buckets), F.lit(buckets - 1)).cast("int")


def mix(
    rows: DataFrame,
    slim: DataFrame | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The documents with ``size, source_size, target, taken``; ``taken / size`` is the number of copies.

    ``rows`` come from :func:`sized`; ``slim`` may hold the same rows without their texts,
    for the sums. A column ``copies`` gives the number of times the mix takes the document,
    also for documents without words.

    A null source is a source of its own, last in order. Rows without text have size 0 and
    are taken with 0 words. Documents with equal keys, which takes equal ids, come in the
    order of their sizes. No rows give no rows. Other columns are kept; input columns named
    as a computed one are replaced.
    """
    slim = rows if slim is None else slim
    parts = plan_of(slim, weights, max_epochs, buckets)
    rows = rows.drop("size", "source_size", "target", "taken", "copies")
    placed = rows.withColumn(_PREFIX + "bucket", _bucket(buckets)).join(
        parts, F.col("source").eqNullSafe(F.col("p_source")) & (_c("bucket") == F.col("p_bucket"))
    )
    last = F.col("p_before") + F.col("p_words") > F.col("p_budget")
    split = last & (F.col("p_before") <= F.col("p_budget"))
    whole = placed.where(~split).withColumn(_PREFIX + "extra", F.when(~last, 1).otherwise(0))
    in_order = Window.partitionBy("p_source").orderBy(_c("key"), F.col("doc_id"), _c("size"))
    earlier = F.coalesce(F.sum(_c("size")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The prefix that ends nearest to the budget: a document goes in if its middle lies before it.
    parted = placed.where(split).withColumn(
        _PREFIX + "extra", F.when(F.col("p_before") + earlier + _c("size") / 2.0 <= F.col("p_budget"), 1).otherwise(0)
    )
    copies = (F.col("p_epochs") + _c("extra")).cast("bigint")
    kept = [c for c in rows.columns if not c.startswith(_PREFIX)]
    return whole.unionByName(parted).select(
        *kept,
        _c("size").alias("size"),
        F.col("p_size").alias("source_size"),
        F.col("p_target").alias("target"),
        copies.alias("copies"),
        (copies * _c("size")).alias("taken"),
    )


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """One row per copy that the mix takes, with the documents' own columns; cases as in :func:`mix`."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    mixed = mix(sized(packed).drop("text"), **options).where(F.col("copies") > 0)
    return mixed.select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_doc.*")
