"""Near-duplicate documents: b-bit MinHash with exact confirmation.

1. Every text becomes its set of word shingles, as 64-bit hashes. Documents with equal sets
   are one class from here on; a class is named by its smallest id.
2. 192 hash functions each give the minimum over a set. The first 96 form 24 bands of four;
   two classes meet if they agree in a band. At similarity 0.85 a pair misses all bands with
   probability 2e-8, at 0.8 with 3e-6.
3. The low four bits of all minima are kept, packed as four bit planes of 192 bits. The share
   of equal values, corrected for the one in sixteen that agree by chance, estimates the
   similarity of two classes by bit counts. Pairs estimated five standard errors below the
   threshold are not confirmed further.
4. The rest is confirmed on the full sets.

A bucket may hold a third of all rows, so its pairs are never listed. First every class is
paired with one centre per bucket, the member with the most company in all its buckets. The
confirmed pairs are merged to components. What remains is to find links between different
components that meet in a bucket. For these classes only, a longer signature (the low two
bits of 1024 minima) makes the estimate sharp. A condition of the join, evaluated as it reads,
drops pairs of one component, pairs whose sizes or bits rule them out, and all but the first
meeting of a pair. Large buckets are dealt to blocks first. No link between components is
lost, and links inside one add nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agora.llm.common import Memo, hashed, lower_words, mixed, shingle_hashes, stored, utf8, word_hash
from agora.llm.components import components

HASHES = 192
BANDS = 24
ROWS = 4
BITS = 4
#: The longer signature of classes in buckets that hold several components.
FINE_HASHES = 1024
FINE_BITS = 2
ERRORS = 5.0
#: Members of a bucket that are compared with each other in one block.
BLOCK = 1024
_SEED = np.uint64(0x5851F42D4C957F2D)


def _factors(number: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * number + 1, dtype=np.uint64) * _SEED)
    return numbers[::2] | np.uint64(1), numbers[1::2]


def minima(shingles: np.ndarray, number: int = HASHES) -> np.ndarray:
    """The minimum of each hash function over a set of shingle hashes, with mixed bits.

    The low bits of a product depend on few bits of the shingle, so they are mixed at last.
    """
    multiply, add = _factors(number)
    lowest = np.full(number, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 18) // number)
    for start in range(0, len(shingles), step):
        part = shingles[start : start + step]
        values = part[None, :] * multiply[:, None] + add[:, None]
        np.minimum(lowest, values.min(axis=1), out=lowest)
    return mixed(lowest)


def planes_of(lowest: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of all minima: a plane of bits after the other, in 64-bit words."""
    planes = [np.packbits(((lowest >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)).view("<i8") for bit in range(bits)]
    return np.concatenate(planes)


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the packed low bits."""
    lowest = minima(shingles)
    bands = lowest[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = mixed(keys ^ bands[:, row])
    return keys.view(np.int64), planes_of(lowest, BITS)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, bits); the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        for batch in batches:
            sizes, digests, bands, bits = [], [], [], []
            for text in utf8(batch.column(1)):
                found = np.unique(shingle_hashes(hashed(lower_words(text), memo), shingle))
                sizes.append(len(found))
                if len(found):
                    keys, planes = sketch(found)
                    digests.append(_digest(found))
                    bands.append(keys)
                    bits.append(planes)
                else:
                    digests.append(None)
                    bands.append(None)
                    bits.append(None)
            arrays = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(bits, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, bits array<bigint>"
    )


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, shingles, fine): the full set of every document, and its longer signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [np.unique(shingle_hashes(hashed(lower_words(text), memo), shingle)) for text in utf8(part.column(1))]
                arrays = [
                    part.column(0),
                    pa.array([_digest(found) for found in sets], pa.binary()),
                    pa.array([found.view(np.int64) for found in sets], pa.list_(pa.int64())),
                    pa.array([planes_of(minima(found, FINE_HASHES), FINE_BITS) for found in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "shingles", "fine"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, digest binary, shingles array<bigint>, fine array<bigint>"
    )


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def estimate(left: Column, right: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement."""
    lanes = hashes // 64
    unequal = []
    for lane in range(lanes):
        places = [F.lit(bit * lanes + lane) for bit in range(bits)]
        planes = [F.get(left, place).bitwiseXOR(F.get(right, place)) for place in places]
        unequal.append(F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), planes)))
    equal = F.lit(1.0) - reduce(lambda x, y: x + y, unequal) / float(hashes)
    chance = 2.0**-bits
    return (equal - chance) / (1.0 - chance)


def least_estimate(percent: int, hashes: int = HASHES, bits: int = BITS) -> float:
    """The estimate that pairs at the threshold reach but for ``ERRORS`` standard errors."""
    chance = 2.0**-bits
    equal = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - ERRORS * (equal * (1 - equal) / hashes) ** 0.5 / (1 - chance)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        both.withColumn("shared", shared)
        .where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared")))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``.

    Ids are integers. Links hold from ``percent`` of shared shingles upwards. A document
    without words (or text) has an empty set, links with nothing and is kept. Rows that
    repeat an id are versions of one document: it has the links of all of them, and every
    row comes out with the size of its own set. A null id takes part in no link and is kept.
    No rows give no rows; other columns are ignored.
    """
    return _judged(spark, stored(spark, sketches(docs, shingle), "sketches"), docs, shingle, percent)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates, with their own columns; cases as above.

    Of the rows that repeat an id, the first by text stays.
    """
    each = stored(spark, sketches(docs, shingle), "sketches")
    dropped = _judged(spark, each, docs, shingle, percent).where("NOT kept").select("doc_id").distinct()
    dropped = stored(spark, dropped, "dropped")
    again = each.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stored(spark, again, "repeated-ids")
    rest = docs.join(dropped, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy("text")
    versions = rest.join(again, "doc_id", "left_semi").withColumn("_version", F.row_number().over(first))
    return (
        rest.join(again, "doc_id", "left_anti")
        .unionByName(versions.where("_version = 1").drop("_version"))
        .select(*docs.columns)
    )


def _judged(spark: SparkSession, each: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    classes = stored(spark, _classes(each), "classes")
    ids = each.where("doc_id IS NOT NULL").select("doc_id", "digest")
    # Versions of one document that lie in several classes tie these together.
    versions = (
        ids.join(classes.select("digest", "rep"), "digest")
        .groupBy("doc_id")
        .agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
        .where("a <> b")
    )
    versions = ids.join(versions.select("doc_id"), "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest")
    versions = versions.select("doc_id", "rep").distinct()
    named = _linked(spark, classes, docs, shingle, percent, versions)
    of_class = classes.join(named, classes.rep == named.node, "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return each.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _classes(each: DataFrame) -> DataFrame:
    """One row per set that some id has: digest, smallest id, size, bands, bits."""
    there = each.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    return there.groupBy("digest").agg(
        F.min("doc_id").alias("rep"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    )


def _linked(
    spark: SparkSession, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, versions: DataFrame
) -> DataFrame:
    """(node, component) of the classes with links, by their smallest ids."""
    members = classes.select("rep", "bits", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(spark, members.join(sizes, "bucket"), "buckets")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    bits = members.groupBy("rep").agg(F.first("bits").alias("bits"))
    centres = (
        members.select("bucket", "rep")
        .join(company, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("company", (-F.col("rep")).alias("first"))).alias("top"))
        .select("bucket", (-F.col("top.first")).alias("centre"))
    )
    floor = least_estimate(percent)
    stars = (
        members.select("bucket", "rep", F.col("bits").alias("bits_b"))
        .join(centres, "bucket")
        .where(F.col("rep") != F.col("centre"))
        .groupBy(F.col("centre").alias("a"), F.col("rep").alias("b"))
        .agg(F.first("bits_b").alias("bits_b"))
        .join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a")), "a")
        .where(estimate(F.col("bits_a"), F.col("bits_b")) >= floor)
        .select("a", "b")
    )
    # The texts are read once more, for the classes with company only; dealt out at any size,
    # so that the plan for a large corpus is the one for a small one.
    wanted = bits.select(F.col("rep").alias("doc_id")).hint("merge")
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = stored(spark, full_sets(chosen, shingle).dropDuplicates(["doc_id", "digest"]), "sets")
    links = stored(spark, confirmed(stars, sets, percent), "star-links")
    merged = components(spark, links)
    more = _between(spark, members.select("bucket", "rep", "size"), merged, classes, sets, percent)
    extra = confirmed(more, sets, percent)
    several = versions.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return components(spark, links.unionByName(extra).unionByName(several))


def _between(
    spark: SparkSession, members: DataFrame, merged: DataFrame, classes: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Pairs (a, b) of different components that meet in a bucket and may be similar enough."""
    labelled = members.join(merged, members.rep == merged.node, "left").select(
        "bucket", "rep", "size", F.coalesce("component", "rep").alias("label")
    )
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    several = several.where("low <> high").select("bucket")
    opened = stored(spark, labelled.join(several, "bucket", "left_semi"), "open-buckets")
    known = classes.select(F.col("rep").alias("doc_id"), "digest", "n", "bands")
    signed = sets.select("doc_id", "digest", "fine").join(known, ["doc_id", "digest"])
    signed = signed.withColumnRenamed("doc_id", "rep").drop("digest")
    rows = opened.dropDuplicates(["bucket", "rep"]).join(signed, "rep").where(F.array_contains("bands", F.col("bucket")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")

    def side(name: str, block: Column) -> DataFrame:
        columns = {"rep": name, "label": f"label_{name}", "n": f"n_{name}", "bands": f"bands_{name}", "fine": f"fine_{name}"}
        return rows.select("bucket", block.alias("block"), *[F.col(c).alias(new) for c, new in columns.items()])

    left = side("a", F.pmod(F.hash("rep"), blocks))
    right = side("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    near = estimate(F.col("fine_a"), F.col("fine_b"), FINE_HASHES, FINE_BITS) >= least_estimate(percent, FINE_HASHES, FINE_BITS)
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # The first band that both have in common is this bucket's.
    band = lambda side, k: F.get(F.col(f"bands_{side}"), F.lit(k))
    first = F.coalesce(*[F.when(band("a", k) == band("b", k), band("a", k)) for k in range(BANDS)]) == left.bucket
    met = (left.bucket == right.bucket) & (left.block == right.block) & (F.col("label_a") < F.col("label_b"))
    return stored(spark, left.join(right, met & sizes & near & first).select("a", "b").distinct(), "between")
