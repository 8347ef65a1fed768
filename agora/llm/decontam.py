"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document is contained in it, but hardly similar to it. As in
LSH Ensemble, documents are therefore partitioned by the size of their shingle sets, in
powers of two, and each partition has signatures fit for its sizes. Signatures are
one-permutation MinHash: a partition of sizes up to ``n`` has ``DENSITY * n`` bins, and keeps
the minimum of the hashes that fall into each bin. A shared shingle survives as the minimum of its bin in a document with a
probability of at least (1 - exp(-1 / DENSITY)) * DENSITY, whatever the size. An item is so
small beside a partition that its own shingles hardly share bins; all their hashes are looked
up. For items whose shared shingles may be too few to be seen with near certainty, documents
are searched with all their hashes instead, as with one bin per hash.

Documents that agree with an item in at least one bin are candidates. Candidates are
verified: the words of the item's shingles are compared with the document's.

Items are the query set. They are sent to all tasks in blocks of bounded size, and every
document is read once per block, in place: no document is shuffled or gathered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.llm.common import Memo, hashed, lower_words, mixed, shingle_hashes, utf8, word_hash

SHINGLE = 5
PERCENT = 80
#: Bins per shingle of the largest set in a partition.
DENSITY = 2.0
#: Probability that a contained item may go unseen.
MISS = 1e-9
#: Code points of item texts that one block may hold, about.
BLOCK_CHARS = 16_000_000
_BIN_SEED = np.uint64(0xD6E8FEB86659FD93)


def size_class(size: int) -> int:
    """Partition of a set: the least k with size <= 2**k."""
    return max(0, int(size - 1).bit_length())


def bins_of(partition: int) -> int:
    return max(1, int(DENSITY * (1 << partition)))


def bin_numbers(shingles: np.ndarray, partition: int) -> np.ndarray:
    """The bin of every hash; bits other than those that order the minima decide it."""
    return mixed(shingles ^ _BIN_SEED) % np.uint64(bins_of(partition))


def signature(shingles: np.ndarray, partition: int) -> np.ndarray:
    """The hashes that are the least of their bin, in a set of distinct hashes."""
    order = np.sort(shingles)
    _, first = np.unique(bin_numbers(order, partition), return_index=True)
    return order[first]


def survival() -> float:
    """Least probability that a shingle of a document is the minimum of its bin.

    A full partition puts 1 / DENSITY shingles into a bin on average, so the minimum of a bin
    stands for (1 - exp(-1 / DENSITY)) * DENSITY of them; a document at half the partition's
    limit does better.
    """
    return (1.0 - np.exp(-1.0 / DENSITY)) * DENSITY


def needed(size: int, percent: int) -> int:
    """Shared shingles that make an item contained."""
    return -(-size * percent // 100)


def seen_by_signature(size: int, percent: int) -> bool:
    """Whether signatures miss an item of this size with a probability of at most ``MISS``."""
    return (1.0 - survival()) ** needed(size, percent) <= MISS


class Block:
    """A block of items, as one sorted array of the hashes that lead to them."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, percent: int):
        self.shingle, self.percent = shingle, percent
        memo = Memo(word_hash)
        self.items: dict[int, tuple[int, list[tuple[bytes, ...]], np.ndarray]] = {}
        leads = defaultdict(list)
        for place, (number, text) in enumerate(items):
            words = lower_words((text or "").encode())
            hashes = shingle_hashes(hashed(words, memo), shingle)
            if not len(hashes):
                continue  # no words: contained in nothing
            length = min(shingle, len(words))
            tuples = list({tuple(words[k : k + length]) for k in range(len(words) - length + 1)})
            self.items[place] = (number, tuples, np.unique(hashes))
            for value in self.items[place][2].tolist():
                leads[value].append(place)
        self.keys = np.array(sorted(leads), dtype=np.uint64)
        self.leads = [leads[int(key)] for key in self.keys]
        # Small items need every hash of a document, the others only its signature.
        self.small = np.array(
            [any(not seen_by_signature(len(self.items[p][2]), percent) for p in places) for places in self.leads], dtype=bool
        )

    def matches(self, words: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its shingles, shared shingles) of the items that a document contains."""
        distinct = np.unique(hashes)
        if not len(distinct) or not len(self.keys):
            return []
        kept = signature(distinct, size_class(len(distinct)))
        places = np.searchsorted(self.keys, kept)
        places[places == len(self.keys)] = 0
        found = set(places[self.keys[places] == kept].tolist())
        if self.small.any():
            places = np.searchsorted(self.keys, distinct)
            places[places == len(self.keys)] = 0
            found.update(places[(self.keys[places] == distinct) & self.small[places]].tolist())
        if not found:
            return []
        candidates = {item for place in found for item in self.leads[place]}
        out = []
        by_length: dict[int, set] = {}
        for item in candidates:
            number, tuples, _ = self.items[item]
            length = len(tuples[0])
            if length not in by_length:
                here = min(self.shingle, len(words))
                # A text shorter than a shingle is one shingle as a whole.
                by_length[length] = {tuple(words[k : k + here]) for k in range(len(words) - here + 1)} if here == length else set()
            shared = sum(one in by_length[length] for one in tuples)
            if 100 * shared >= self.percent * len(tuples):
                out.append((number, len(tuples), shared))
        return sorted(out, key=lambda match: match[0])


def leaks(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``item_id, doc_id, item_shingles, shared_shingles`` of every contained item.

    An item is contained in a document that has ``percent`` of its distinct shingles, A-Z
    lower-cased. A text of fewer words than a shingle has one shingle, all of it, and is
    contained only in documents that are the same words. Texts without words, null ones
    included, contain nothing and are contained in nothing. Items with a null id are left
    out; documents with a null id give rows with it. Repeated items give a row each, as do
    repeated documents. No items or no documents give no rows. Other columns are ignored.
    """
    return _matched(spark, docs.select("doc_id", "text"), items, shingle, percent, block_chars)


def _matched(spark, docs, items, shingle, percent, block_chars):
    slim = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    slim = slim.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    results = None
    for number in range(blocks):
        rows = [(row["item_id"], row["text"]) for row in slim.where(F.col("block") == number).collect()]  # one bounded block
        part = _against(spark, docs, rows, shingle, percent)
        results = part if results is None else results.unionByName(part)
    return results


def _against(spark: SparkSession, docs: DataFrame, rows: list[tuple[int, str]], shingle: int, percent: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(sorted(rows, key=lambda row: (row[0], row[1] or "")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, memo = None, Memo(word_hash)
        for batch in batches:
            block = block or Block(sent.value, shingle, percent)
            rows, found = [], []
            for row, text in enumerate(utf8(batch.column(1))):
                words = lower_words(text)
                hashes = shingle_hashes(hashed(words, memo), shingle)
                for match in block.matches(words, hashes):
                    rows.append(row)
                    found.append(match)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([match[0] for match in found], pa.int64()),
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([match[1] for match in found], pa.int64()),
                    pa.array([match[2] for match in found], pa.int64()),
                ],
                ["item_id", "doc_id", "item_shingles", "shared_shingles"],
            )

    return docs.mapInArrow(search, f"item_id bigint, doc_id {kind}, item_shingles bigint, shared_shingles bigint")


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with their own columns; cases as in :func:`leaks`.

    Documents with an id that leaks go, all rows of that id; documents with a null id are
    judged as one document.
    """
    found = leaks(spark, docs, items, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti").select(*docs.columns)
