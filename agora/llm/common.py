"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agora.session import scratch_path

#: White space between words: space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda word: word != "")


def held_out(doc_id: Column) -> Column:
    """Whether a document is set aside for evaluation; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def bound_columns(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with computed ones."""
    return frame.select(*[F.col(name) for name in names])


class Memo(dict):
    """Values of a pure function by argument, of bounded size.

    When it has grown to ``most`` entries, these become the old generation, which keeps
    what is asked for again until the next change.
    """

    def __init__(self, compute: Callable, most: int = 300_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


# Odd multipliers of the word positions in a shingle, and of the final mixing (splitmix64).
_STEP = 0x9E3779B97F4A7C15
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (splitmix64); a bijection."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def _multipliers(length: int) -> list[np.uint64]:
    return [np.uint64(pow(_STEP, place + 1, 1 << 64) | 1) for place in range(length)]


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all ``length``-word shingles, in text order.

    A shorter sequence is one shingle as a whole; without words there is none.
    """
    if not len(words):
        return words
    length_here = min(length, len(words))
    count = len(words) - length_here + 1
    total = np.full(count, length_here, dtype=np.uint64)
    for place, factor in enumerate(_multipliers(length_here)):
        total += words[place : place + count] * factor
    return mixed(total)


def lower_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased.

    For bytes, ``lower`` and ``split`` know ASCII only: white space is what GAP says.
    """
    return text.lower().split() if text else []


def hashed(words: list[bytes], memo: Memo) -> np.ndarray:
    """Hashes of words, in order."""
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as bytes."""
    return column.cast(pa.binary()).to_pylist()
