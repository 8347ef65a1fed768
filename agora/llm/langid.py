"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams, by rank, counted over all
documents it is learned from. A document's most frequent n-grams are ranked in the same way,
and the language with the least sum of rank differences ("out of place") is taken; an n-gram
that a profile lacks counts as the profile's length (Cavnar and Trenkle 1994).

N-grams are counted per word, so every distinct word of a text is cut once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from agora.llm.common import Memo, held_out

LONGEST = 3
PROFILE = 400
#: N-grams per language that documents are ranked over: far more than a profile holds, so
#: that frequent n-grams outside the profiles take their ranks.
KNOWN = 3_000
#: Words that a task counts before it turns them into n-grams.
HELD_WORDS = 200_000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(char.isalpha() for word in words for char in word)


def grams_of(word: str) -> list[str]:
    """All n-grams of a word with a mark before and after it, but for the bare mark."""
    marked = f"_{word}_"
    grams = [marked[k : k + n] for n in range(1, LONGEST + 1) for k in range(len(marked) - n + 1)]
    return [gram for gram in grams if gram != "_"]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, Counter] = defaultdict(Counter)
        words: dict[str, Counter] = defaultdict(Counter)

        def settle() -> None:
            for lang, counts in words.items():
                total = grams[lang]
                for word, n in counts.items():
                    for gram in grams_of(word):
                        total[gram] += n
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words[lang].update(words_in(text.as_py()))
            if sum(map(len, words.values())) > HELD_WORDS:
                settle()
        settle()
        for lang, counts in grams.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(counts), pa.string()),
                    pa.array(list(counts), pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "gram", "n"],
            )

    found = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, known: int = KNOWN) -> dict[str, list[str]]:
    """The ``known`` most frequent n-grams per language, in order; ties by the n-gram.

    Learned from rows with text, language and an id that is not held out. Collected are at
    most ``known`` rows per language.
    """
    used = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = gram_counts(used).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= known)
    profiles: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for row in ranked.collect():
        profiles[row["lang"]].append((row["rank"], row["gram"]))
    return {lang: [gram for _, gram in sorted(found)] for lang, found in sorted(profiles.items())}


class Judge:
    """Ranks the n-grams of texts and measures their distance to every profile."""

    def __init__(self, ranked: dict[str, list[str]], profile: int = PROFILE):
        self.langs, self.profile = list(ranked), profile
        best: dict[str, int] = {}
        for grams in ranked.values():
            for rank, gram in enumerate(grams):
                best[gram] = min(rank, best.get(gram, rank))
        # Equal counts in a document are ranked by how common the n-grams are at all.
        self.numbers = {gram: k for k, gram in enumerate(sorted(best, key=lambda gram: (best[gram], gram)))}
        self.ranks = np.full((len(self.langs), len(self.numbers)), -1, dtype=np.int64)
        for row, grams in enumerate(ranked.values()):
            for rank, gram in enumerate(grams[:profile]):
                self.ranks[row, self.numbers[gram]] = rank
        self.memo = Memo(self._known)

    def _known(self, word: str) -> np.ndarray:
        return np.array([self.numbers[gram] for gram in grams_of(word) if gram in self.numbers], dtype=np.int64)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_in(text) if text else []
        if not has_letter(words) or not self.langs:
            return UNKNOWN, 0.0
        counts = Counter(words)
        cut = [self.memo[word] for word in counts]
        weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), [len(grams) for grams in cut])
        found = np.bincount(np.concatenate(cut), weights, len(self.numbers))
        top = np.argsort(-found, kind="stable")[: self.profile]
        top = top[found[top] > 0]
        if not len(top):
            return self.langs[0], 0.0
        there = self.ranks[:, top]
        apart = np.where(there >= 0, np.abs(there - np.arange(len(top))), self.profile)
        distance = apart.sum(axis=1) / (self.profile * len(top))
        place = int(np.argmin(distance))
        return self.langs[place], float(1.0 - distance[place])


def languages(spark: SparkSession, docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``.

    ``score`` is one minus the distance as a share of the largest possible. Texts that are
    null or without a letter are ``und`` with score 0, as are all if nothing can be learned.
    Equal distances go to the first language by name. A null id is neither learned from nor
    held out. Repeated rows get equal results, no rows none; other columns are ignored.
    """
    sent = spark.sparkContext.broadcast(learn(docs))
    slim = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value, profile)
        for batch in batches:
            found = [judge(text.as_py()) for text in batch.column(2)]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), langs, scores], names)

    names = ["doc_id", "held_out", "lang_pred", "score"]
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
