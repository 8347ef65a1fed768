"""Toxicity by weak supervision.

1. Terms (words and beginnings of words, and how many of a text's words begin so) that
   stand out in documents labelled toxic are mined from a bounded sample of labelled rows.
   The strongest whole words are dealt to lexicon voters. A few pattern voters look at shouting,
   repetition, masked words and the like. A voter fires or stays silent.
2. A generative label model is fitted to the votes on all documents, without labels: given
   the class, voters fire independently but for some correlated pairs. Then the covariance
   of two independent voters is the product of their accuracies' offsets, so a rank-one fit
   to the off-diagonal covariances gives the accuracies, and entries that stand out of the
   fit are the correlated pairs. They are left out and the fit is repeated. The pairs enter
   the posterior as a forest of dependent voters.
3. On the sample the given labels are one more voter; its accuracy is how often it agrees
   with the posterior of the others. A linear classifier over the mined terms and patterns is
   trained on the posterior labels of the sample, and its margin is scaled to a probability
   on the sample's labels.
4. Every text is scored in place by the classifier.

Only bounded things reach the driver: counts per pair of voters, and the chosen terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from agora.llm.common import Memo, held_out, stored

#: Labelled rows that lexicon and classifier are fitted on, about.
SAMPLE_ROWS = 20_000
#: Mined terms, by strength, that the classifier may use.
MOST_TERMS = 2_000
LEXICON_TERMS = 500
LEXICON_VOTERS = 8
LEAST_DOCUMENTS = 3
#: Likelihood ratio (G squared) from which on a term counts as standing out.
LEAST_STRENGTH = 20.0
PREFIXES = (3, 4, 5, 6, 7)
#: Marks of a term by the number of distinct words it stands for, and by their share in percent.
COUNT_MARKS = {"1": 1, "2": 2, "3": 3, "5": 5}
SHARE_MARKS = {"1%": 1, "2%": 2, "4%": 4}
THRESHOLD = 0.7
#: No voter is trusted to fire less often than this in either class.
LEAST_RATE = 1 / 500
#: Accuracy of the given labels, as one more voter on the sample: bounds of its estimate.
ANNOTATOR = (0.80, 0.99)
#: Correlation left by the rank-one fit that marks a pair of voters as dependent.
DEPENDENT = 0.08

_WORDS = re.compile(r"[^\W\d_]{3,}")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
_MASKED = re.compile(r"(?<=[^\W\d_])[*@#$%]{2,}(?=[^\W\d_])")
# Words that speak to the reader.
_YOU = frozenset("you your yours dich dir dein deine toi tes ton usted tus".split())
#: Pattern voters by name, in the order of their numbers.
PATTERNS = ("shouting", "exclaiming", "masked", "stuttering", "you")


def patterns_of(text: str, words: list[str], distinct: set[str]) -> list[int]:
    """Numbers of the pattern voters that fire on a text with these words in order."""
    fired = []
    if 4 * len(_CAPITALS.findall(text)) > len(words):
        fired.append(0)
    if 10 * text.count("!") > len(words):
        fired.append(1)
    if any(mark in text for mark in "*@#$%") and _MASKED.search(text):
        fired.append(2)
    if 3 * len(distinct) < 2 * len(words) and any(x == y == z for x, y, z in zip(words, words[1:], words[2:])):
        fired.append(3)
    if not distinct.isdisjoint(_YOU):
        fired.append(4)
    return fired


def terms_of_word(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [word + "$"] + [word[:length] for length in PREFIXES if len(word) >= length]


def marks(count: int, words: int) -> list[str]:
    """Marks that a term reaches with ``count`` of ``words`` distinct words; shares need two words."""
    found = [mark for mark, least in COUNT_MARKS.items() if count >= least]
    if count > 1:
        found += [mark for mark, percent in SHARE_MARKS.items() if 100 * count >= percent * words]
    return found


def words_in(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents that are not held out."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = min(1.0, rows / max(1, known.count()))
    grain = 1 << 20
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(grain)) < int(share * grain) + (share == 1.0))
    # At most about ``rows`` pairs of numbers, so they are sent to the documents.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    return stored(spark, joined.select("text", "toxic"), "toxic-sample")


def mined_terms(sample: DataFrame, most: int = MOST_TERMS) -> list[tuple[str, float]]:
    """(term, strength) of the terms that stand out in toxic documents, strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        memo = Memo(terms_of_word)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(words_in(text.as_py()))
                counts = Counter(term for word in words for term in memo[word])
                found[1 if toxic else 0].update(
                    f"{term}|{mark}" for term, n in counts.items() for mark in marks(n, len(words))
                )
        terms = list(found[0].keys() | found[1].keys())
        columns = [pa.array(terms, pa.string())] + [pa.array([found[k][t] for t in terms], pa.int64()) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    totals = {bool(row["toxic"]): row["count"] for row in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return []
    counts = sample.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term")
    counts = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_DOCUMENTS)
    with_, share = F.col("t") + F.col("c"), toxic / (toxic + clean)

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    strength = 2 * (part(F.col("t"), with_ * share) + part(F.col("c"), with_ * (1 - share)))
    best = (
        counts.where(F.col("t") > with_ * share)
        .withColumn("strength", strength)
        .where(F.col("strength") >= LEAST_STRENGTH)
        .orderBy(F.desc(F.round("strength", 6)), F.length("term"), "term")
        .limit(most)
    )
    return [(row["term"], row["strength"]) for row in best.collect()]  # at most ``most`` rows


def lexicon_of(terms: list[tuple[str, float]], most: int = LEXICON_TERMS) -> list[str]:
    """The strongest whole words, in alphabetical order; without any, the strongest terms.

    Dealt in turn, words of one stem and one theme spread over all voters, so that the voters
    see the same toxic documents, whatever their language.
    """
    names = [name for name, _ in terms]
    words = [name for name in names if name.endswith("$|1")]
    return sorted((words or names)[:most])


class Features:
    """Numbers of the terms and patterns in a text; patterns come after the terms."""

    def __init__(self, terms: list[str]):
        self.numbers = {term: number for number, term in enumerate(terms)}
        self.size = len(terms) + len(PATTERNS)
        self.stems = {term.partition("|")[0] for term in terms}
        self.memo = Memo(self._of_word)

    def _of_word(self, word: str) -> tuple[str, ...]:
        return tuple(stem for stem in terms_of_word(word) if stem in self.stems)

    def __call__(self, text: str) -> set[int]:
        in_order = words_in(text)
        words = set(in_order)
        counts = Counter(stem for stems in filter(None, map(self.memo.__getitem__, words)) for stem in stems)
        names = (f"{stem}|{mark}" for stem, count in counts.items() for mark in marks(count, len(words)))
        found = {self.numbers[name] for name in names if name in self.numbers}
        first = self.size - len(PATTERNS)
        found.update(first + number for number in patterns_of(text, in_order, words))
        return found


class Voters:
    """Which voters fire on a set of features."""

    def __init__(self, terms: list[str], lexicon: list[str]):
        numbers = {term: number for number, term in enumerate(terms)}
        self.of = {numbers[term]: rank % LEXICON_VOTERS for rank, term in enumerate(lexicon)}
        self.of |= {len(terms) + k: LEXICON_VOTERS + k for k in range(len(PATTERNS))}
        self.size = LEXICON_VOTERS + len(PATTERNS)

    def __call__(self, features: set[int]) -> np.ndarray:
        votes = np.zeros(self.size)
        votes[[self.of[number] for number in features if number in self.of]] = 1
        return votes


def vote_moments(docs: DataFrame, terms: list[str], lexicon: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and how often each pair of voters fires together, over all of them."""
    sent = docs.sparkSession.sparkContext.broadcast((terms, lexicon))  # bounded numbers of terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, voters = Features(sent.value[0]), Voters(*sent.value)
        together, number = np.zeros((voters.size, voters.size)), 0
        for batch in batches:
            for text in batch.column(0):
                votes = voters(features(text.as_py()))
                fired = np.flatnonzero(votes)
                together[np.ix_(fired, fired)] += 1
                number += 1
        left, right = np.nonzero(together)
        columns = [np.append(left, -1), np.append(right, -1), np.append(together[left, right], number)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["i", "j", "n"])

    slim = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = slim.mapInArrow(count, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    size = LEXICON_VOTERS + len(PATTERNS)
    together, number = np.zeros((size, size)), 0
    for row in rows:  # a row per pair of voters
        if row["i"] < 0:
            number = row["n"]
        else:
            together[row["i"], row["j"]] = row["n"]
    return number, together


class LabelModel:
    """Accuracies and dependent pairs of voters, from how often they fire together."""

    def __init__(self, number: int, together: np.ndarray, prior: float):
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        rates = np.diag(together) / max(1, number)
        covariance = together / max(1, number) - np.outer(rates, rates)
        scale = np.sqrt(np.maximum(rates * (1 - rates), 1e-12))
        size = len(rates)
        used = ~np.eye(size, dtype=bool) & np.outer(rates > 0, rates > 0)
        for _ in range(4):
            offsets = self._rank_one(covariance / np.outer(scale, scale), used) * scale
            left = (covariance - np.outer(offsets, offsets)) / np.outer(scale, scale)
            odd = (np.abs(left) > DEPENDENT) & used
            # A voter keeps at least half of its partners, or its accuracy would hang in the air.
            for voter in np.flatnonzero(odd.sum(axis=1) > size // 2):
                order = np.argsort(-np.abs(left[voter]) * odd[voter])
                odd[voter, order[size // 2 :]] = False
            odd &= odd.T
            if not odd.any():
                break
            used &= ~odd
        self.offsets = offsets
        self.left = np.where(used, 0.0, covariance - np.outer(offsets, offsets))
        np.fill_diagonal(self.left, 0.0)
        spread = offsets / math.sqrt(self.prior * (1 - self.prior))
        self.toxic = np.clip(rates + (1 - self.prior) * spread, LEAST_RATE, 1 - LEAST_RATE)
        self.clean = np.clip(rates - self.prior * spread, LEAST_RATE, 1 - LEAST_RATE)
        self.parents = self._forest(np.abs(self.left) / np.outer(scale, scale))

    @staticmethod
    def _rank_one(matrix: np.ndarray, used: np.ndarray) -> np.ndarray:
        values = np.where(used, matrix, 0.0)
        found = np.sqrt(np.maximum(values.max(axis=1), 0.0))
        for _ in range(200):
            weight = used @ (found**2)
            found = 0.5 * found + 0.5 * np.divide(values @ found, weight, out=np.zeros_like(found), where=weight > 1e-12)
        return found if found.sum() >= 0 else -found

    @staticmethod
    def _forest(strength: np.ndarray) -> dict[int, int]:
        """A parent for each voter that depends on one: the strongest pairs without a cycle."""
        group = list(range(len(strength)))
        neighbours: dict[int, list[int]] = {}
        for flat in np.argsort(-strength, axis=None):
            i, j = divmod(int(flat), len(strength))
            if strength[i, j] <= DEPENDENT:
                break
            if i < j and group[i] != group[j]:
                old = group[j]
                group = [group[i] if g == old else g for g in group]
                neighbours.setdefault(i, []).append(j)
                neighbours.setdefault(j, []).append(i)
        parents: dict[int, int] = {}
        seen: set[int] = set()
        for root in neighbours:
            stack = [root] if root not in seen else []
            seen.add(root)
            while stack:
                node = stack.pop()
                for other in neighbours[node]:
                    if other not in seen:
                        seen.add(other)
                        parents[other] = node
                        stack.append(other)
        return parents

    def posterior(self, votes: np.ndarray) -> float:
        """Probability of the toxic class given the votes.

        Once a lexicon voter fires, the silent ones abstain: a text needs few of many words.
        Silence counts against the toxic class only when all lexicon voters share it.
        """
        score = math.log(self.prior / (1 - self.prior))
        abstain = bool(votes[:LEXICON_VOTERS].any())
        for rates, sign in ((self.toxic, 1.0), (self.clean, -1.0)):
            for voter, vote in enumerate(votes):
                if abstain and not vote:
                    continue
                chance = rates[voter]
                if voter in self.parents:
                    parent = self.parents[voter]
                    a, b = rates[voter], rates[parent]
                    both = min(max(a * b + self.left[voter, parent], a + b - 1, 0.0), a, b)
                    chance = both / b if votes[parent] else (a - both) / (1 - b)
                    chance = min(max(chance, 1e-6), 1 - 1e-6)
                score += sign * math.log(chance if vote else 1 - chance)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, score))))


def _vectors(sample: DataFrame, terms: list[str], lexicon: list[str], model: LabelModel) -> DataFrame:
    """(features, posterior, toxic) of the sample."""
    def rows(partition):
        features, voters = Features(terms), Voters(terms, lexicon)
        for row in partition:
            found = features(row["text"])
            yield SparseVector(features.size, sorted(found), [1.0] * len(found)), model.posterior(voters(found)), float(row["toxic"])

    schema = StructType(
        [StructField("features", VectorUDT()), StructField("posterior", DoubleType()), StructField("toxic", DoubleType())]
    )
    return sample.sparkSession.createDataFrame(sample.rdd.mapPartitions(rows), schema)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, float]:
    """Terms, their weights (patterns follow), and the intercept of the classifier.

    Without both classes in the sample nothing can be learned: no terms, and an intercept
    from the share of toxic labels.
    """
    sample = labelled_sample(spark, docs, labels, rows)
    ranked = mined_terms(sample)
    terms = [term for term, _ in ranked]
    known = sample.agg(F.sum((F.col("toxic") > 0).cast("double")), F.count(F.lit(1))).first()
    share = ((known[0] or 0.0) + 0.5) / (known[1] + 1.0)
    if not terms:
        return [], np.zeros(len(PATTERNS)), math.log(min(share, 0.5) / (1 - min(share, 0.5))) - 1.0
    lexicon = lexicon_of(ranked)
    model = LabelModel(*vote_moments(docs, terms, lexicon), share)
    vectors = with_annotator(stored(spark, _vectors(sample, terms, lexicon, model), "toxic-vectors"))
    # A posterior label is two weighted rows, one of each class.
    twice = vectors.select("features", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("label"), "posterior")
    weighted = twice.withColumn("weight", F.when(F.col("label") == 1.0, F.col("posterior")).otherwise(1.0 - F.col("posterior")))
    linear = LogisticRegression(weightCol="weight", regParam=1e-4, elasticNetParam=0.0, standardization=False, maxIter=60).fit(weighted)
    weights, intercept = linear.coefficients.toArray(), float(linear.intercept)
    slope, shift = _scaled(vectors, weights, intercept)
    return terms, weights * slope, intercept * slope + shift


def with_annotator(vectors: DataFrame) -> DataFrame:
    """Posteriors that take the given label as one more, independent vote."""
    agrees = (F.col("posterior") >= 0.5) == (F.col("toxic") > 0)
    found = vectors.agg(F.avg(agrees.cast("double"))).first()[0]
    accuracy = min(max(found, ANNOTATOR[0]), ANNOTATOR[1])
    weight = math.log(accuracy / (1 - accuracy))
    odds = F.col("posterior") / (1.0 - F.col("posterior") + 1e-12)
    odds = odds * F.when(F.col("toxic") > 0, math.exp(weight)).otherwise(math.exp(-weight))
    return vectors.withColumn("posterior", odds / (1.0 + odds))


def _scaled(vectors: DataFrame, weights: np.ndarray, intercept: float) -> tuple[float, float]:
    """Slope and shift that turn margins into log odds of the labels."""

    def rows(partition):
        for row in partition:
            margin = float(weights[row["features"].indices].sum()) + intercept
            yield SparseVector(1, [0], [margin]), float(row["toxic"] > 0)

    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])
    margins = vectors.sparkSession.createDataFrame(vectors.rdd.mapPartitions(rows), schema)
    found = LogisticRegression(regParam=1e-4, standardization=False, maxIter=50).fit(margins)
    slope = float(found.coefficients[0])
    return (slope, float(found.intercept)) if slope > 0 else (1.0, 0.0)


def toxicity_scores(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``.

    A null text counts as empty and, like any text without a feature, has the score of the
    intercept. A null id is neither learned from nor held out. Repeated rows get equal
    scores. Labels that are null, or of no document, count for nothing; of several labels
    of one id the highest counts. No documents give no rows. Other columns are ignored.
    """
    terms, weights, intercept = fit(spark, docs, labels, rows)
    sent = spark.sparkContext.broadcast((terms, weights, intercept))  # a bounded number of terms
    slim = docs.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, intercept = sent.value
        features = Features(terms)
        for batch in batches:
            margins = np.array([intercept + weights[np.fromiter(features(text.as_py()), np.int64)].sum() for text in batch.column(2)])
            scores = 1.0 / (1.0 + np.exp(-np.clip(margins, -30, 30)))
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
