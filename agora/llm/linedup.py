"""Duplicate lines by a segment-partition edit join.

Two lines within ``edits`` edits agree, however the shorter is cut into ``edits + 1``
segments, in at least one of them: that segment occurs in the longer line, near its own
place. Every distinct line is indexed by its segments, and probes the index of every length
it may match with the substrings that can be such a segment (the places that all other
segments allow, as in Pass-Join). Lines that meet are compared by a banded bit-parallel edit
distance. Lines shorter than ``least`` code points match within one edit, those of fewer than
``SHORT`` exactly only: in them a few edits make another line.

Only hashes travel for the search, and with them the parities of a line's characters, dealt
to 64 places: an edit changes two at most, so pairs of lines that share a segment but differ
in more are dropped where they meet. Keys with one line are dropped where they are gathered.
Lines that share a key first meet one of them only; classes follow from the links found. Then
lines of different classes meet, dealt to blocks, so many copies of one line make few pairs
and a segment that very many lines share is spread. Linked lines are classes; the first line
of a class, by document id and line number, is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agora.llm.common import let, stored
from agora.llm.components import components

EDITS = 2
LEAST = 20
SHORT = 8
BLOCK = 1024
#: White space that is cut from both ends of a line.
EDGES = " \t\x0b\x0c\r"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose parities are found at once.
TOGETHER = 200_000
#: Lines that a task remembers in order to emit their keys once.
REMEMBERED = 500_000


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the ``edits + 1`` nearly equal segments of a line of that length."""
    short, longer = divmod(length, edits + 1)
    sizes = [short] * (edits + 1 - longer) + [short + 1] * longer
    starts = np.cumsum([0, *sizes[:-1]])
    return [(int(start), size) for start, size in zip(starts, sizes)]


def allowed(length: int, edits: int, least: int) -> int:
    """The edits within which a line of that length matches a longer one."""
    return edits if length >= least else min(edits, int(length >= SHORT))


def probes(length: int, edits: int, least: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings that a line probes with.

    Lines are at most as long as the probing one. If a segment is the first that is
    unchanged, each segment before it holds an edit, so it has moved by fewer places than
    there are segments before it; seen from the end, the same holds for those after it.
    """
    out = []
    for other in range(max(SHORT, length - edits), length + 1):
        gap, here = length - other, allowed(other, edits, least)
        if gap > here:
            continue
        for number, (start, size) in enumerate(segments(other, here)):
            after = here - number
            first = max(0, start - number, start + gap - after)
            last = min(length - size, start + number, start + gap + after)
            out += [(other, number, place, size) for place in range(first, last + 1)]
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or ``most + 1`` if it is larger.

    The differences between neighbouring cells of a column are bits, and a word holds only
    the cells of the band around the diagonal, which moves down by one row per column
    (Myers 1999, Hyyrö 2003). The distance is followed along the lower edge of the band and
    then, from where the edge meets the last row, along that row.
    """
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if len(b) <= most:  # shorter than the band
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return min(row[-1], most + 1)
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for place, char in enumerate(a):
        where[char] = where.get(char, 0) | 1 << place
    rising = full ^ ((1 << (width - 1 - most)) - 1)  # rows 0 to ``most`` of the first column
    falling = 0
    distance, turn = most, len(a) - most
    on_row = top >> 1
    for column, char in enumerate(b):
        shift = column + most + 1 - width  # row of the lowest bit
        seen = where.get(char, 0)
        match = (seen >> shift if shift >= 0 else seen << -shift) & full
        diagonal = ((((match & rising) + rising) ^ rising) | match | falling) & full
        up = (falling | ~(diagonal | rising)) & full
        down = diagonal & rising
        if column < turn:
            distance += not diagonal & top
        else:
            distance += bool(up & on_row) - bool(down & on_row)
            on_row >>= 1
        if distance > 2 * most + 1:
            return most + 1
        rising = (down | ~((diagonal >> 1) | up)) & full
        falling = (diagonal >> 1) & up
    return min(distance, most + 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines that are not blank, without space at the ends."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(EDGES))).where("line <> ''")


def parities(lines: list[str]) -> np.ndarray:
    """Bit k of a line says whether its characters that fall to place k are odd in number."""
    parts, start, size = [], 0, 0
    for place, line in enumerate(lines, 1):
        size += len(line)
        if size >= TOGETHER or place == len(lines):  # some ten bytes for each character at a time
            group = lines[start:place]
            codes = np.frombuffer("".join(group).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
            bits = np.uint64(1) << ((codes * _SPREAD) >> np.uint64(58))
            ends = np.cumsum([len(one) for one in group])
            parts.append(np.bitwise_xor.reduceat(bits, np.concatenate([[0], ends[:-1]])))
            start, size = place, 0
    return np.concatenate(parts)


def _handle(line: Column) -> Column:
    return F.xxhash64(line)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def keys_of_lines(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, handle, parity, indexed): the index keys and the probe keys of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        plans: dict[int, tuple[list, list]] = {}
        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, handles, found, sizes, marks = [], [], [], [], []
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    line = line.strip(EDGES)
                    length = len(line)
                    if length < SHORT:
                        continue
                    handle = xxhash.xxh64_intdigest(line.encode(), 42)
                    if handle in done:
                        continue
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(handle)
                    if length not in plans:
                        if len(plans) > 20_000:
                            plans.clear()
                        own = segments(length, allowed(length, edits, least))
                        cuts = [(start, start + size, length * 8 + n) for n, (start, size) in enumerate(own)]
                        tries = [(at, at + size, other * 8 + n) for other, n, at, size in probes(length, edits, least)]
                        plans[length] = cuts, tries
                    cuts, tries = plans[length]
                    keys += [hashed(line[a:b].encode(), seed) for a, b, seed in cuts]
                    keys += [hashed(line[a:b].encode(), seed) for a, b, seed in tries]
                    handles.append(handle)
                    found.append(line)
                    sizes.append(len(cuts) + len(tries))
                    marks += [True] * len(cuts) + [False] * len(tries)
            if not found:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                    pa.array(np.repeat(np.array(handles, dtype=np.uint64), sizes).view(np.int64)),
                    pa.array(np.repeat(parities(found), sizes).view(np.int64)),
                    pa.array(marks, pa.bool_()),
                ],
                ["key", "handle", "parity", "indexed"],
            )

    return docs.select("text").where("text IS NOT NULL").mapInArrow(
        run, "key bigint, handle bigint, parity bigint, indexed boolean"
    )


def shared_keys(spark: SparkSession, docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, handle, parity, indexed, centre) of the keys that several lines have.

    The centre is the indexed line of the smallest handle, with its parity.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by key once; repeated emissions and keys of one line go where they are gathered.
    dealt = keys_of_lines(docs, edits, least).repartition(parts, "key").dropDuplicates(["key", "handle", "indexed"])
    one_key = Window.partitionBy("key")
    shared = dealt.withColumns(
        {
            "low": F.min("handle").over(one_key),
            "high": F.max("handle").over(one_key),
            "centre": F.min(F.when(F.col("indexed"), F.struct("handle", "parity"))).over(one_key),
        }
    )
    shared = shared.where("low <> high AND centre IS NOT NULL").drop("low", "high")
    return stored(spark, shared, "shared-keys")


def _alike(one: Column | str, other: Column | str, edits: int) -> Column:
    one, other = (F.col(c) if isinstance(c, str) else c for c in (one, other))
    return F.bit_count(one.bitwiseXOR(other)) <= 2 * edits


def stars(shared: DataFrame, edits: int) -> DataFrame:
    """(a, b): lines and the centre of a key they probe with."""
    probing = shared.where(~F.col("indexed") & (F.col("handle") != F.col("centre.handle")))
    near = probing.where(_alike("parity", "centre.parity", edits))
    return near.select(F.col("handle").alias("a"), F.col("centre.handle").alias("b")).distinct()


def between(spark: SparkSession, shared: DataFrame, named: DataFrame, edits: int) -> DataFrame:
    """(a, b): lines of different classes that meet under a key, a probing and b indexed."""
    rows = shared.drop("centre").join(named, shared.handle == named.node, "left").select(
        "key", "handle", "parity", "indexed", F.coalesce("component", "handle").alias("label")
    )
    rows = stored(spark, rows, "labelled-keys")
    sizes = rows.groupBy("key").agg(
        F.ceil(F.count_if("indexed") / BLOCK).cast("bigint").alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    placed = rows.join(sizes.where("low <> high AND blocks > 0").drop("low", "high"), "key")
    index = placed.where("indexed").select(
        "key", F.pmod(F.xxhash64("handle"), F.col("blocks")).alias("block"), F.col("handle").alias("b"), F.col("parity").alias("parity_b"), F.col("label").alias("label_b")
    )
    probe = placed.where("NOT indexed").select(
        "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("handle").alias("a"), F.col("parity").alias("parity_a"), F.col("label").alias("label_a")
    )
    met = (probe.key == index.key) & (probe.block == index.block) & (F.col("label_a") != F.col("label_b"))
    return probe.join(index, met & _alike("parity_a", "parity_b", edits)).select("a", "b").distinct()


def verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, b, da, db): handles and digests of the line pairs within the edits they may have."""
    pairs = stored(spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    wanted = pairs.select(F.col("a").alias("handle")).union(pairs.select("b")).distinct()
    lines = occurrences(docs).select(_handle(F.col("line")).alias("handle"), "line").where(F.length("line") >= SHORT)
    # Dealt out at any size, so that the plan for a large corpus is the one for a small one.
    lines = lines.join(wanted.hint("merge"), "handle", "left_semi").dropDuplicates(["handle", "line"])
    lines = stored(spark, lines, "lines")

    def near(x: str, y: str) -> bool:
        most = allowed(min(len(x), len(y)), edits, least)
        return edit_distance(x, y, most) <= most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [near(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(found, pa.bool_()))

    left = lines.select(F.col("handle").alias("a"), F.col("line").alias("la"))
    right = lines.select(F.col("handle").alias("b"), F.col("line").alias("lb"))
    texts = pairs.join(right, "b").join(left, "a").select("a", "b", "la", "lb")
    found = texts.mapInArrow(run, "a bigint, b bigint, la string, lb string")
    return stored(spark, found.select("a", "b", _digest(F.col("la")).alias("da"), _digest(F.col("lb")).alias("db")), "near-lines")


def line_links(spark: SparkSession, docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(a, b): digests of different lines within ``edits`` edits, enough of them for all classes.

    Every pair of near lines is joined by a path of these links; pairs that lie in one class by
    the links to a centre are not listed.
    """
    docs = docs.select("doc_id", "text")
    shared = shared_keys(spark, docs, edits, least)
    links = verified(spark, stars(shared, edits), docs, edits, least)
    rest = between(spark, shared, components(spark, links.select("a", "b")), edits)
    both = links.unionByName(verified(spark, rest, docs, edits, least))
    return both.select(F.col("da").alias("a"), F.col("db").alias("b")).where("a <> b").distinct()


def _firsts(spark: SparkSession, docs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, place, class) of the first occurrence of every line, and (doc_id, n_lines)."""
    each = occurrences(docs).select("doc_id", "line_no", _digest(F.col("line")).alias("digest"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    firsts = stored(spark, each.groupBy("digest").agg(F.min(place).alias("place")), "first-lines")
    named = components(spark, links)
    firsts = firsts.join(named, firsts.digest == named.node, "left").select(
        "digest", "place", F.coalesce("component", "digest").alias("class")
    )
    lines = docs.select("doc_id", F.size(_not_blank(F.col("text"))).cast("bigint").alias("n"))
    return firsts, lines.groupBy("doc_id").agg(F.sum("n").alias("n_lines"))


def _not_blank(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(EDGES)) != "")


def _kept(firsts: DataFrame) -> DataFrame:
    """(place) of the first line of every class."""
    return firsts.groupBy("class").agg(F.min("place").alias("place")).select("place")


def line_duplicates(spark: SparkSession, docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """Per document ``doc_id, n_lines, n_exact, n_near, n_kept``.

    ``n_lines`` counts lines that are not blank, ``n_exact`` those that stand somewhere
    before, ``n_near`` the other ones whose class has a line before, ``n_kept`` the rest.
    Before is by document id, null last, and line number. Lines are compared without the white
    space at their ends. Rows that repeat an id make one row. A null or empty text has no
    lines, lines of any length are compared as a whole. No rows give no rows; other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    firsts, lines = _firsts(spark, docs, line_links(spark, docs, edits, least))
    first = firsts.groupBy(F.col("place.doc_id").alias("f_id")).agg(F.count(F.lit(1)).alias("first"))
    kept = _kept(firsts).groupBy(F.col("place.doc_id").alias("k_id")).agg(F.count(F.lit(1)).alias("kept"))
    out = lines.join(first, F.col("doc_id").eqNullSafe(F.col("f_id")), "left").join(
        kept, F.col("doc_id").eqNullSafe(F.col("k_id")), "left"
    )
    zero = F.lit(0).cast("bigint")
    first_here, kept_here = F.coalesce("first", zero), F.coalesce("kept", zero)
    return out.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - first_here).alias("n_exact"),
        (first_here - kept_here).alias("n_near"),
        kept_here.alias("n_kept"),
    )


def without_duplicate_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """The documents with only the kept lines in ``text``, and blank lines as they are.

    Cases as in :func:`line_duplicates`; of rows that repeat an id every one keeps the lines
    at the kept numbers. A document without kept lines has an empty text, a null one stays.
    """
    slim = docs.select("doc_id", "text")
    firsts, _ = _firsts(spark, slim, line_links(spark, slim, edits, least))
    places = _kept(firsts).groupBy(F.col("place.doc_id").alias("_id")).agg(F.collect_list("place.line_no").alias("_kept"))
    joined = docs.join(places, docs["doc_id"].eqNullSafe(places["_id"]), "left")

    def wanted(lines: Column) -> Column:  # in time that grows with the lines only, however many are kept
        blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.btrim(F.get(lines, k), F.lit(EDGES)) == "")
        kept = F.filter(F.coalesce("_kept", F.array().cast("array<int>")), lambda k: k < F.size(lines))
        return F.transform(F.array_sort(F.array_union(blank, kept)), lambda k: F.get(lines, k))

    text = F.array_join(let(F.split("text", "\n"), wanted), "\n")
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*docs.columns)
