"""Token files: ids under a canonical length-limited Huffman code.

The code is built from the counts of all ids in the corpus. Code lengths come from the
package-merge method, which gives the best code with no length above the limit; the codes
follow from the lengths alone, so a file stores one small number per id.

Documents are ordered by id across the files. A row of a file is a segment: the ids of
consecutive whole documents as one bit string, the bit offset of every 1024th id, and the
document ids with their token counts. Decoding looks up the next bits in one table, and
runs over all blocks of a segment at once because each offset is a place to start from.

The folder holds two tables: ``segments`` and ``code`` (id, length).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from agora.llm.common import stored
from agora.llm.tokens import proven_tokens

LONGEST = 20
BLOCK = 1024
#: A segment ends with the document that takes it to this number of ids.
SEGMENT = 1 << 20
END = 2
#: Ids fit two bytes in the intermediate table.
MOST_IDS = 1 << 16


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Length per id of the best prefix code with lengths up to ``longest``; 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # Each level merges the leaves with the pairs of the level below, in order of weight.
    levels, packages = [], np.empty(0)
    for _ in range(longest):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaves))
        ordered = weights[rank]
        even = len(ordered) // 2 * 2
        packages = ordered[0:even:2] + ordered[1:even:2]
    wanted = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), dtype=np.uint8)
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:wanted].sum())
        depth[:taken] += 1
        wanted = 2 * (wanted - taken)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id, each the one after its predecessor."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = previous = 0
    for number in sorted(np.flatnonzero(lengths), key=lambda k: (lengths[k], k)):
        code <<= int(lengths[number]) - previous
        codes[number], previous = code, int(lengths[number])
        code += 1
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Per value of the next ``longest`` bits: the id, and the length of its code."""
    order = sorted(np.flatnonzero(lengths), key=lambda k: (lengths[k], k))
    spans = [1 << (longest - int(lengths[k])) for k in order]
    symbols = np.zeros(1 << longest, dtype=np.uint16)
    steps = np.ones(1 << longest, dtype=np.uint8)
    filled = sum(spans)
    symbols[:filled] = np.repeat(np.array(order, dtype=np.uint16), spans)
    steps[:filled] = np.repeat(lengths[order], spans)
    return symbols, steps


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids as a bit string, and the bit offset of every ``BLOCK``-th id."""
    sizes = lengths[ids].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    total = int(starts[-1] + sizes[-1]) if len(ids) else 0
    word, within = starts >> 5, starts & 31
    value = codes[ids].astype(np.uint64) << (64 - within - sizes).astype(np.uint64)
    count = (total + 31) // 32 + 1
    # The parts of one word don't overlap, so their sum is below 2**32 and exact as a float.
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), count)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), count + 1)[:count]
    return (high + low).astype(np.uint64).astype(">u4").tobytes(), starts[::BLOCK]


def unpack(payload: bytes, offsets: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``count`` ids of a bit string; all blocks advance together."""
    symbols, steps = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    at = offsets.astype(np.int64)
    shift = np.uint64(64 - LONGEST)
    out = np.empty((min(BLOCK, count), len(at)), dtype=np.uint16)
    last = count - (len(at) - 1) * BLOCK if count else 0
    for step in range(len(out)):
        if step == last:  # the last block has ended
            at = at[:-1]
        peek = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
        out[step, : len(at)] = symbols[peek]
        at = at + steps[peek]
    return out.T.reshape(-1)[:count] if len(offsets) < 2 else np.concatenate([out[:, :-1].T.reshape(-1), out[:last, -1]])


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, tie, ids): two-byte ids of every text with the end id."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(proven_tokens(spark, path))  # at most the vocabulary
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = whole.value.encoder(path)
        for batch in batches:
            rows = list(coded.encode((text.as_py() for text in batch.column(1)), end))
            ties = pa.array(map(zlib.crc32, rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ties, pa.array(rows, pa.binary())], ["doc_id", "tie", "ids"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(encode, f"doc_id {kind}, tie bigint, ids binary")


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs; one row per id and task is shuffled, one per id collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_IDS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            if not len(ids):
                continue
            flat = np.frombuffer(ids.buffers()[2], "<u2")  # of all rows, end to end
            bounds = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1] // 2
            total += np.bincount(flat[bounds[0] : bounds[-1]], minlength=MOST_IDS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["id", "n"])

    found = rows.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(MOST_IDS, dtype=np.int64)
    for row in found.collect():  # at most MOST_IDS rows
        counts[row["id"]] = row["n"]
    return counts


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Write the token files of the documents to a new folder, in ascending order of doc_id.

    A null text is an empty document of the end id alone; null ids come first; documents
    with equal ids lie next to each other, in the order of a checksum of their ids. No rows
    give empty tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(spark, tokenized(docs, path, end), "token-ids")
    lengths = code_lengths(id_counts(rows))
    used = [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{folder}/code")
    code = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie"
    )
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = code.value
        shard, number = TaskContext.get().partitionId(), 0
        docs_here: list = []
        ids_here: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload, offsets = pack(np.concatenate(ids_here), lengths, codes)
            values = [
                [shard],
                [number],
                [size],
                [payload],
                [offsets.astype("<u4").tobytes()],
                [docs_here],
                [[len(ids) for ids in ids_here]],
            ]
            schema = arrow_schema(batch_kind)
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)

        batch_kind = None
        for batch in batches:
            batch_kind = batch.schema.field(0).type
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(value.as_py(), "<u2")
                docs_here.append(doc_id)
                ids_here.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield flush()
                    number, size, docs_here, ids_here = number + 1, 0, [], []
        if docs_here:
            yield flush()

    out = ordered.select("doc_id", "ids").mapInArrow(segments, segment_schema(kind))
    out.write.option("compression", "none").parquet(f"{folder}/segments")


def segment_schema(kind: str) -> str:
    return (
        "shard int, segment int, n_ids bigint, payload binary, offsets binary, "
        f"doc_ids array<{kind}>, doc_sizes array<bigint>"
    )


def arrow_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("shard", pa.int32()),
            ("segment", pa.int32()),
            ("n_ids", pa.int64()),
            ("payload", pa.binary()),
            ("offsets", pa.binary()),
            ("doc_ids", pa.list_(kind)),
            ("doc_sizes", pa.list_(pa.int64())),
        ]
    )


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Decode token files: per document ``doc_id, start, n_tokens, ids_crc32`` and ``ids``."""
    lengths = np.zeros(MOST_IDS, dtype=np.uint8)
    for row in spark.read.parquet(f"{folder}/code").collect():  # at most MOST_IDS rows
        lengths[row["id"]] = row["length"]
    code = spark.sparkContext.broadcast(decode_table(lengths))  # three bytes for each value of LONGEST bits
    segments = spark.read.parquet(f"{folder}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard, number, count, payload, offsets = (batch.column(k)[row].as_py() for k in range(5))
                ids = unpack(payload, np.frombuffer(offsets, "<u4"), count, table)
                doc_ids, sizes = batch.column(5)[row].values, batch.column(6)[row].values.to_numpy()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                parts = [ids[a:b].astype("<u4") for a, b in zip(begins, ends)]
                arrays = [
                    pa.array([shard] * len(sizes), pa.int32()),
                    pa.array([number] * len(sizes), pa.int32()),
                    doc_ids,
                    pa.array(begins, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(part.tobytes()) for part in parts], pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array([part.astype(np.int32) for part in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["shard", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = f"shard int, segment int, doc_id {kind}, begin bigint, n_tokens bigint, ids_crc32 bigint" + (
        ", ids array<int>" if with_ids else ""
    )
    parts = segments.mapInArrow(decode, kinds)
    # One row per shard is summed in one task, one per segment within its shard.
    per_shard = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids_here"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = per_shard.select("shard", F.coalesce(F.sum("ids_here").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("segment_start"))
        .join(shards, "shard")
        .select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("segment_start"))
    )
    return parts.join(places, ["shard", "segment"]).select(
        "doc_id",
        (F.col("segment_start") + F.col("begin")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
