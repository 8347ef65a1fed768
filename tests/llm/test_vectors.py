"""Hard negatives, whitening and piece codes against brute-force versions and their library."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
import sentencepiece

import public_tokenizers
from agora.llm import negatives, pieces, whitening
from agora.llm.queries import ORACLES, QUERIES
from llm_cases import documents, odd_rows

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int"
CLASHING = "place int, slot int, score string, `rank` int, n string, component string, block int, anchor_id string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.PieceModel(MODEL))


def _strange_texts():
    pick = random.Random(3)
    parts = ["  ", " ", "a", "b", "the", "ing", "\n", "\t", "▁", "数", "é", "🤖", "\x00", "<s>", "1", ".", "\xa0", "    ", "in", "aa", "==", "%"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(1_500)]
    texts += ["".join(pick.choice("aeiounrstlh <>=-_.") for _ in range(pick.randint(1, 200))) for _ in range(500)]
    points = [(32, 127), (32, 0x24F), (0x4E00, 0x9FFF), (1, 0xD7FF), (0xE000, 0x10FFFF)]
    texts += ["".join(chr(pick.randint(*pick.choice(points))) for _ in range(40)) for _ in range(500)]
    texts += [" " * k + end for k in range(120) for end in ("", "the", "▁x")]
    return texts + ["a" * k for k in range(60)] + ["", "<0x41>", "<unk></s>"]


def test_pieces_match_the_library(library, coder):
    texts = _strange_texts()
    for text, ids in zip(texts, coder.encode_all(texts)):
        wanted = library.encode(text)
        assert ids.tolist() == wanted, text
        assert coder.decode(wanted) == library.decode(wanted), text


def test_decoding_of_any_ids(library, coder):
    pick = random.Random(4)
    for _ in range(2_000):
        ids = [pick.choice([pick.randint(0, 31_999), pick.randint(0, 260), 259, 28_705]) for _ in range(pick.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", [" " * 200_000 + "x", "a" * 200_000, "数学" * 50_000, "ab" * 100_000, "=-" * 50_000])
def test_pieces_of_very_long_words(library, coder, text):
    assert coder.encode(text).tolist() == library.encode(text)


def test_words_forgotten_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    small = pieces.PieceCoder(pieces.PieceModel(MODEL))
    for text in _strange_texts()[:300]:
        assert small.encode(text).tolist() == library.encode(text)


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_piece_digests(spark, library):
    rows = odd_rows()
    found = pieces.piece_digests(documents(spark, rows, extra=True), MODEL, with_ids=True).collect()
    wanted = []
    for row in rows:
        ids = library.encode(row[1] or "")
        text = library.decode(ids)
        wanted.append((row[0], len(ids), _digest(",".join(map(str, ids))), _digest(text), ids, text))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert pieces.piece_digests(documents(spark, []), MODEL).count() == 0


def test_piece_query_matches_the_library(spark, library):
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = QUERIES["op11_piece_codes"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == _digest(",".join(map(str, ids)))
        assert row["decoded_sha256"] == _digest(library.decode(ids))


def _vectors(seed, count, width, labels=4, copies=0):
    pick = np.random.default_rng(seed)
    rows = [(k, pick.normal(size=width).astype("f4").tolist(), int(pick.integers(labels))) for k in range(count)]
    return rows + [(count + k, rows[0][1], k % labels) for k in range(copies)]


def _scaled(vector, scale=256):
    return [math.floor(scale * float(x)) for x in vector]


def _mined(rows, positives=5, negatives=5, low=80, high=100):
    """Every row against every anchor, windows one by one."""
    usable = [
        (vec_id, _scaled(vector), label)
        for vec_id, vector, label in rows
        if None not in (vec_id, vector, label) and all(x is not None and math.isfinite(x) and abs(256 * x) < 2**24 for x in vector)
    ]
    out = []
    for anchor, vector, label in usable:
        if anchor % 100:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, other)), vec_id, mark)
            for vec_id, other, mark in usable
            if vec_id != anchor and len(other) == len(vector)
        )
        best = [row for row in scored if row[2] == label][:positives]
        others = [row for row in scored if row[2] != label]
        for score, positive, _ in best:
            there = [row for row in others if low * -score <= 100 * -row[0] <= high * -score][:negatives]
            out += [(anchor, positive, k + 1, row[1], -score, -row[0]) for k, row in enumerate(there)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 2])
@pytest.mark.parametrize("settings", [{}, {"positives": 3, "negatives": 7, "low": 50, "high": 90}])
def test_negatives_match_brute_force(spark, monkeypatch, block, settings):
    rows = _vectors(1, 700, 6, copies=40) + _vectors(2, 120, 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = negatives.hard_negatives(spark, frame, block=block, **settings).collect()
    assert sorted(map(tuple, found)) == _mined(rows, **settings)


def test_negatives_of_odd_rows(spark):
    rows = _vectors(3, 60, 4, labels=2) + [
        (100, [1.0, 0.5, 0.5, 0.5], 0),
        (100, [1.0, 0.5, 0.5, 0.5], 0),
        (200, [0.0] * 4, 0),
        (300, None, 1),
        (400, [1.0, None, 1.0, 1.0], 1),
        (500, [NAN, 1.0, 1.0, 1.0], 1),
        (600, [INF, 1.0, 1.0, 1.0], 1),
        (700, [], 1),
        (701, [], 1),
        (702, [], 0),
        (800, [3e38] * 4, 1),
        (900, [1.0] * 4, None),
        (None, [1.0] * 4, 1),
        (-100, [0.25] * 4, 7),
        (1000, [30_000.0] * 4, 0),
        (1001, [30_000.0, 1.0, 2.0, 3.0], 0),
        (1002, [29_999.0, 1.0, 2.0, 4.0], 1),
    ]
    rows += rows[:3]
    wide = spark.createDataFrame([(*row, *[None] * 8) for row in rows], f"{SCHEMA}, {CLASHING}")
    found = sorted(map(tuple, negatives.hard_negatives(spark, wide).collect()))
    assert found == _mined(rows)
    assert any(row[0] == 1000 for row in found) and any(row[0] == 700 for row in found)
    for few in (rows[:0], [(1, [1.0], 1)], [(100, [1.0], 1)]):
        assert negatives.hard_negatives(spark, spark.createDataFrame(few, SCHEMA)).count() == 0


def test_scores_in_pieces(spark, monkeypatch):
    """Many small pieces and reductions keep the same rows."""
    rows = _vectors(5, 900, 5, labels=3, copies=200)
    held = [negatives.Vectors.of(batch) for batch in spark.createDataFrame(rows, SCHEMA).select("vec_id", "label", "embedding").toArrow().to_batches()]
    monkeypatch.setattr(negatives, "SCORES", 64)
    best = negatives.Best(1, 5)
    anchor = negatives.Vectors(np.array([0]), np.array([rows[0][2]]), np.array([_scaled(rows[0][1])], dtype=float))
    for parts in held:
        for part in parts:
            negatives._same_label(anchor, part, best, np.array([0]))
    scores = sorted((-int(np.dot(_scaled(rows[0][1]), _scaled(v))), k) for k, v, label in rows if k and label == rows[0][2])
    assert [(-s, k) for _, k, s in best.reduce().T.tolist()] == scores[:5]


def test_negatives_query_matches_its_sql(spark):
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    wanted = engine.execute(ORACLES["op12_hard_negatives"]).fetchall()
    names = [column[0] for column in engine.description]
    found = QUERIES["op12_hard_negatives"](spark, SMALL).select(*names).collect()
    assert len(found) > 50 and sorted(map(tuple, found)) == sorted(wanted)


def _check_whitening(found, rows, width, components=8):
    """The contract, from double precision and exact integers."""
    kept = [(k, v) for k, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(kept), x.sum(axis=0)
    apart = n * x - sums
    deviation = (apart * apart).sum(axis=1)
    centred = (apart / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, width)
    assert len(found) == n * count
    points = centred @ vectors[:, :count] / np.sqrt(values[:count])
    by = {}
    for row in found:
        by.setdefault(row["component"], []).append(row)
    for component, column in by.items():
        k = component - 1
        assert {row["n"] for row in column} == {n}
        assert column[0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert column[0]["identity_error"] < 1e-9
        ours = sorted((row["vec_id"], int(row["deviation"]), row["whitened"]) for row in column)
        theirs = sorted(zip([k for k, _ in kept], deviation.tolist(), points[:, k].tolist()))
        assert [row[:2] for row in ours] == [row[:2] for row in theirs]
        a, b = np.array([row[2] for row in ours]), np.array([row[2] for row in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_query(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = QUERIES["op13_embedding_whitening"](spark, SMALL)
    assert dict(found.dtypes)["deviation"] == "bigint"
    _check_whitening(found.collect(), rows, 64)


def test_whitening_of_odd_rows(spark):
    rows = _vectors(7, 40, 3) + [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [NAN, 0.0, 0.0], 1), (93, [INF, 0.0, 0.0], 1)]
    rows += [(None, [0.5, 0.25, 0.1], None), (40, [5000.0, -4000.0, 3.0], 1), (3, rows[3][1], 2)]
    rows = [(-1 if row[0] is None else row[0], *row[1:]) for row in rows]
    wide = spark.createDataFrame([(*row, *[None] * 8) for row in rows], f"{SCHEMA}, {CLASHING}").repartition(4)
    _check_whitening(whitening.whitened(spark, wide).collect(), rows, 3)
    none = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [2.0, 1.0], 1)], SCHEMA)
    assert {row["vec_id"] for row in whitening.whitened(spark, none).collect()} == {None, 1}


def test_whitening_of_few_rows(spark):
    """No rows, one row, fewer rows than dimensions, constant dimensions."""
    for few in ([], [(1, None, 1)], [(1, [], 1)]):
        assert whitening.whitened(spark, spark.createDataFrame(few, SCHEMA)).count() == 0
    one = whitening.whitened(spark, spark.createDataFrame([(1, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert [(row["component"], row["whitened"], row["explained"], row["deviation"]) for row in one] == [(1, None, 0.0, 0), (2, None, 0.0, 0)]
    two = whitening.whitened(spark, spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 2.0], 1)], SCHEMA)).collect()
    assert sorted((row["vec_id"], row["component"], row["whitened"]) for row in two if row["component"] == 1) in (
        [(1, 1, -1.0), (2, 1, 1.0)],
        [(1, 1, 1.0), (2, 1, -1.0)],
    )
    assert all(row["whitened"] is None for row in two if row["component"] == 2)
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(spark, mixed)


SPECTRA = {
    "apart": np.linspace(1, 30, 40) ** 2,
    "clustered": np.r_[np.full(3, 5.0), 5 + 1e-7, 5 + 2e-7, 5 + 1e-10, np.linspace(1, 4, 20)],
    "multiple": np.r_[np.ones(10), np.full(5, 2.0)],
    "singular": np.r_[np.zeros(10), 1e-9, 1, 2, 3],
    "graded": 10.0 ** -np.arange(12),
}


@pytest.mark.parametrize("name", list(SPECTRA))
def test_refined_eigenvectors(name):
    """Beyond double precision, also where single precision can't tell eigenvalues apart."""
    values = SPECTRA[name].astype(np.longdouble)
    size = len(values)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(4):
        basis = basis @ (1.5 * np.eye(size) - 0.5 * (basis.T @ basis))
    matrix = (basis * values) @ basis.T
    found, vectors = whitening.refined((matrix + matrix.T) / 2)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-16
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-17 * values.max()


@pytest.mark.parametrize("largest", [900, 2**45])
def test_exact_products(largest):
    rows = np.random.default_rng(2).integers(-largest, largest, size=(5_000, 4))
    wanted = rows.astype(object)
    assert (whitening.exact_products(rows) == wanted.T @ wanted).all()


def test_deviations_beyond_64_bits():
    rows = np.array([[10**6, -(10**6)], [0, 1]])
    found = whitening.deviations(rows, 10**12, np.array([3, 4], dtype=object)).to_pylist()
    assert [int(v) for v in found] == [(10**18 - 3) ** 2 + (10**18 + 4) ** 2, 9 + (10**12 - 4) ** 2]
