"""Operators against brute-force versions of themselves."""

import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

import public_tokenizers
from agora.llm import binary, decontam, langid, linedup, mixing, neardup, quality, tokens
from agora.llm.queries import ORACLES, QUERIES
from llm_cases import WORD, changed, documents, prose

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(given):
    return {row["doc_id"]: row["text"] or "" for row in given.collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_match_their_sql(spark, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    engine = duckdb.connect()
    for table in ("documents", "benchmark"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    wanted = engine.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = list(wanted.columns)
    rows = lambda frame: sorted(map(repr, frame[columns].itertuples(index=False, name=None)))
    assert rows(found) == rows(wanted)


def _set(text, length):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + length]) for k in range(max(1, len(words) - length + 1))} if words else set()


def _groups(sets, percent):
    """Smallest reachable id by brute force."""
    name = {k: k for k in sets}

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            name[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def test_all_versions_of_an_id_are_linked(spark):
    """A repeated id with three different texts links the documents equal to any of them."""
    texts = [prose(k, 40) for k in range(4)]
    rows = [(k, texts[k], "en", "s") for k in range(4)] + [(9, text, "en", "s") for text in texts[:3]]
    found = neardup.near_duplicates(spark, documents(spark, rows), shingle=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 0, 2: 0, 3: 3, 9: 0}


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, shingle, percent):
    """Stars, chains and dense groups, with classes on both sides of the threshold."""
    rows, number = [], 0
    for seed in range(12):
        base = prose(seed, 150)
        chain = base
        for step in range(14):
            rows.append((number, changed(base, 1000 * seed + step, 1 + step % 7), "en", "s"))
            chain = changed(chain, 77 * seed + step, 3)
            rows.append((number + 1, chain, "en", "s"))
            rows.append((number + 2, base.upper() if step % 2 else base, "en", "s"))
            number += 3
    random.Random(1).shuffle(rows)
    rows = [(k, *row[1:]) for k, row in enumerate(rows)]
    found = {r["doc_id"]: r for r in neardup.near_duplicates(spark, documents(spark, rows), shingle, percent).collect()}
    sets = {row[0]: _set(row[1], shingle) for row in rows}
    wanted = _groups(sets, percent)
    assert {k: r["component_id"] for k, r in found.items()} == wanted
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (wanted[k] == k) for k, r in found.items())
    kept = neardup.without_near_duplicates(spark, documents(spark, rows), shingle, percent).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted.values()))


def test_bits_estimate_the_similarity(spark):
    from pyspark.sql import functions as F

    pick = np.random.default_rng(1)
    rows, wanted = [], []
    for share in (0.5, 0.7, 0.8, 0.9, 1.0):
        for _ in range(20):
            pool = pick.integers(0, 2**63, 4000).astype(np.uint64)
            common = int(2000 * share / (1 + share) * 2)
            left, right = pool[:2000], np.concatenate([pool[:common], pool[2000 : 4000 - common]])
            wanted.append(len(np.intersect1d(left, right)) / len(np.union1d(left, right)))
            rows.append(([int(v) for v in neardup.sketch(left)[1]], [int(v) for v in neardup.sketch(right)[1]]))
    frame = spark.createDataFrame(rows, "l array<bigint>, r array<bigint>").coalesce(1)
    found = [row[0] for row in frame.select(neardup.estimate(F.col("l"), F.col("r"))).collect()]
    errors = np.array(found) - np.array(wanted)
    assert abs(errors.mean()) < 0.015 and np.abs(errors).max() < 0.2
    assert all(f >= neardup.least_estimate(80) for f, w in zip(found, wanted) if w >= 0.8)


def test_leaks(spark):
    items = [(k, prose(500 + k, 6 + 3 * k)) for k in range(30)] + [(30, "two words"), (31, prose(500, 6))]
    rows = []
    for k in range(120):
        item = items[k % 31][1]
        edge = changed(item, k, (k % 4) * max(1, len(item.split()) // 25))
        rows.append((k, prose(k, 300 * (1 + k % 5)) + " " + edge.upper() + "\n" + prose(k + 7, 40), "en", "s"))
    rows.append((999, "TWO\twords", "en", "s"))
    found = decontam.leaks(spark, documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=700)
    wanted = set()
    for item, text in items:
        own = _set(text, 5)
        for row in rows:
            shared = len(own & _set(row[1], 5))
            if 100 * shared >= 80 * len(own):
                wanted.add((item, row[0], len(own), shared))
    assert {tuple(row) for row in found.collect()} == wanted and len(wanted) > 40


def test_small_items_are_searched_with_all_hashes():
    assert not decontam.seen_by_signature(1, 80) and decontam.seen_by_signature(40, 80)
    for size in (1, 2, 3, 1000, 1024, 1025):
        assert size <= 1 << decontam.size_class(size)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def _edited(text, pick, edits):
    out = list(text)
    for _ in range(edits):
        place = pick.randrange(len(out) + 1)
        out[place : place + pick.randint(0, 1)] = pick.choice(["", "x", "y", "é"])
    return "".join(out)


def test_edit_distance():
    pick = random.Random(3)
    for _ in range(3000):
        a = "".join(pick.choice("ab") for _ in range(pick.randint(0, 24)))
        b = _edited(a + "a", pick, pick.randint(0, 5))
        for most in (1, 2, 4):
            assert linedup.edit_distance(a, b, most) == min(_distance(a, b), most + 1)


@pytest.mark.parametrize("count, block", [(25, 1024), (3, 2)])
def test_duplicate_lines(spark, monkeypatch, count, block):
    """Many lines with few versions each, and few lines with many."""
    monkeypatch.setattr(linedup, "BLOCK", block)
    pick = random.Random(8)
    bases = [prose(k, 6) for k in range(count)] + ["short line", "short lime", "The end.", "The enx.", "The ed.", "a short lin3", "今天天气很好我们走", "今天天气很好我们去走"]
    rows = []
    for k in range(60):
        lines = [_edited(b, pick, pick.choice([0, 0, 1, 2, 3, 4])) if len(b) > 20 else b for b in pick.sample(bases, 6)]
        rows.append((k, "\n".join([*lines, "", "  " + lines[0] + " "]), "en", "s"))
    places = {}
    for k, text, *_ in rows:
        for no, line in enumerate(text.split("\n")):
            if line.strip():
                places.setdefault(line.strip(), []).append((k, no))
    texts = sorted(places)
    links = {
        (a, b)
        for a, b in itertools.combinations(texts, 2)
        if _distance(a, b) <= linedup.allowed(min(len(a), len(b)), linedup.EDITS, linedup.LEAST)
    }
    name = {t: t for t in texts}

    def root(t):
        while name[t] != t:
            t = name[t]
        return t

    for a, b in links:
        name[root(a)] = root(b)
    first = {t: min(p) for t, p in places.items()}
    best = {}
    for t in texts:
        best[root(t)] = min(best.get(root(t), (10**9, 0)), first[t])
    wanted = {}
    for k, text, *_ in rows:
        lines = [line.strip() for line in text.split("\n") if line.strip()]
        fresh = [t for t in texts if first[t][0] == k]
        kept = sum(place[0] == k for place in best.values())
        wanted[k] = (len(lines), len(lines) - len(fresh), len(fresh) - kept, kept)
    docs = documents(spark, rows)
    assert {r[0]: tuple(r)[1:] for r in linedup.line_duplicates(spark, docs).collect()} == wanted
    assert len(links) > 20
    cleaned = linedup.without_duplicate_lines(spark, docs).collect()
    assert {r["doc_id"]: sum(bool(x.strip()) for x in r["text"].split("\n")) for r in cleaned} == {k: w[3] for k, w in wanted.items()}


def test_token_counts_and_files(spark, given, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    ids = {k: library.encode(text, add_special_tokens=False).ids for k, text in texts.items()}
    for row in tokens.token_counts(given, VOCABULARY).collect():
        wanted = len(ids[row["doc_id"]])
        assert tuple(row)[1:] == (len(texts[row["doc_id"]].encode()), wanted, wanted > tokens.OVER)
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/token-test"
    binary.write_tokens(given, folder, VOCABULARY)
    found = {row["doc_id"]: row for row in binary.read_tokens(spark, folder).collect()}
    start = 0
    for k in sorted(ids):
        wanted = [*ids[k], binary.END]
        crc = zlib.crc32(np.array(wanted, dtype="<u4").tobytes())
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"], found[k]["ids"]) == (start, len(wanted), crc, wanted)
        start += len(wanted)


def test_chunks_match_the_library():
    from tokenizers import Tokenizer

    library, whole = Tokenizer.from_file(VOCABULARY), tokens.whole_tokens(VOCABULARY)
    count, encode = tokens.counter(VOCABULARY, whole), tokens.encoder(VOCABULARY, whole)
    pick = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'re", "é", "ß", "1", "²", "Ⅷ", "<|endoftext|>", "<|endof", "中", "\x1c", "\x85"]
    parts += ["\xa0", " ", "😀", "!", "don", "'", "_", "\r", "﻿", "İ", "́", "\x00", "word."]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 12)))
        wanted = library.encode(text, add_special_tokens=False).ids
        assert count(text) == len(wanted) and np.frombuffer(encode(text), "<u2").tolist() == wanted, text


def test_a_worker_codes_a_chunk_once(monkeypatch):
    """Tasks share one encoder; groups, forgotten chunks, long chunks, special strings and gaps change no id."""
    from tokenizers import Tokenizer

    library, whole = Tokenizer.from_file(VOCABULARY), tokens.WholeTokens(tokens.whole_tokens(VOCABULARY))
    rows = [prose(k % 40, 30, "fr" if k % 3 else "en").replace(". ", ".\n") for k in range(120)]
    rows += ["", " ", "two  gaps", "a <|endoftext|>b", "x" * 500, "wordone wordone. wordone,\nwordone"]
    wanted = [np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u2").tobytes() for text in rows]
    coded = whole.encoder(VOCABULARY)
    assert list(coded.encode(rows, 2)) == wanted
    met = len(coded.starts)
    again = whole.encoder(VOCABULARY)
    assert again is coded and list(again.encode(rows, 2)) == wanted and len(coded.starts) == met
    for group, chars, most in ((100, 10**6, 300), (10**6, 400, 300), (50, 50, 20)):
        monkeypatch.setattr(tokens.Encoder, "GROUP", group)
        monkeypatch.setattr(tokens.Encoder, "GROUP_CHARS", chars)
        small = tokens.Encoder(VOCABULARY, whole, most)
        for _ in range(2):
            assert list(small.encode(rows, 2)) == wanted
        assert len(small.starts) < met


def test_code_lengths():
    pick = np.random.default_rng(2)
    for size, longest in ((1, 20), (2, 20), (300, 9), (300, 20), (5000, 14)):
        counts = np.floor(pick.pareto(0.6, size) * 3).astype(np.int64) + 1
        lengths = binary.code_lengths(counts, longest)
        assert lengths.max() <= longest and (size == 1 or np.sum(2.0 ** -lengths.astype(float)) == 1.0)
        if longest == 20 and size == 300:  # long enough for the unlimited code
            import heapq

            heap = [(int(c), k, 0) for k, c in enumerate(counts)]
            heapq.heapify(heap)
            cost, fresh = 0, size
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                cost += a[0] + b[0]
                heapq.heappush(heap, (a[0] + b[0], fresh, 0))
                fresh += 1
            assert int((counts * lengths).sum()) == cost or lengths.max() == 20


def test_blocks_decode():
    counts = np.bincount(np.random.default_rng(1).geometric(0.01, 40_000), minlength=binary.MOST_IDS)
    lengths = binary.code_lengths(counts)
    codes, table = binary.canonical_codes(lengths), binary.decode_table(lengths)
    used = np.repeat(np.arange(binary.MOST_IDS), counts)
    np.random.default_rng(2).shuffle(used)
    for size in (1, 2, 1023, 1024, 1025, 5000, 40_000):
        ids = used[:size].astype(np.uint16)
        payload, offsets = binary.pack(ids, lengths, codes)
        assert (binary.unpack(payload, offsets.astype("<u4"), size, table) == ids).all()


def test_repeated_words(spark):
    from pyspark.sql import functions as F

    from agora.llm.common import words_of

    pick = random.Random(5)
    texts = [" ".join(pick.choice("ab") for _ in range(n)) for n in range(40)] + [prose(3, 30) + " " + prose(3, 30), "a " * 3000]

    def brute(text):
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}) if len(words) < 200 else len(words)

    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = dict(map(tuple, frame.select("k", quality.repeated_words(words_of(F.col("t")))).collect()))
    assert [found[k] for k in range(len(texts))] == [brute(t) for t in texts]


def test_targets_fill_like_water(spark):
    sizes = [("a", 10), ("b", 500), ("c", 90), ("d", 1000), ("e", 1), (None, 40)]
    found = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    total = sum(s for _, s in sizes)
    level_weights = dict(zip([s for s, _ in sizes], itertools.cycle(mixing.WEIGHTS)))
    open_, target, left = dict(sizes), {}, float(total)
    while True:
        share = {s: left * level_weights[s] / sum(level_weights[t] for t in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * open_[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * open_.pop(s)
            left -= target[s]
    target |= share
    assert all(math.isclose(found[s], target[s]) for s in target)


def test_hot_source_is_taken_to_its_target(spark):
    rows = [(k, prose(k, 5 + k % 30), "en", "hot" if k % 3 else f"s{k % 4}") for k in range(900)]
    found = mixing.mix(mixing.sized(documents(spark, rows)), buckets=16).collect()
    sums = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        sums.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 20 for taken, target in sums.values())
    again = mixing.mix(mixing.sized(documents(spark, rows[::-1]).repartition(7)), buckets=4096).collect()
    assert {(r["doc_id"], r["taken"]) for r in found} == {(r["doc_id"], r["taken"]) for r in again}


def test_ranks_by_hand(spark):
    docs = documents(spark, [(k, t, lang, "s") for k, (t, lang) in enumerate([("ab ab ab", "x"), ("cd cd", "y"), ("ab", None), (None, "x")] * 6)])
    ranked = langid.learn(docs)
    assert ranked["x"][0] == "_a" and set(ranked["x"]) == set(langid.grams_of("ab")) and set(ranked) == {"x", "y"}
    judge = langid.Judge(ranked)
    assert judge("ab") == ("x", 1.0) and judge("12 ²") == ("und", 0.0) and judge(None) == ("und", 0.0) and judge("中")[1] == 0.0
