"""The pipeline against a plain version of its stages, each on what the one before kept."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
import public_tokenizers
from agora.llm import binary, mixing, quality
from llm_cases import WORD
from test_exact import _groups, _set

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    passed = {r["doc_id"] for r in quality.quality_verdicts(spark, docs).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in passed}
    sets = {k: _set(text, 5) for k, text in texts.items()}
    alone = {k for k, name in _groups(sets, 80).items() if k == name}
    items = [_set(r["text"], 5) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {k for k in alone if not any(i and 100 * len(i & sets[k]) >= 80 * len(i) for i in items)}
    assert len(passed) > len(alone) > 0 and len(alone) >= len(clean)
    left = docs.where(docs.doc_id.isin(*clean))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(mixing.sized(left)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted, start = [], 0
    for k in sorted(clean):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, binary.END]
        for _ in range(copies[k]):
            wanted.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    found = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter(found) == Counter(wanted)
    assert sum(len(WORD.findall(texts[k])) * n for k, n in copies.items()) > 0


def test_stages_are_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "near-duplicates",
        "benchmark decontamination",
        "source mix",
        "token files",
    ]
