"""Small inputs that the operator tests share."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int, lang: str = "en") -> str:
    """Invented prose of a language."""
    parts = {"en": "the an ing er st wh on ha re tion ou".split(), "fr": "le qué è eau oi ment un çon ré ai".split()}[lang]
    pick = random.Random(f"{seed}{lang}")
    made = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(words)]
    return " ".join(word + ("." if k % 9 == 8 else "") for k, word in enumerate(made))


def changed(text: str, seed: int, words: int) -> str:
    """The text with some of its words replaced."""
    pick, out = random.Random(seed), text.split(" ")
    for place in pick.sample(range(len(out)), min(words, len(out))):
        out[place] = f"other{pick.randint(0, 10**6)}"
    return " ".join(out)


#: Columns whose names operators use for their own.
CLASHING = (
    "text2 string, size bigint, target bigint, taken string, copies int, bucket string, key string, `group` string, kept boolean, "
    "n_words string, x0 string, score string, digest string, component string, node string, rep string, handle string, line string, "
    "a string, b string, d2 string, distance string, ids string, n_chars bigint, held_out string, block string, label string"
)


def documents(spark, rows, extra: bool = False):
    """(doc_id, text, lang, source[, clashing columns]) as a frame."""
    schema = "doc_id bigint, text string, lang string, source string"
    if extra:
        width = CLASHING.count(",") + 1
        return spark.createDataFrame([(*row, *[None] * width) for row in rows], f"{schema}, {CLASHING}")
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = prose(5, 60_000)
    rows = [
        (1, prose(1, 80), "en", "s1"),
        (2, prose(1, 80), "en", "s1"),
        (3, prose(2, 90, "fr"), "fr", "s2"),
        (3, prose(2, 90, "fr"), "fr", "s2"),
        (4, prose(3, 70), None, "s1"),
        (5, prose(4, 70), "en", None),
        (None, prose(6, 60), "en", "s1"),
        (None, None, None, None),
        (6, None, "en", "s2"),
        (7, "", "en", "s2"),
        (8, " \t\n\x0b ", "fr", "s2"),
        (9, "one", "en", "s1"),
        (10, "one", "en", "s1"),
        (11, long, "en", "s1"),
        (12, "a" * 50_000, "en", "s1"),
        (13, "  two  spaces \n\n\n and\tlines \n", "en", "s1"),
        (14, "数学 문서 <|endoftext|>   \x1c\x85 end", "en", "s1"),
    ]
    return rows + [(k, prose(k, 60 + k % 40, "fr" if k % 3 else "en"), "fr" if k % 3 else "en", f"s{k % 3}") for k in range(100, 160)]
