"""Token counts with a whole-token shortcut.

The tokenizer first cuts a text into pre-tokens and then merges bytes inside each of them.
Many pre-tokens are a token as a whole. Which strings of the vocabulary encode alone as one
token is proven beforehand with the library, once, on the driver. Pre-tokens that match one
of them count directly; only the rest is merged, by the library's own merge model.

A text is cut into chunks at its spaces. A single space between two other characters always
begins a pre-token, so results can be remembered per chunk. A text with any other space is
cut again, only where that holds. Chunks with characters whose classes differ between
Unicode versions are left to the library's own pre-tokenizer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.llm.common import Memo

OVER = 512
#: How byte-level pre-tokens are cut: fixed values of the public vocabularies.
PRE_TOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Characters below U+0250 have had the same class in every version; U+001C to U+001F are
# white space to one library and not to the other.
_PLAIN = re.compile("[\x00-\x1b\x20-\u024f]*")
_LAST_PLAIN = "\u024f"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A word and marks behind it: two pre-tokens, whatever the word.
_TAILED = re.compile(r"([a-zA-Zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
_MARKS = "".join(chr(code) for code in range(0x21, 0x7F) if not chr(code).isalnum() and chr(code) != "'")
_ID = attrgetter("id")
#: Chunks that a worker remembers.
REMEMBERED = 600_000


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + k) for k, byte in enumerate(hidden)}


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings that the library encodes, alone, as the one token they name."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    back = {char: byte for byte, char in byte_alphabet().items()}
    texts, ids = [], []
    for name, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            texts.append(bytes(back[char] for char in name).decode("utf-8"))
            ids.append(number)
        except (KeyError, UnicodeDecodeError):
            continue  # no text of its own
    proven = {}
    for start in range(0, len(texts), 5_000):
        part = texts[start : start + 5_000]
        for text, number, found in zip(part, ids[start:], tokenizer.encode_batch(part, add_special_tokens=False)):
            if found.ids == [number]:
                proven[text] = number
    return proven


def proven_tokens(spark: SparkSession, path: str) -> WholeTokens:
    """:func:`whole_tokens`, found by one task, so that the library's tables don't stay with the driver."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            whole = whole_tokens(path)
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.string()), pa.array(list(whole.values()), pa.int32())], ["text", "id"])

    rows = spark.range(1).coalesce(1).mapInArrow(found, "text string, id int").toArrow()  # at most the vocabulary
    return WholeTokens(zip(rows.column("text").to_pylist(), rows.column("id").to_pylist()))


class Coder:
    """Token ids of chunks of text, with the proven whole tokens looked up."""

    def __init__(self, path: str, whole: dict[str, int]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.whole = self.library.model, whole
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[ord(" ")]
        self.special = {t.content: number for number, t in self.library.get_added_tokens_decoder().items()}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(names) + ")") if names else None

    def _merged(self, piece: str):
        if piece.isascii() and piece.isprintable():  # only the space has another character
            return self.model.tokenize(piece.replace(" ", self.space))
        return self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.alphabet))

    @staticmethod
    def plain_pieces(chunk: str) -> list[str] | None:
        """The pre-tokens of a chunk; None if they are left to the library."""
        if chunk.isprintable() and (chunk.isascii() or max(chunk) <= _LAST_PLAIN):
            if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
                return [chunk]
        elif _PLAIN.fullmatch(chunk) is None:
            return None
        return PRE_TOKENS.findall(chunk)

    def count(self, chunk: str) -> int:
        pieces = self.plain_pieces(chunk)
        if pieces is None:
            return len(self.library.encode(chunk, add_special_tokens=False).ids)
        whole = self.whole
        return sum(1 if piece in whole else len(self._merged(piece)) for piece in pieces)

    def ids(self, chunk: str) -> list[int]:
        pieces = self.plain_pieces(chunk)
        if pieces is None:
            return self.library.encode(chunk, add_special_tokens=False).ids
        return [number for piece in pieces for number in self.piece_ids(piece)]

    def piece_ids(self, piece: str) -> list[int]:
        number = self.whole.get(piece)
        return [token.id for token in self._merged(piece)] if number is None else [number]

    def pieces(self, text: str) -> Iterator[tuple[str | None, int]]:
        """The text between special strings, each with 0, and for each of these None with its id."""
        if self.specials is None or not any(name in text for name in self.special):
            yield text, 0
            return
        for place, piece in enumerate(self.specials.split(text)):
            yield (None, self.special[piece]) if place % 2 else (piece, 0)


def joins_a_gap(chunk: str) -> bool:
    """Whether a chunk between two spaces has white space next to one of them."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


#: The count of a chunk that depends on its neighbours: makes any sum negative.
_UNKNOWN = -(1 << 50)


def _remembered(value: Callable, unknown, words: Callable) -> tuple[Memo, Memo]:
    """What is known of a text's first chunk, and of later ones, which come without their space.

    ``unknown`` stands for a chunk that depends on its neighbours. The marks behind a word are
    looked up apart from it, so a word is merged once.
    """

    def of(space: str, own: Callable[[], Memo]):
        def compute(chunk: str):
            if chunk.isalpha():
                return value(space + chunk)
            tailed = _TAILED.fullmatch(chunk)
            if tailed is not None:
                return own()[tailed[1]] + words(tailed[2])
            return unknown if joins_a_gap(chunk) else value(space + chunk)

        return compute

    first = Memo(of("", lambda: first), REMEMBERED)
    later = Memo(of(" ", lambda: later), REMEMBERED)
    return first, later


def counter(path: str, whole: dict[str, int]):
    """A function from a text to its number of tokens."""
    coder = Coder(path, whole)
    first, later = _remembered(coder.count, _UNKNOWN, Memo(coder.count).__getitem__)

    def of_piece(piece: str) -> int:
        chunks = piece.split(" ")
        total = first[chunks[0]] + sum(map(later.__getitem__, chunks[1:]))
        if total < 0:
            begin, *rest = _SAFE_CUT.split(piece)
            total = coder.count(begin) + sum(coder.count(" " + chunk) for chunk in rest)
        return total

    return lambda text: sum(1 if piece is None else of_piece(piece) for piece, _ in coder.pieces(text) if piece != "")


class Numbered(dict):
    """Numbers of keys in the order in which they were first asked for; new keys wait in ``fresh``."""

    def __init__(self, keys: Iterable = ()):
        super().__init__((key, number) for number, key in enumerate(keys))
        self.fresh: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Encoder:
    """Ids of texts as little-endian two-byte integers, many texts at a time.

    All chunks met so far are numbered, and the ids of each lie in one flat array. A group of
    texts is looked up number by number, the new chunks are coded, and the ids of all texts are
    gathered at once. Chunks after a space go by their own name, a text's first one has a space
    appended, ids of special strings go by their digits after a space. Beyond ``most`` chunks, or
    8 ids for each, those met in one group only and long ones are forgotten.
    """

    #: Chunks and characters of a group of texts, and chunks that a worker remembers.
    GROUP, GROUP_CHARS, MOST = 200_000, 4_000_000, 1_200_000

    def __init__(self, path: str, whole: dict[str, int], most: int = MOST):
        self.coder, self.most = Coder(path, whole), most
        self.marks = Memo(self.coder.piece_ids)
        self._begin([], np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u2"))

    def _begin(self, keys: list, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remember these chunks only."""
        self.numbers = Numbered(keys)
        self.starts, self.sizes = array("i", starts.tobytes()), array("i", sizes.tobytes())  # a size of -1: not alone
        self.ids, self.again = array("H", ids.tobytes()), bytearray(len(keys))

    def _forget(self) -> None:
        again = np.frombuffer(self.again, np.uint8)
        starts, sizes, ids = np.array(self.starts), np.array(self.sizes), np.array(self.ids)
        kept = np.flatnonzero((again != 0) & (sizes <= 16))
        if 2 * len(kept) > self.most:
            kept = kept[:0]
        keys = list(self.numbers)
        places, ends = _runs(starts[kept], np.maximum(sizes[kept], 0))
        self._begin([keys[k] for k in kept.tolist()], ends[:-1].astype(np.int32), sizes[kept], ids[places])

    def _word(self, key: str, piece: str, ready: dict) -> Iterable[int]:
        """Ids of a word inside a chunk; the word is numbered as a chunk of its own."""
        number = self.numbers.get(key)
        if number is not None and number < len(self.starts):
            return self.ids[self.starts[number] : self.starts[number] + self.sizes[number]]
        if key not in ready:
            ready[key] = self.coder.piece_ids(piece)
            self.numbers[key]  # in line to be stored
        return ready[key]

    def _code(self, key: str, ready: dict) -> list[int] | None:
        """Ids of a chunk; None if they depend on its neighbours."""
        if key[0] == " " != key:
            return [int(key)]
        space, chunk, mark = ("", key[:-1], " ") if key[-1] == " " else (" ", key, "")
        if chunk.isalpha():
            return self.coder.piece_ids(space + chunk) if max(chunk) <= _LAST_PLAIN else self.coder.ids(space + chunk)
        tailed = _TAILED.fullmatch(chunk)
        if tailed is not None:
            return [*self._word(tailed[1] + mark, space + tailed[1], ready), *self.marks[tailed[2]]]
        if joins_a_gap(chunk):
            return None
        pieces = self.coder.plain_pieces(space + chunk)
        if pieces is None:
            return self.coder.ids(space + chunk)
        out: list[int] = []
        for piece in pieces:
            spaced = piece[0] == " " and piece[1:].isalpha()
            out += self._word(piece[1:], piece, ready) if spaced else self.marks[piece]
        return out

    def _store(self) -> None:
        """Code the chunks that wait."""
        ready: dict[str, list[int]] = {}
        starts, sizes, ids, marks = self.starts, self.sizes, self.ids, self.marks
        whole, tokenize, space = self.coder.whole, self.coder.model.tokenize, self.coder.space
        before = len(starts)
        for key in self.numbers.fresh:  # grows meanwhile
            at, alone = len(ids), True
            if key in ready:
                ids.extend(ready[key])
            elif key.isascii() and key.isalpha():
                if " " + key in whole:
                    ids.append(whole[" " + key])
                else:
                    ids.extend(map(_ID, tokenize(space + key)))
            elif key.isascii() and (word := key.rstrip(_MARKS)).isalpha():
                ids.extend(self._word(word, " " + word, ready))
                ids.extend(marks[key[len(word) :]])
            else:
                found = self._code(key, ready) if key else None
                alone = found is not None
                ids.extend(found or ())
            starts.append(at)
            sizes.append(len(ids) - at if alone else -1)
        self.again.extend(bytes(len(starts) - before))
        self.numbers.fresh = []

    def _apart(self, text: str, end: int) -> bytes:
        """A text with chunks that depend on their neighbours."""
        out = array("H")
        for piece, number in self.coder.pieces(text):
            if piece is None:
                out.append(number)
            elif piece:
                begin, *rest = _SAFE_CUT.split(piece)
                out.extend(self.coder.ids(begin))
                for chunk in rest:
                    out.extend(self.coder.ids(" " + chunk))
        out.append(end)
        return out.tobytes()

    def _group(self, texts: list[str], end: int, asked: list[int], bounds: list[int]) -> list[bytes]:
        """The ids of texts whose chunks have the numbers ``asked``, up to a bound each."""
        before = len(self.starts)
        self._store()
        chosen = np.array(asked, np.int32)
        np.frombuffer(self.again, np.uint8)[chosen[chosen < before]] = 1
        sizes = np.frombuffer(self.sizes, np.int32)[chosen]
        gaps = sizes < 0
        places, ends = _runs(np.frombuffer(self.starts, np.int32)[chosen], np.maximum(sizes, 0))
        data = np.frombuffer(self.ids, "<u2")[places].tobytes()
        cuts = (2 * ends[[0, *bounds]]).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        if gaps.any():
            rows = np.searchsorted(bounds, np.flatnonzero(gaps), "right")
            for row in np.unique(rows).tolist():
                out[row] = self._apart(texts[row], end)
        return out

    def encode(self, texts: Iterable[str], end: int) -> Iterator[bytes]:
        """The ids of each text, with the end id behind them."""
        here: list[str] = []
        asked: list[int] = []
        bounds: list[int] = []
        chars, last = 0, f" {end}"
        for text in texts:
            number_of = self.numbers.__getitem__
            for piece, special in self.coder.pieces(text):
                if piece is None:
                    asked.append(number_of(f" {special}"))
                elif piece:
                    first, *chunks = piece.split(" ")
                    asked.append(number_of(first + " "))
                    asked += map(number_of, chunks)
            asked.append(number_of(last))
            here.append(text)
            bounds.append(len(asked))
            chars += len(text)
            if len(asked) >= self.GROUP or chars >= self.GROUP_CHARS:
                yield from self._group(here, end, asked, bounds)
                here, asked, bounds, chars = [], [], [], 0
                if len(self.numbers) > self.most or len(self.ids) > 8 * self.most:
                    self._forget()
        if here:
            yield from self._group(here, end, asked, bounds)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of runs, one run after the other, and where each run begins in that list, with the end."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1]), ends


class WholeTokens(dict):
    """The proven whole tokens, by text; broadcast, with what a worker has learnt from them.

    A worker keeps a broadcast value from task to task of a stage and drops it when a task
    without it begins.
    """

    learnt: Encoder | None = None

    def encoder(self, path: str) -> Encoder:
        """One encoder for all tasks of a worker."""
        if self.learnt is None:
            self.learnt = Encoder(path, self)
        return self.learnt


def encoder(path: str, whole: dict[str, int]):
    """A function from a text to its ids, as little-endian two-byte integers."""
    coded = Encoder(path, whole)
    return lambda text: next(coded.encode([text], 0))[:-2]


def token_counts(docs: DataFrame, path: str, over: int = OVER) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty: no bytes, no tokens. Rows are independent: repeated rows
    give equal results, no rows give none, and other columns are ignored.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(proven_tokens(spark, path))  # at most the vocabulary
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole.value)
        for batch in batches:
            found = [count(text.as_py()) for text in batch.column(2)]
            tokens = pa.array(found, pa.int64())
            limit = pa.array([n > over for n in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, limit], names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
