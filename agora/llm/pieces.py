"""SentencePiece encoding and decoding by vectorised merge rounds.

A byte-pair model joins, again and again, the neighbours whose piece scores best, the
leftmost first among equals. Here many words advance at once: their symbols lie in flat
arrays, each round finds the best pair of every word (a segmented minimum), merges it in all
words, and takes finished words out, until no pair remains.

Two facts are proven from the vocabulary before use. Neighbouring characters that lie side by
side in no piece never merge, so a text is cut there. A merged piece that no piece of the same
or a better rank begins or ends with is *calm*: merging one occurrence can't make another pair
due before the next one, so all its occurrences in a word merge in the same round. Of other
pieces a round merges the occurrences up to the first one only.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: How the model writes a space, and the text of an unknown id: fixed values of the format.
SPACE = "▁"
UNKNOWN = " ⁇ "
#: Words that a worker remembers, and the longest of them.
REMEMBERED = 400_000
LONGEST = 64
#: Characters of the texts whose unknown words are encoded together.
TOGETHER = 4_000_000
#: Texts by which the model is shown to take them as they are.
_PLAIN_TEXTS = ["a", " a  b ", "\t\n\r\x00 x", "ﬁ ½ Å é 　Ａ", SPACE, "<s></s><unk><0x41>"]
_NO_RANK = np.int32(np.iinfo(np.int32).max)
_CODE_POINTS = 0x110000


#: An odd multiplier that spreads keys over a table (golden ratio).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def hash_table(keys: np.ndarray) -> np.ndarray:
    """Places of the keys, -1 elsewhere, by open addressing; at most a quarter is filled."""
    bits = max(4, int(4 * len(keys)).bit_length())
    table = np.full(1 << bits, -1, dtype=np.int32)
    for place, slot in enumerate(_slots(keys, len(table)).tolist()):
        while table[slot] >= 0:
            slot = (slot + 1) % len(table)
        table[slot] = place
    return table


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def places_of(wanted: np.ndarray, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of every wanted key among the keys, -1 for others."""
    slots = _slots(wanted, len(table))
    places = table[slots]
    open_ = np.flatnonzero((places >= 0) & (keys[places] != wanted))
    while len(open_):
        slots[open_] = (slots[open_] + 1) % len(table)
        places[open_] = table[slots[open_]]
        here = places[open_]
        open_ = open_[(here >= 0) & (keys[here] != wanted[open_])]
    return places


class PieceModel:
    """The pieces of a model file and what follows from them alone."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.size = library.get_piece_size()
        names = [library.id_to_piece(k) for k in range(self.size)]
        bytes_ = [k for k in range(self.size) if library.is_byte(k)]
        control = [library.is_control(k) for k in range(self.size)]
        special = {*bytes_, library.unk_id(), *(k for k in range(self.size) if control[k])}
        self.unknown = library.unk_id()
        if len(bytes_) != 256 or any(map(library.is_unused, range(self.size))):
            raise ValueError("a model with byte pieces and without unused pieces is needed")
        if any(library.normalize(text) != SPACE + text.replace(" ", SPACE) for text in _PLAIN_TEXTS):
            raise ValueError("a model that takes texts as they are is needed")
        self.byte_ids = np.array(bytes_, dtype=np.int32)
        own = {name: k for k, name in enumerate(names) if k not in special}
        order = {score: rank for rank, score in enumerate(sorted({library.get_score(k) for k in own.values()}, reverse=True))}
        rank = {name: order[library.get_score(k)] for name, k in own.items()}
        self._symbols(own)
        self._pairs(own, rank)
        self._calm(own, rank)
        texts = [b"" if control[k] else name.replace(SPACE, " ").encode() for k, name in enumerate(names)]
        for value, k in enumerate(bytes_):
            texts[k] = bytes([value])
        texts[self.unknown] = UNKNOWN.encode()
        self.texts = texts
        self.starts_blank = [name.startswith(SPACE) and k not in special for k, name in enumerate(names)]
        self.controls = control
        self.decimals = [str(k) for k in range(self.size)]
        self.alone = "".join(sorted(set("\n\t\r") - {c for name in own if len(name) > 1 for c in name}))
        self.run = self._blank_run(own)

    @classmethod
    def of(cls, facts: dict) -> PieceModel:
        """A model from the facts of another one, which travel without the class."""
        model = cls.__new__(cls)
        model.__dict__.update(facts)
        return model

    def _symbols(self, own: dict[str, int]) -> None:
        """The symbol of every character: its piece, or a number above all pieces."""
        self.symbol = np.arange(_CODE_POINTS, dtype=np.int32) + np.int32(self.size)
        for name, k in own.items():
            if len(name) == 1:
                self.symbol[ord(name)] = k
        self.width = np.int64(self.size + _CODE_POINTS)

    def _pairs(self, own: dict[str, int], rank: dict[str, int]) -> None:
        """Sorted keys of all pairs that merge, with the rank and the id of what they make."""
        found, near = [], set()
        for name, k in own.items():
            near.update(zip(name, name[1:]))
            for cut in range(1, len(name)):
                parts = name[:cut], name[cut:]
                ids = [int(self.symbol[ord(part)]) if len(part) == 1 else own.get(part) for part in parts]
                if None not in ids:
                    found.append((ids[0] * int(self.width) + ids[1], rank[name], k))
        found.sort()
        self.keys, self.ranks, self.made = (np.array(column, dtype=kind) for column, kind in zip(zip(*found), ("i8", "i4", "i4")))
        self.near = np.array(sorted(ord(a) * _CODE_POINTS + ord(b) for a, b in near), dtype=np.int64)
        self.key_table, self.near_table = hash_table(self.keys), hash_table(self.near)

    def _calm(self, own: dict[str, int], rank: dict[str, int]) -> None:
        self.calm = np.ones(self.size, dtype=bool)
        for name, place in rank.items():
            for cut in range(1, len(name)):
                for part in (name[:cut], name[cut:]):
                    if part in own and place <= rank[part]:
                        self.calm[own[part]] = False

    def _blank_run(self, own: dict[str, int]) -> int:
        """The number of spaces that a long run of them loses to its first piece; 0 if not proven.

        Cutting a run there is right if the first piece of every longer run is that longest
        piece: nothing merges with it, and what follows is encoded as a run of its own.
        """
        runs = [len(name) for name in own if set(name) == {SPACE}]
        most = max(runs, default=0)
        whole = own.get(SPACE * most)
        if most < 2 or any(len(name) > most and name.startswith(SPACE * 2) for name in own):
            return 0
        for length in range(most + 2, 4 * most):
            run, rest = self.merge([" " * length, " " * (length - most)])
            if run != whole.to_bytes(4, "little") + rest:
                return 0
        return most

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = places_of(left * self.width + right, self.key_table, self.keys)
        there = place >= 0
        return np.where(there, self.ranks[place], _NO_RANK), np.where(there, self.made[place], 0)

    def _segments(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the stretches inside which characters may merge."""
        cut = places_of(points[:-1] * _CODE_POINTS + points[1:], self.near_table, self.near) < 0
        cut[ends[:-1] - 1] = True
        return np.concatenate([[0], np.cumsum(cut)])

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of every word (none of them empty), four bytes each; a space stands for the model's own sign."""
        sizes = np.array([len(word) for word in words])
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        symbols = self.symbol[points].astype(np.int64)
        segment = self._segments(points, ends)
        at = np.arange(len(symbols))
        rank = np.full(len(symbols), _NO_RANK, dtype=np.int32)
        made = np.zeros(len(symbols), dtype=np.int32)
        inside = np.flatnonzero(segment[1:] == segment[:-1])
        rank[inside], made[inside] = self._lookup(symbols[inside], symbols[inside + 1])
        done_at, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(symbols)))
            live = best < _NO_RANK
            if not live.all():  # finished segments leave
                stays = np.repeat(live, spans)
                done_at.append(at[~stays])
                done_symbols.append(symbols[~stays])
                symbols, segment, at, rank, made = (a[stays] for a in (symbols, segment, at, rank, made))
                best, spans = best[live], spans[live]
                if not len(symbols):
                    break
            taken = self._due(rank == np.repeat(best, spans), segment, made)
            symbols[taken] = made[taken]
            kept = np.ones(len(symbols), dtype=bool)
            kept[taken + 1] = False
            place = (np.cumsum(kept) - 1)[taken]
            symbols, segment, at, rank, made = (a[kept] for a in (symbols, segment, at, rank, made))
            rank[place] = _NO_RANK
            mark = np.zeros(len(symbols), dtype=bool)
            mark[place] = mark[place[place > 0] - 1] = True
            touched = np.flatnonzero(mark[:-1] & (segment[1:] == segment[:-1]))
            rank[touched], made[touched] = self._lookup(symbols[touched], symbols[touched + 1])
        order = np.argsort(np.concatenate(done_at))
        places, symbols = np.concatenate(done_at)[order], np.concatenate(done_symbols)[order]
        return self._with_bytes(symbols, np.searchsorted(places, ends))

    def _due(self, hit: np.ndarray, segment: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Where a round merges: leftmost pairs that don't overlap, up to the first that isn't calm."""
        places = np.flatnonzero(hit)
        first = np.concatenate([[True], places[1:] != places[:-1] + 1])
        head = np.maximum.accumulate(np.where(first, places, 0))
        places = places[(places - head) % 2 == 0]
        own = segment[places]
        begins = np.concatenate([[True], own[1:] != own[:-1]])
        restless = ~self.calm[made[places]]
        before = np.cumsum(restless) - restless
        return places[before == np.maximum.accumulate(np.where(begins, before, 0))]

    def _with_bytes(self, symbols: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Symbols cut into words, characters without a piece replaced by their bytes."""
        strange = np.flatnonzero(symbols >= self.size)
        if len(strange):
            codes = [np.frombuffer(chr(p).encode(), dtype=np.uint8) for p in (symbols[strange] - self.size).tolist()]
            spans = np.ones(len(symbols), dtype=np.int64)
            spans[strange] = [len(code) for code in codes]
            bounds = np.concatenate([[0], np.cumsum(spans)])
            wide = np.repeat(symbols, spans)
            wide[np.repeat(symbols >= self.size, spans)] = self.byte_ids[np.concatenate(codes)]
            symbols, ends = wide, bounds[ends]
        flat, bounds = symbols.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


class PieceCoder:
    """Ids of texts and texts of ids, with short words remembered."""

    def __init__(self, model: PieceModel):
        self.model, self.known, self.old = model, {}, {}
        # The library writes one replacement character for each byte that is part of no character.
        codecs.register_error("each byte", lambda error: ("�" * (error.end - error.start), error.end))
        # A word and the spaces before it; a character that merges with nothing; spaces at the end.
        alone = re.escape(model.alone)
        self.words = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +")
        run = model.run
        self.runs = re.compile(f" {{{run}}}(?= {{{run + 2}}})") if run else None

    def _cut(self, text: str) -> list[str]:
        """The keys of a text's words.

        A key is a word without the one space before it, or begins with a line feed that merges
        with nothing, or stands for the whole word behind the model's sign for a space.
        """
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "\n" in self.model.alone:
            apart = text.replace("\n", " \n")
            if apart[0] != " " and apart[-1] != " " and "  " not in apart:
                return apart.split(" ")
        words = self.words.findall(" " + text)
        if self.runs is not None and " " * (2 * self.model.run + 2) in text:
            words = [part for word in words for part in self._parts(word)]
        return [SPACE + word for word in words]

    @staticmethod
    def _word(key: str) -> str:
        return key[1:] if key[0] == SPACE else key if key[0] == "\n" else " " + key

    def _parts(self, word: str) -> list[str]:
        """A word, with long runs of spaces before it cut into pieces from the left."""
        parts, at = [], 0
        for found in iter(lambda: self.runs.match(word, at), None):
            parts.append(found[0])
            at = found.end()
        return [*parts, word[at:]]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text; the unknown words of all of them are merged together."""
        cut = [self._cut(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        missing = set().union(*cut).difference(self.known)
        here = {word: self.old[word] for word in missing & self.old.keys()}
        missing = list(missing - here.keys())
        if missing:
            here.update(zip(missing, self.model.merge(list(map(self._word, missing)))))
        self.known.update(here)
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4") for words in cut]
        for word in here:
            if len(word) > LONGEST:
                del self.known[word]
        return found

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; the space that encoding puts first is taken away."""
        model = self.model
        text = b"".join(map(model.texts.__getitem__, ids)).decode("utf-8", "each byte")
        first = next((k for k in ids if not model.controls[k]), None)  # control ids have no text
        return text[1:] if first is not None and model.starts_blank[first] else text


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def piece_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` and ``decoded`` if asked for.

    Texts are encoded without begin and end ids; the decoded text is made from these ids alone.
    A null text counts as empty: no ids, an empty decoded text. Rows are independent: repeated
    rows give equal results, no rows give none, other columns are ignored. A text of any length
    is encoded as a whole; the memory for it is some hundred bytes per character.
    """
    model = docs.sparkSession.sparkContext.broadcast(vars(PieceModel(path)))  # of the vocabulary's size
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def digest(value: str) -> str:
        return hashlib.sha256(value.encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(PieceModel.of(model.value))
        decimal = coder.model.decimals.__getitem__
        for batch in batches:
            sizes, id_sums, text_sums, ids_kept, texts_kept = [], [], [], [], []
            for group in _groups(batch.column(1).to_pylist()):
                for ids in map(np.ndarray.tolist, coder.encode_all(group)):
                    decoded = coder.decode(ids)
                    sizes.append(len(ids))
                    id_sums.append(digest(",".join(map(decimal, ids))))
                    text_sums.append(digest(decoded))
                    if with_ids:
                        ids_kept.append(ids)
                        texts_kept.append(decoded)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            if with_ids:
                arrays += [pa.array(ids_kept, pa.list_(pa.int32())), pa.array(texts_kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kinds = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(coded, kinds + (", ids array<int>, decoded string" if with_ids else ""))
