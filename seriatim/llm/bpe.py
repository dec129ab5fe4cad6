"""Byte-level BPE encoding and decoding with an index of pair occurrences.

The texts of a batch are cut into pre-tokens; the new ones of a task are laid out in one row of symbols.  An index
maps each mergeable pair's rank to all positions where it occurs.  Ranks are taken in ascending order; a rank's
positions are merged at once, and the lists of the pairs that this makes are extended.  A merge only ever makes pairs
of higher rank than its own, so one ascending pass over the active ranks ends with the ids.

Space-delimited pieces and their ids are remembered within a task, up to ``CACHE_UNITS``.

``Abreast`` finds the same ids in another way, for tasks that meet many new words: those of as many bytes are the
columns of one table, and each round merges the lowest pair of every column.

Defined cases: a null text counts as empty and has no ids; texts and runs of one character are as long as they are;
equal texts get equal ids; the strings of the added tokens become their ids; of pairs of one rank the leftmost merge
first; rows repeat as they came; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.common import WordTable, flat, slices, small, text_slices, texts

TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids a task keeps at most before it starts over.
CACHE_UNITS = 400_000
#: Pre-tokens likewise.
CACHE_WORDS = 250_000
#: Bits for a place within a word of ``Abreast``; longer words go by the pair index.
PLACE_BITS = 5
#: Words that ``Abreast`` merges at once.
COLUMNS_AT_ONCE = 16_384
#: Letters of text that one pass over the ranks takes: a pass costs nearly as much for few new words as for many.
LETTERS_AT_ONCE = 4_000_000
#: Characters that a pre-token's white space is made of.
SPACE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_LONE_SPACE = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
_OTHER_SPACE = re.compile("[" + SPACE.replace("\t-\r ", "\t\x0b-\r") + "]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: bytes that print stand for themselves, the others for U+0100 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@dataclass(frozen=True)
class Vocabulary:
    """Ids of single bytes, merges by pair, the bytes of every id, and the added tokens."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray  # sorted left << 32 | right
    pair_ranks: np.ndarray
    merged_ids: np.ndarray  # by rank
    id_bytes: list[bytes]
    added: dict[str, int]

    @cached_property
    def added_pattern(self) -> re.Pattern | None:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @cached_property
    def flat_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in self.id_bytes], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.frombuffer(b"".join(self.id_bytes), np.uint8), starts, lengths

    @cached_property
    def byte_ranks(self) -> np.ndarray:
        """Rank of each pair of bytes."""
        return self.ranks(self.byte_ids[:, None], self.byte_ids[None, :]).astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where it isn't one."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.merged_ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    symbols, vocab = _byte_symbols(), file["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
    byte_ids = np.zeros(256, np.int64)
    for c, b in symbols.items():
        byte_ids[b] = vocab[c]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    id_bytes = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for s, i in vocab.items():
        id_bytes[i] = s.encode() if s in added else bytes(map(symbols.__getitem__, s))
    for s, i in added.items():
        id_bytes[i] = s.encode()
    return Vocabulary(byte_ids, keys[order], order, np.array([vocab[a + b] for a, b in merges], np.int64), id_bytes, added)


def _leftmost(positions: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of positions in ascending order whose pairs may overlap (a symbol twice), those that a pass from the left merges."""
    kept, blocked = [], -1
    for p in positions.tolist():
        if p != blocked:
            kept.append(p)
            blocked = int(nxt[p])
    return np.array(kept, np.int64)


def encode_pretokens(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and where each word's start (with the end)."""
    lengths = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n, none = int(bounds[-1]), len(v.merged_ids)
    symbol = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = lengths > 0
    nxt[bounds[1:][full] - 1] = -1
    prv[bounds[:-1][full]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, none)
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = v.ranks(symbol[inner], symbol[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        r = rank[positions]
        positions, r = positions[r < none], r[r < none]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        positions, r = positions[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        starts = [0, *cuts.tolist(), len(r)]
        for x, lo, hi in zip(r[starts[:-1]].tolist(), starts, starts[1:], strict=False):
            if x in index:
                index[x].append(positions[lo:hi])
            else:
                index[x] = [positions[lo:hi]]
                heapq.heappush(active, x)

    add(inner)
    while active:
        now = heapq.heappop(active)
        lists = index.pop(now)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[alive[at] & (rank[at] == now)]
        if len(lists) > 1:
            at = np.sort(at)
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        if not len(at):
            continue
        gone = nxt[at]
        if symbol[at[0]] == symbol[gone[0]]:
            at = _leftmost(np.sort(at), nxt)
            gone = nxt[at]
        after, before = nxt[gone], prv[at]
        symbol[at] = v.merged_ids[now]
        alive[gone] = False
        nxt[at] = after
        linked = after >= 0
        prv[after[linked]] = at[linked]
        rank[at] = none
        before = before[before >= 0]
        before = before[alive[before] & (symbol[before] != v.merged_ids[now])]  # else it is merged too, and its own successor
        changed = np.concatenate([at[linked], before])
        rank[changed] = v.ranks(symbol[changed], symbol[nxt[changed]])
        add(changed)
    counts = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], counts[bounds]


class PairIndex:
    """Ids of pieces by the pair index; remembers the ids of pre-tokens, up to ``CACHE_WORDS``."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.words, self.memory = WordTable(), Gathered()

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.memory = WordTable(), Gathered()
        found, bounds = flat([pretokens(p) for p in pieces])
        numbers = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        if self.words.fresh:
            self.memory.grow(*encode_pretokens([w.encode() for w in self.words.fresh], self.v))
            self.words.fresh = []
        ids, ends = self.memory.take(numbers)
        return ids, ends[bounds]


def pretokens(piece: str) -> list[str]:
    """PRETOKEN's matches; a space, letters and then ASCII marks are told apart without it."""
    core = piece.rstrip(_MARKS)
    if core[:1] == " " and core[1:].isalpha():
        return [core, piece[len(core) :]] if len(core) < len(piece) else [core]
    return PRETOKEN.findall(piece)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 a letter, 2 a number, 3 white space, 0 anything else, as PRETOKEN has it."""
    kinds = np.zeros(0x110000, np.uint8)
    for m in regex.finditer(rf"(\p{{L}}+)|(\p{{N}}+)|([{SPACE}]+)", "".join(map(chr, range(0x110000)))):
        kinds[m.start() : m.end()] = m.lastindex
    return kinds


def pretoken_starts(text: str, ends: np.ndarray) -> np.ndarray:
    """True where a match of PRETOKEN starts in ``text``, each part of it searched on its own; ``ends`` has 0 and the parts' ends."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    border = np.zeros(len(points) + 1, bool)
    border[ends] = True
    starts, blank = border[:-1].copy(), kinds == 3
    starts[1:] |= (kinds[1:] != kinds[:-1]) & ((points[:-1] != ord(" ")) | blank[1:])
    starts[1:-1] |= blank[:-2] & blank[1:-1] & ~blank[2:] & ~border[2:-1]  # the last of several blanks before something else
    quotes = np.flatnonzero(starts & (points == ord("'")))
    for i, end in zip(quotes.tolist(), ends[np.searchsorted(ends, quotes, side="right")].tolist(), strict=True):
        after = text[i + 1 : min(i + 3, end)]
        size = 1 if after[:1] in {"s", "t", "m", "d"} else 2 if after in {"re", "ve", "ll"} else 0
        if size:
            starts[i + 1] = False
            if i + 1 + size < end:
                starts[i + 1 + size] = True
    return starts


class Abreast:
    """Ids of pieces; all pre-tokens of one length are merged abreast, a pair each in a round."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text, ends = "".join(pieces), np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=ends[1:])
        data = np.frombuffer(text.encode(), np.uint8)
        at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        begins = at_byte[:-1][pretoken_starts(text, ends)]
        symbol, alive = self.v.byte_ids.astype(np.int32)[data], np.zeros(len(data), bool)
        alive[begins] = True
        sizes = np.diff(begins, append=len(data))
        order = np.argsort(sizes, kind="stable")
        longest = 1 << PLACE_BITS
        cuts = np.searchsorted(sizes[order], np.arange(2, longest + 2)).tolist()
        for size, lo, hi in zip(range(2, longest + 1), cuts[:-1], cuts[1:], strict=True):
            for at in range(lo, hi, COLUMNS_AT_ONCE):
                self._merge(begins[order[at : min(at + COLUMNS_AT_ONCE, hi)]], size, data, symbol, alive)
        long = order[cuts[-1] :]
        if len(long):
            ids, bounds = encode_pretokens([data[a : a + n].tobytes() for a, n in zip(begins[long].tolist(), sizes[long].tolist(), strict=True)], self.v)
            place = np.repeat(begins[long] - bounds[:-1], np.diff(bounds)) + np.arange(len(ids))
            symbol[place], alive[place] = ids, True
        counts = np.zeros(len(data) + 1, np.int64)
        np.cumsum(alive, out=counts[1:])
        return symbol[alive], counts[at_byte[ends]]

    def _merge(self, begins: np.ndarray, size: int, data: np.ndarray, symbol: np.ndarray, alive: np.ndarray) -> None:
        """Merges the words of ``size`` bytes that start at ``begins``: their ids are in ``symbol`` from there on, where ``alive``."""
        v, bits = self.v, PLACE_BITS
        none, mask = len(v.merged_ids) << bits, (1 << bits) - 1
        place = np.arange(size)[:, None]
        rows = data[begins + place]
        ids = symbol[begins + place]
        keys = v.byte_ranks[rows[:-1], rows[1:]] << bits | place[:-1].astype(np.int32)  # rank and place, so the least is the leftmost of its rank
        for n in range(size, 0, -1):
            best = keys[: n - 1].min(axis=0, initial=none)
            going = best < none
            if not going.all():
                done = begins[~going] + place[:n]
                symbol[done], alive[done] = ids[:n, ~going], True
                if not going.any():
                    return
                begins, best, ids, keys = begins[going], best[going], ids[:n, going], keys[: n - 1, going]
            at, made, column = best & mask, v.merged_ids[best >> bits], np.arange(len(best))
            ids[at, column] = made
            for k in range(1, n - 1):
                later = at < k
                np.copyto(ids[k], ids[k + 1], where=later)
                if k < n - 2:
                    np.copyto(keys[k], keys[k + 1] - 1, where=later)
            c = np.flatnonzero(at < n - 2)
            keys[at[c], c] = v.ranks(made[c], ids[at[c] + 1, c]) << bits | at[c]
            c = np.flatnonzero(at > 0)
            keys[at[c] - 1, c] = v.ranks(ids[at[c] - 1, c], made[c]) << bits | at[c] - 1


class Gathered:
    """Id lists by number, kept in one row."""

    def __init__(self) -> None:
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def grow(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, ends[:-1] + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, np.diff(ends).astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.lengths[numbers]
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.ids[np.repeat(self.starts[numbers] - ends[:-1], size) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of whole texts; remembers the ids of space-delimited pieces, which ``learn`` finds (a row of all ids and where each piece's start)."""

    def __init__(self, v: Vocabulary, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.v, self.learn = v, learn or PairIndex(v)
        self.units, self.memory = WordTable(), Gathered()

    def _units(self, text: str) -> list:
        """Pieces that are encoded independently: an added token as a tuple, a first piece with a space before it, else a piece that a space precedes in the text."""
        if self.v.added_pattern and any(x in text for x in self.v.added):
            out = []
            for part in self.v.added_pattern.split(text):
                out += [(part,)] if part in self.v.added else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text:
            return []
        odd = "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text)
        parts = _LONE_SPACE.split(text) if odd else text.split(" ")
        parts[0] = f" {parts[0]}"
        return parts

    def _grow(self) -> None:
        fresh, self.units.fresh = self.units.fresh, []
        special = {i for i, u in enumerate(fresh) if isinstance(u, tuple)}
        ids, ends = self.learn(["" if i in special else u[1:] if u[0] == " " else f" {u}" for i, u in enumerate(fresh)])
        for i in sorted(special):
            ids = np.insert(ids, ends[i], self.v.added[fresh[i][0]])
            ends = ends + (np.arange(len(ends)) > i)
        self.memory.grow(ids, ends)

    def encode(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's start (with the end)."""
        if len(self.units) > CACHE_UNITS:
            self.units, self.memory = WordTable(), Gathered()
        found, bounds = flat([self._units(t) for t in all_texts])
        numbers = np.fromiter(map(self.units.__getitem__, found), np.int64, len(found))
        if self.units.fresh:
            self._grow()
        ids, ends = self.memory.take(numbers)
        return ids, ends[bounds]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    data, starts, lengths = v.flat_bytes
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; ``path`` is the tokenizer's file on each executor."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        encoder = Encoder(v)
        for batch in small(batches):
            all_texts, rows = texts(batch), ([], [], [])
            for part in text_slices(all_texts, LETTERS_AT_ONCE):
                ids, bounds = encoder.encode(all_texts[part])
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = ids[lo:hi]
                    rows[0].append(hi - lo)
                    rows[1].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    rows[2].append(hashlib.sha256(decode(own, v).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every document."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in small(batches):
            all_texts = texts(batch)
            for part in text_slices(all_texts, LETTERS_AT_ONCE):
                ids, bounds = encoder.encode(all_texts[part])
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], column], names=["doc_id", "ids"])

    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in small(batches):
            lists = batch.column("ids").to_pylist()
            for part in slices(len(lists)):
                out = [decode(np.array(x or [], np.int64), v) for x in lists[part]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
