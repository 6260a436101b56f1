"""Byte-level BPE: token ids of texts, and the texts of token ids.

Pre-tokenisation uses no regular expression. A text becomes an array of code points and
these an array of classes (letter, number, white space, quote, other, and the letters of
the contractions). The pattern is a small automaton over classes; the state after every
character comes from an associative scan: each class is a function on the states, such
functions are composed by a table, first within short columns and then across them. The
boundaries follow from neighbouring states. Equal slices of a part of a batch are found
by comparing them as machine words, and each distinct one is looked up in a cache once.
Those that are new are merged by rank, all of them a step at a time, as arrays.

Ids and offsets are kept as packed little-endian unsigned 32-bit integers. Offsets are
the byte positions at which the tokens begin. Decoding puts every token at its offset, so
any run of tokens can be decoded by itself and comes back with its place in the text.

Defined results
    null text                 empty: no tokens
    repeated rows, null ids   every row is encoded by itself
    very long texts, long runs without a boundary    merged with a heap, n log n
    columns of the same name  replaced by the new ones
    empty table               no rows
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagesieve.llm.arrow import parts, text_bytes

# Classes of characters. Letters that can follow the quote of a contraction have their
# own: E ends 's 't 'm 'd; R V L go on to 're 've 'll; X is the e.
LETTER, NUMBER, BLANK, SPACE, QUOTE, OTHER, END_LETTER, R, V, L, X, BREAK = range(12)
_SPECIAL = {"s": END_LETTER, "t": END_LETTER, "m": END_LETTER, "d": END_LETTER, "r": R, "v": V, "l": L, "e": X}

# States: what the character just read belongs to.
FRESH, WORD, DIGITS, SIGNS, GAP, OPEN, OPEN_R, OPEN_V, OPEN_L, CLOSED = range(10)
_STATES = 10

#: White space outside ASCII, as the pattern understands it.
_WHITE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_COLUMN = 64
_CACHE = 250_000
_PART_BYTES = 1 << 20
_LONG = 64
_NEVER = 1 << 62


#: Letters and numbers that Unicode 16.0 has and 15.1 has not, first and last.
#: The tokenizer's pattern goes by 16.0.
_NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
_NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
#: SHA-256 of the classes of all code points, so that ids cannot change with the Python of a worker.
_CLASSES_SHA256 = "1d31b4679f15baa53668773796261578b4f71dae7fef48eeb4de4425f6866c3a"


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else NUMBER
    for ranges, kind in ((_NEW_LETTERS, LETTER), (_NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[[*range(9, 14), *_WHITE]] = SPACE
    table[ord(" ")], table[ord("'")] = BLANK, QUOTE
    for letter, kind in _SPECIAL.items():
        table[ord(letter)] = kind
    if hashlib.sha256(table.tobytes()).hexdigest() != _CLASSES_SHA256:
        raise RuntimeError(f"Python's Unicode {unicodedata.unidata_version} does not make the classes of 16.0")
    return table


def _step(state: int, kind: int) -> int:
    """The state after a character of class ``kind`` is read in ``state``."""
    if kind == BREAK or kind == SPACE:
        return FRESH
    if kind == BLANK:
        return GAP
    if kind == NUMBER:
        return DIGITS
    if kind == OTHER:
        return SIGNS
    if kind == QUOTE:
        return SIGNS if state in (SIGNS, GAP, OPEN) else OPEN
    if state == OPEN:
        return {END_LETTER: CLOSED, R: OPEN_R, V: OPEN_V, L: OPEN_L}.get(kind, WORD)
    if (state in (OPEN_R, OPEN_V) and kind == X) or (state == OPEN_L and kind == L):
        return CLOSED
    return WORD


@cache
def transition_functions() -> tuple[np.ndarray, np.ndarray]:
    """The functions on states that classes generate, and the table that composes them.

    Row f of the first array holds f(state). ``composed[f, g]`` is the function "f, then g".
    The first rows are the classes themselves, in order.
    """
    known: dict[tuple[int, ...], int] = {}
    for kind in range(12):
        known.setdefault(tuple(_step(s, kind) for s in range(_STATES)), len(known))
    todo = list(known)
    letters = list(known)
    while todo:
        f = todo.pop()
        for g in letters:
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    maps = np.array(list(known), np.uint8)
    composed = np.zeros((len(maps), len(maps)), np.uint8)
    for i, f in enumerate(known):
        for j, g in enumerate(known):
            composed[i, j] = known[tuple(g[s] for s in f)]
    return maps, composed


@cache
def _class_functions() -> np.ndarray:
    """Number of the transition function of each class."""
    maps, _ = transition_functions()
    rows = {tuple(m): i for i, m in enumerate(maps.tolist())}
    return np.array(
        [rows[tuple(_step(s, k) for s in range(_STATES))] for k in range(12)], np.uint8
    )


def scan(functions: np.ndarray) -> np.ndarray:
    """At each place the composition of all functions up to it, by an associative scan."""
    _, composed = transition_functions()
    n = len(functions)
    if n <= _COLUMN:
        out = functions.copy()
        for i in range(1, n):
            out[i] = composed[out[i - 1], out[i]]
        return out
    blocks = -(-n // _COLUMN)
    padded = np.zeros(blocks * _COLUMN, np.uint8)
    padded[:n] = functions
    within = np.ascontiguousarray(padded.reshape(blocks, _COLUMN).T)
    for i in range(1, _COLUMN):
        within[i] = composed[within[i - 1], within[i]]
    before = scan(within[-1])
    within[:, 1:] = composed[before[None, :-1], within[:, 1:]]
    return within.T.reshape(-1)[:n]


# What a state and the next class say about a boundary between them.
_NO, _YES, _IF_TEXT_FOLLOWS, _UNLESS_CLOSED = range(4)


@cache
def _rules() -> np.ndarray:
    """The answer for every state (rows of 12) and class."""
    run = {QUOTE: SIGNS, OTHER: SIGNS, NUMBER: DIGITS}
    was = {OPEN: SIGNS, OPEN_R: WORD, OPEN_V: WORD, OPEN_L: WORD}
    rules = np.full((_STATES, 12), _NO, np.uint8)
    for before in range(_STATES):
        for kind in range(11):
            state = _step(before, kind)
            if kind in (BLANK, SPACE):
                # A run is one slice, but its last character stands alone before a text
                # that goes on; a blank there joins what follows.
                rules[before, kind] = _IF_TEXT_FOLLOWS if before in (FRESH, GAP) else _YES
            elif before == CLOSED or state == OPEN:
                rules[before, kind] = _YES
            elif state in (OPEN_R, OPEN_V, OPEN_L) and before == OPEN:
                rules[before, kind] = _UNLESS_CLOSED
            elif state != CLOSED and before != GAP and run.get(kind, WORD) != was.get(before, before):
                rules[before, kind] = _YES
    return rules.reshape(-1)


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """True where a slice begins, for classes of texts that are set apart by BREAK."""
    if not len(kinds):
        return np.zeros(0, bool)
    fresh = transition_functions()[0][:, FRESH]
    state = fresh[scan(_class_functions()[kinds])]
    before = np.empty_like(state)
    before[0], before[1:] = FRESH, state[:-1]
    rule = _rules()[before * np.uint8(12) + kinds]
    out = rule == _YES
    text = (kinds != BLANK) & (kinds != SPACE) & (kinds != BREAK)
    out[:-1] |= (rule[:-1] == _IF_TEXT_FOLLOWS) & text[1:]
    closed = state == CLOSED
    out[:-1] |= (rule[:-1] == _UNLESS_CLOSED) & ~closed[1:]
    out[-1] |= rule[-1] == _UNLESS_CLOSED
    broken = kinds == BREAK
    out[1:] |= broken[:-1]
    out[0] = True
    return out & ~broken


class Merger:
    """Ids of slices of bytes: a cache over merging by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, bytes] = {}
        self.pairs = PairTable(ranks)
        single = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.single = np.array(single, np.int64)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct slices, packed."""
        new = [p for p in pieces if p not in self.known]
        fresh = dict(zip(new, self._merge_all(new), strict=True))
        get = self.known.get
        out = [get(p) or fresh[p] for p in pieces]
        if len(self.known) + len(fresh) > _CACHE:
            self.known.clear()
        self.known |= {p: x for p, x in fresh.items() if len(p) <= 256}
        return out

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > _LONG:
                out[i] = np.array(self._merged_by_heap(piece), "<u4").tobytes()
            else:
                todo.append(i)
        for i, ids in zip(todo, self._merged_together([pieces[i] for i in todo]), strict=True):
            out[i] = ids
        return out

    def _merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """Merges of all slices at once: in each step every slice merges its neighbours of
        lowest rank, the leftmost ones."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(ids), _NEVER)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self.pairs.get(ids[inside], ids[inside + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            done = least == _NEVER
            if done.any():
                over = np.repeat(done, size)
                packed = ids[over].astype("<u4").tobytes()
                ends = 4 * np.cumsum(size[done])
                for i, a, b in zip(piece[first[done]].tolist(), (ends - 4 * size[done]).tolist(), ends.tolist(), strict=True):
                    out[i] = packed[a:b]
                ids, piece, rank = ids[~over], piece[~over], rank[~over]
                if not len(ids):
                    break
                least, size = least[~done], size[~done]
            lowest = np.flatnonzero(rank == np.repeat(least, size))
            at = lowest[np.concatenate([[True], piece[lowest[1:]] != piece[lowest[:-1]]])]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            at -= np.arange(len(at))
            for left in (at - 1, at):
                near = left[(left >= 0) & (left + 1 < len(ids))]
                near = near[piece[near] == piece[near + 1]]
                rank[near] = self.pairs.get(ids[near], ids[near + 1])
            ended = at[(at + 1 == len(ids)) | (piece[np.minimum(at + 1, len(ids) - 1)] != piece[at])]
            rank[ended] = _NEVER
        return out

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, the leftmost first, until none is known."""
        if len(piece) > _LONG:
            return self._merged_by_heap(piece)
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != _NEVER:
            i = pairs.index(least)
            parts[i : i + 2] = [part := parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + part, _NEVER)
            if i < len(pairs):
                pairs[i] = get(part + parts[i + 1], _NEVER)
        return tuple(map(get, parts))

    def _merged_by_heap(self, piece: bytes) -> tuple[int, ...]:
        """The same in n log n."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged
        prev = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                prev[k] = i
                offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)


class PairTable:
    """Rank of what two tokens make together, for arrays of tokens: an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        known = {
            (left << 32) | right: rank
            for word, rank in ranks.items()
            for k in range(1, len(word))
            if (left := ranks.get(word[:k])) is not None and (right := ranks.get(word[k:])) is not None
        }
        self.bits = max(4, (4 * len(known)).bit_length())
        self.keys = np.full((1 << self.bits) + len(known) + 1, -1, np.int64)
        self.ranks = np.full(len(self.keys), _NEVER)
        keys, values = (np.fromiter(x, np.int64, len(known)) for x in (known.keys(), known.values()))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            # Of keys for one free place the last to be written has it.
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.ranks[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], slot[~placed] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (keys ^ (keys >> 15)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, ``_NEVER`` where a pair makes no token."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        astray = np.flatnonzero((held != keys) & (held != -1))
        while len(astray):
            slot[astray] += 1
            held = self.keys[slot[astray]]
            astray = astray[(held != keys[astray]) & (held != -1)]
        return np.where(self.keys[slot] == keys, self.ranks[slot], _NEVER)


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a line is a token in base 64, and its rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


@cache
def _merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@cache
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another; where each begins; how long it is."""
    ranks = load_ranks(path)
    words = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from ``begin``, ``size`` long, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def slice_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte places at which slices of the texts of ``text_bytes`` begin."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kinds = class_table()[codes]
    between = np.searchsorted(begins, at[1:-1])
    starts = np.flatnonzero(boundaries(np.insert(kinds, between, BREAK)))
    breaks = between + np.arange(len(between))
    return begins[starts - np.searchsorted(breaks, starts)]


def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each distinct slice, and the number of its distinct slice for each.

    Slices of up to 15 bytes are compared as two machine words, which also hold the length;
    longer ones count as distinct.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    short = np.flatnonzero(size < 16)
    first = words[start[short]] & _MASKS[np.minimum(size[short], 8)]
    rest = np.maximum(size[short] - 8, 0)
    second = words[start[short] + 8] & _MASKS[rest] | size[short].astype(np.uint64) << np.uint64(56)
    with np.errstate(over="ignore"):
        mixed = (first ^ (first >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD6E8FEB86659FD93)
    _, example, number = np.unique(mixed, return_index=True, return_inverse=True)
    if not ((first == first[example][number]).all() and (second == second[example][number]).all()):
        both = np.stack([first, second], 1)
        _, example, number = np.unique(both, axis=0, return_index=True, return_inverse=True)
        number = number.reshape(-1)
    of = np.empty(len(start), np.int64)
    of[short] = number
    long = np.flatnonzero(size >= 16)
    of[long] = len(example) + np.arange(len(long))
    return np.concatenate([short[example], long]), of


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def encoded(data: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of ``text_bytes``, and where those of each begin and the last end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    start = slice_starts(data, at)
    size = np.diff(np.append(start, len(data)))
    one, of = _distinct(data, start, size)
    whole = data.tobytes()
    places = zip(start[one].tolist(), (start[one] + size[one]).tolist(), strict=True)
    pieces = [whole[a:b] for a, b in places]
    again: dict[bytes, int] = {}
    number = np.fromiter((again.setdefault(p, len(again)) for p in pieces), np.int64, len(pieces))
    packed = _merger(path).ids(list(again))
    count = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
    tokens = np.frombuffer(b"".join(packed), "<u4")
    of = number[of]
    ids = tokens[_ranges((np.cumsum(count) - count)[of], count[of])]
    before = np.concatenate([[0], np.cumsum(count[of])])
    return ids, before[np.searchsorted(start, at)]


def encode_texts(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    ids, at = encoded(*text_bytes(pa.array(texts, pa.string())), path)
    return (ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False))


def _packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of 32-bit ``values``, parted at ``at``."""
    buffers = [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(values.astype("<u4"))]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``_packed``; a null is empty."""
    column = column.fill_null(b"")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    values = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
    return values[at[0] : at[-1]].astype(np.int64), at - at[0]


def encode(
    docs: DataFrame, path: str, *, text: str = "text", drop_text: bool = False, offsets: bool = True
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and, if wanted, ``offsets`` (see above)."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    new += [T.StructField("offsets", T.BinaryType())] if offsets else []
    names = {"n_tokens", "ids", "offsets"}
    docs = docs.select(*(c for c in docs.columns if c == text or c not in names))
    dropped = names | ({text} if drop_text else set())
    kept = [f for f in docs.schema.fields if f.name not in dropped]
    schema = T.StructType(kept + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _vocabulary(path)[2]
        for part in chain.from_iterable(parts(b, _PART_BYTES) for b in batches):
            data, begin = text_bytes(part.column(text))
            ids, at = encoded(data, begin, path)
            columns = [part.column(f.name) for f in kept]
            columns += [pa.array(np.diff(at)), _packed(ids, at)]
            if offsets:
                size = lengths[ids]
                place = np.cumsum(size) - size - np.repeat(begin[:-1], np.diff(at))
                columns.append(_packed(place, at))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode(
    tokens: DataFrame,
    path: str,
    *,
    ids: str = "ids",
    offsets: str | None = None,
    run_of: tuple[int, int] | None = None,
) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of each row's ids; null ids give no bytes.

    With the column of ``offsets``, every token is put at its own. ``run_of`` (first token,
    number of tokens) then decodes only that run of every row and adds ``begin``, its byte
    place in the text; a run that ends behind the last token is cut there, and one that
    begins there is empty and has no place.
    """
    if run_of and not offsets:
        raise ValueError("a run of tokens has its place from the offsets")
    new = [T.StructField("decoded", T.BinaryType())]
    new += [T.StructField("begin", T.LongType())] if run_of else []
    taken = {f.name for f in new} - {ids, offsets}
    tokens = tokens.drop(*taken)
    schema = T.StructType([*tokens.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begins, lengths = _vocabulary(path)
        for part in chain.from_iterable(parts(b, _PART_BYTES) for b in batches):
            row, at = _unpacked(part.column(ids))
            place = _unpacked(part.column(offsets))[0] if offsets else None
            if run_of:
                first = np.minimum(at[:-1] + run_of[0], at[1:])
                count = np.minimum(run_of[1], at[1:] - first)
                chosen = _ranges(first, count)
                row, place = row[chosen], place[chosen]
                at = np.concatenate([[0], np.cumsum(count)])
            size = lengths[row]
            ends = np.concatenate([[0], np.cumsum(size)])[at]  # of rows, in the decoded bytes
            source = held[_ranges(begins[row], size)]
            begin = np.full(len(at) - 1, -1)
            if offsets:
                some = at[:-1] < at[1:]
                begin[some] = place[at[:-1][some]]
                target = place + np.repeat(ends[:-1] - begin, np.diff(at))
                decoded = np.zeros(len(source), np.uint8)
                decoded[_ranges(target, size)] = source
            else:
                decoded = source
            buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)]
            columns = [*part.columns, pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers)]
            if run_of:
                columns.append(pa.array(begin, pa.int64(), mask=begin < 0))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return tokens.mapInArrow(run, schema)
