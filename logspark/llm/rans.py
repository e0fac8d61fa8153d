"""Static range asymmetric numeral coding of id blocks in numpy, many blocks and lanes at once.

One frequency table of total ``2**PRECISION`` serves all blocks. A block deals its ids over ``LANES``
interleaved states: id ``i`` belongs to lane ``i % LANES``. States stay in [2**31, 2**63) and pass out at
most one 32-bit word an id. Coding runs from the last step to the first; at every ``CHECKPOINT`` steps the
states and the place in the words are kept, so a reader may start there and all stretches between
checkpoints are decoded side by side. A stretch must end in the states of the next one.

A frame is one block with what is needed to read it alone: counts, the documents it touches, checkpoints,
words, and CRC-32 sums of all this and of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

PRECISION = 20
LANES = 64
BLOCK = 1 << 16
CHECKPOINT = 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<IIIIII")
START = 8
MAGIC = b"TIB1"
U64 = np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of ``2**PRECISION``, at least 1 for every id that occurs."""
    counts = [int(c) for c in counts]
    whole, total, n = 1 << PRECISION, sum(counts), sum(c > 0 for c in counts)
    if n > whole:
        raise ValueError(f"more than {whole} different ids")
    scaled = [max(1, c * (whole - n) // total) if c else 0 for c in counts]
    spare = whole - sum(scaled)
    for i in sorted(range(len(counts)), key=lambda i: -counts[i])[:n]:
        more = min(spare, -(-spare * counts[i] // total))
        scaled[i] += more
        spare -= more
    return np.array(scaled, np.int64)


@dataclass
class Table:
    """The shared frequency table by id."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.f = self.freq.astype(U64)
        self.first = np.r_[0, np.cumsum(self.freq)[:-1]].astype(U64)
        self.usual = int(self.freq.argmax()) if len(self.freq) else 0

    @cached_property
    def by_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


def encode(table: Table, blocks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of ids (a multiple of LANES): checkpoint states, their places in the words, and the words."""
    g, n = blocks.shape
    steps = n // LANES
    ids = blocks.reshape(g, steps, LANES)
    marks = -(-steps // CHECKPOINT)
    states = np.empty((marks, g, LANES), U64)
    places = np.empty((marks, g), np.int64)
    words = np.empty((g, n), np.uint32)
    end = np.full(g, n)
    x = np.full((g, LANES), LOW)
    shift, precision = U64(63 - PRECISION), U64(PRECISION)
    for t in range(steps - 1, -1, -1):
        f = table.f[ids[:, t]]
        over = x >= f << shift
        rank = np.cumsum(over, axis=1)
        end -= rank[:, -1]
        row, lane = np.nonzero(over)
        words[row, end[row] + rank[row, lane] - 1] = x[row, lane] & U64(0xFFFFFFFF)
        x = np.where(over, x >> WORD, x)
        q = x // f
        x = (q << precision) + (x - q * f) + table.first[ids[:, t]]
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT], places[t // CHECKPOINT] = x, end
    return [(states[:, i], places[:, i] - end[i], words[i, end[i] :]) for i in range(g)]


def decode(table: Table, states: np.ndarray, places: np.ndarray, words: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of equally many steps: ids by row, and the states and places at their ends."""
    out = np.empty((len(states), steps, LANES), np.uint32)
    x, at = states.copy(), places.astype(np.int64).copy()
    mask, precision = U64((1 << PRECISION) - 1), U64(PRECISION)
    last = len(words) - 1
    for t in range(steps):
        slot = x & mask
        ids = table.by_slot[slot]
        out[:, t] = ids
        x = table.f[ids] * (x >> precision) + slot - table.first[ids]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        if last >= 0:
            word = words[np.minimum(at[:, None] + rank - 1, last)].astype(U64)
            x = np.where(need, (x << WORD) | word, x)
        at += rank[:, -1]
    return out.reshape(len(states), steps * LANES), x, at


@dataclass
class Docs:
    """Documents of a part in order: id, whether it is null, first place in the part, number of ids."""

    ids: np.ndarray
    null: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def touching(self, first: int, last: int) -> Docs:
        a = np.searchsorted(self.starts, first, side="right") - 1
        b = np.searchsorted(self.starts, last, side="left")
        return Docs(self.ids[a:b], self.null[a:b], self.starts[a:b], self.sizes[a:b])

    def to_bytes(self) -> bytes:
        return b"".join(np.ascontiguousarray(a, k).tobytes() for a, k in ((self.ids, "<i8"), (self.starts, "<i8"), (self.sizes, "<i8"), (self.null, "u1")))


def frame(ids: np.ndarray, docs: Docs, states: np.ndarray, places: np.ndarray, words: np.ndarray) -> bytes:
    body = docs.to_bytes() + places.astype("<u4").tobytes() + np.ascontiguousarray(states, "<u8").tobytes() + words.astype("<u4").tobytes()
    rest = HEAD.pack(len(ids), len(docs.ids), len(states), len(words), CHECKPOINT, zlib.crc32(ids.astype("<u4").tobytes())) + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def frames(table: Table, blocks: list[np.ndarray], docs: list[Docs]) -> list[bytes]:
    """Frames of equally long blocks; ids that fill up the last step are the most usual one."""
    fill = -len(blocks[0]) % LANES
    rows = np.stack([np.r_[b, np.full(fill, table.usual, b.dtype)] for b in blocks])
    return [frame(b, d, *coded) for b, d, coded in zip(blocks, docs, encode(table, rows))]


@dataclass
class Frame:
    """A frame that was read and checked against its sum."""

    raw: bytes

    def __post_init__(self) -> None:
        if len(self.raw) < START + HEAD.size or self.raw[:4] != MAGIC or struct.pack("<I", zlib.crc32(memoryview(self.raw)[START:])) != self.raw[4:START]:
            raise ValueError("a frame is damaged")
        self.n, self.n_docs, self.marks, n_words, self.every, self.ids_sum = HEAD.unpack_from(self.raw, START)
        at = START + HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.raw, kind, n, at)
            at += out.nbytes
            return out

        d = self.n_docs
        ids, starts, sizes, null = take("<i8", d), take("<i8", d), take("<i8", d), take("u1", d)
        self.docs = Docs(ids, null, starts, sizes)
        self.places, self.states = take("<u4", self.marks).astype(np.int64), take("<u8", self.marks * LANES).reshape(self.marks, LANES)
        self.words = take("<u4", n_words)

    @property
    def steps(self) -> int:
        return -(-self.n // LANES)

    def stretch(self, k: int) -> int:
        """Steps from checkpoint ``k`` to the next one or the end."""
        return min(self.every, self.steps - k * self.every)


def read(table: Table, held: list[Frame]) -> list[np.ndarray]:
    """Ids of whole frames; all stretches of one length run side by side, and all sums are checked."""
    base = np.r_[0, np.cumsum([len(h.words) for h in held])]
    words = np.concatenate([h.words for h in held])
    jobs: dict[int, list[tuple[int, int]]] = {}
    for i, h in enumerate(held):
        for k in range(h.marks):
            jobs.setdefault(h.stretch(k), []).append((i, k))
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] * h.marks for h in held]
    for steps, chosen in jobs.items():
        ids, ends, at = decode(table, np.stack([held[i].states[k] for i, k in chosen]), np.array([base[i] + held[i].places[k] for i, k in chosen]), words, steps)
        for (i, k), row, end, place in zip(chosen, ids, ends, at):
            h = held[i]
            more = k + 1 < h.marks
            if place != base[i] + (h.places[k + 1] if more else len(h.words)) or not np.array_equal(end, h.states[k + 1] if more else np.full(LANES, LOW)):
                raise ValueError("a checkpoint doesn't fit")
            parts[i][k] = row
    out = [np.concatenate(p)[: h.n] for p, h in zip(parts, held)]
    for ids, h in zip(out, held):
        if zlib.crc32(ids.astype("<u4").tobytes()) != h.ids_sum:
            raise ValueError("ids don't fit their sum")
    return out


def read_range(table: Table, h: Frame, first: int, last: int) -> np.ndarray:
    """Ids [first, last) of one frame, decoded from the nearest checkpoint before them."""
    width = h.every * LANES
    out = []
    for k in range(first // width, -(-min(last, h.n) // width)):
        out.append(decode(table, h.states[k : k + 1], h.places[k : k + 1], h.words, h.stretch(k))[0][0])
    if not out:
        return np.zeros(0, np.uint32)
    begin = first // width * width
    return np.concatenate(out)[first - begin : min(last, h.n) - begin]


_ZEROS: list[list[int]] = []


def _apply(matrix: list[int], value: int) -> int:
    out = 0
    for row in matrix:
        if value & 1:
            out ^= row
        value >>= 1
    return out


def joined_crc(left: int, right: int, size: int) -> int:
    """CRC-32 of two byte strings one after the other, from their sums and the size of the second.

    Appending a zero bit is a linear map of the sum; its powers by squaring carry ``left`` over ``size`` bytes.
    """
    if not _ZEROS:
        one = [zlib.crc32(b"\0", bit ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for bit in (1 << i for i in range(32))]
        _ZEROS.append(one)
        while len(_ZEROS) < 48:
            _ZEROS.append([_apply(_ZEROS[-1], row) for row in _ZEROS[-1]])
    for k, matrix in enumerate(_ZEROS):
        if size >> k & 1:
            left = _apply(matrix, left)
    return left ^ right
