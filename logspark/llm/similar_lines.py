"""Line deduplication by an exact set-similarity join (PPJoin, Xiao et al. 2008).

A line is the set of its words (A-Z lower-cased). Lines match when 100 * intersection >= 80 * union. A line
that matches an earlier one, by (doc_id, line number), is removed; the earlier one need not stay itself.

1. Rarity: words are counted in 2**18 hashed buckets, a table of fixed size that every task can hold. The
   order (bucket count, hash) is a total order of words, which is all that the prefix filter needs.
2. Equal sets are matched by their digests. A task sends the words of one of equal lines per ``PACK_BYTES``
   of text, so copies, however many, cost a task a few lines from here on, and equal lines ask for no candidate.
3. Prefix filter: matching lines of n words share one of their n - ceil(0.8 n) + 1 rarest words. Each such
   word is a posting; postings are shuffled by word and meet in order.
4. Length filter, positional filter, and a parity filter: words toggle bits of a mask, so masks of matching
   lines differ in no more bits than the sets have words apart. A mask has 64 bits, from ``WIDE`` words on 128
   and from twice as many on 256; the wider of two is folded onto the narrower. No filter loses a match.
5. Whether a line goes: of the candidates before it the earliest is verified on the full sets; lines that it
   does not settle come back for their next candidates, 64 times as many each round, until nothing is open.
6. The join itself: all candidate pairs of representatives (the earliest line of each class of equal sets) are
   verified in one pass; a line has the links of its class. The query returns these beside the removed lines.
   Where a word has more than ``DENSE`` candidate pairs for each of its postings, postings join the first one
   they fit, and a large group so made is sent as its members: all its pairs are compared, none is a row.
7. Verification: the pairs of a line go to the tile of its earliest candidate, so that pairs of one group meet,
   and a set is sent once to each tile that has a pair of it. Tiles of more than ``TILE_PAIRS`` pairs are split
   along both lines of a pair, groups into pairs of blocks of about ``BLOCK`` members. A pair counts in the
   least group that has both lines, and as a pair of its own if none has. Counts of links by line come back.

Scale: words that occur more than ``HEAVY`` times are dealt to pairs of blocks, so no word gathers all its
postings in one task; candidates per round of step 5 are at most one per posting times the round's quota, never
all pairs. Step 6 grows with the number of candidate pairs, which no quota bounds. Sets are read again for candidate lines only, found by a bitmap of fixed size and an exact join;
they travel as the upper 40 bits of each word's 64-bit hash, which stand for the words in verification.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.graph import stored
from logspark.llm.text import U64, Texts, binary_ranges, mix, signed, slices, texts_of

PERCENT = 80
BUCKET_BITS = 18
CHUNK = 1 << 12
HEAVY = 1 << 20
MAP_BITS = 23
WIDTH = 5
PAIRS = 1 << 17
SMALL_GROUP = 1 << 11
#: Least size of a set whose parity mask has two words.
WIDE = 96
TILE_PAIRS = 1 << 12
DENSE = 16
BLOCK = 256
#: Words of the sets that are compared at once.
COMPARED = 1 << 20
RUN_SETS = 1 << 12
#: Bytes of text whose postings are packed together.
PACK_BYTES = 4 << 20
Batches = Iterator[pa.RecordBatch]


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Fewest common words of matching sets with ``n`` words together."""
    return -(-PERCENT * n // (100 + PERCENT))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - BUCKET_BITS)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur; the result has a fixed size of one megabyte."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(bucket(texts_of(part.column("text"), lower=True).words), minlength=len(total))
        bounds = np.arange(0, len(total) + 1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bounds) - 1)), binary_ranges(total, bounds)], ["chunk", "counts"])

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk bigint, counts binary"
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        total[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int64)
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def line_sets(texts: Texts, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct words by line, rarest first (or by hash): line numbers over all texts, words, and the line's text."""
    starts, _, owner = texts.lines
    line = np.searchsorted(starts, texts.starts, side="right") - 1
    if counts is None:
        order = np.lexsort((texts.words, line))
    else:
        order = np.lexsort((texts.words, (line.astype(U64) << U64(32)) | counts[bucket(texts.words)]))
    line, words = line[order], texts.words[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    return line[fresh], words[fresh], owner


def ranges(bounds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions bounds[i] .. bounds[i] + lengths[i] - 1, one range after the other."""
    return np.repeat(bounds - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


LINES = "doc_id bigint, line int, n int, d1 bigint, d2 int, shard int, load binary"
#: Columns of a posting and their types in a load.
POSTING = {"key": np.uint32, "place": np.int32, "n": np.int32, "doc_id": np.int64, "line": np.int32, "parity": np.uint64, "same": np.uint32, "part1": np.uint64, "part2": np.uint64, "part3": np.uint64}


def line_rows(counts: np.ndarray, min_tokens: int, shards: int) -> Callable[[Batches], Batches]:
    """Lines with the digests of their sets (shard is null), and the postings of each batch by shard, packed."""

    def run(batches: Batches) -> Batches:
        names = [c.split()[0] for c in LINES.split(", ")]

        def flushed() -> Batches:
            rows = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
            size = len(rows["n"])
            columns = [rows["doc_id"], rows["line"].astype(np.int32), rows["n"].astype(np.int32), rows["d1"].view(np.int64), (rows["d2"] >> U64(32)).astype(np.uint32).view(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
            yield packed(rows, *map(np.concatenate, zip(*postings)), shards, names)

        made, postings, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text"), lower=True)
                line, words, owner = line_sets(texts, counts)
                lines, first, n = np.unique(line, return_index=True, return_counts=True)
                large, all_first, all_n = n >= min_tokens, first, n
                lines, first, n = lines[large], first[large], n[large]
                if not len(lines):
                    continue
                total = np.zeros((2, len(words) + 1), U64)
                np.cumsum(words, out=total[0, 1:])
                np.cumsum(mix(words + U64(3)), out=total[1, 1:])
                digest = total[:, first + n] - total[:, first]
                bits = U64(1) << (mix(words) & U64(63))
                wide = np.repeat(mask_words(all_n) - 1, all_n)
                at_word = (mix(words) >> U64(6)).astype(np.int64) & wide
                # Sets of fewer than four words match equal sets only.
                length = np.where(n >= 4, n - (PERCENT * n + 99) // 100 + 1, 0)
                at = ranges(first, length)
                holder = np.repeat(np.arange(len(lines)), length)
                blocks = -(-counts[bucket(words[at])].astype(np.int64) // HEAVY)
                own = (mix(digest[0])[holder] % blocks.astype(U64)).astype(np.int64)
                again = np.repeat(np.arange(len(at)), blocks)
                other = ranges(np.zeros(len(at), np.int64), blocks)
                low, high = np.minimum(own[again], other), np.maximum(own[again], other)
                before = sum(len(m["n"]) for m in made)
                made.append(
                    {
                        "doc_id": part.column("doc_id").to_numpy()[owner[lines]],
                        "line": lines - np.searchsorted(owner, owner[lines]),
                        "n": n,
                        "d1": digest[0],
                        "d2": digest[1],
                        "parity": np.bitwise_xor.reduceat(bits, all_first)[large],
                        **{f"part{k}": np.bitwise_xor.reduceat(np.where(at_word == k, bits, U64(0)), all_first)[large] for k in (1, 2, 3)},
                    }
                )
                key = mix(words[at][again] ^ ((low << 20) + high).astype(U64)) >> U64(32)
                postings.append((key.astype(np.uint32), (at - first[holder])[again], before + holder[again]))
                held += len(texts.data)
                if held >= PACK_BYTES:
                    yield from flushed()
                    made, postings, held = [], [], 0
        if made:
            yield from flushed()

    return run


def packed(rows: dict[str, np.ndarray], key: np.ndarray, place: np.ndarray, holder: np.ndarray, shards: int, names: list[str]) -> pa.RecordBatch:
    """The postings of a batch, one compressed load for each shard; of equal lines those of the earliest."""
    order = np.lexsort((rows["line"], rows["doc_id"], rows["d2"], rows["d1"]))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (rows["d1"][order[1:]] == rows["d1"][order[:-1]]) & (rows["d2"][order[1:]] == rows["d2"][order[:-1]])
    key, place, holder = (x[~later[holder]] for x in (key, place, holder))
    shard = key % np.uint32(shards)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    rows = {**rows, "same": rows["d1"] >> U64(32)}
    rows = {c: rows[c].astype(kind) for c, kind in POSTING.items() if c in rows}
    holder = holder[order]
    columns = {c: {"key": key, "place": place}[c][order].astype(kind) if c in ("key", "place") else rows[c][holder] for c, kind in POSTING.items()}
    loads = [load_of({c: v[a:b] for c, v in columns.items()}) for a, b in zip(first, np.r_[first[1:], len(order)])]
    empty = [pa.nulls(len(loads), k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([*empty, pa.array(found.astype(np.int32)), pa.array(loads, pa.binary())], names)


def present(n: np.ndarray) -> dict[str, np.ndarray]:
    """The postings that have a second, and a third and fourth word of their mask; of others these are 0 and not stored."""
    words = mask_words(n)
    return {"part1": words > 1, "part2": words > 2, "part3": words > 2}


def load_of(p: dict[str, np.ndarray]) -> bytes:
    """Postings as one value: lines are in order, so differences are small; bytes of equal weight stand together."""
    some = present(p["n"])
    parts = [np.diff(p[c], prepend=p[c].dtype.type(0)) if c == "doc_id" else p[c][some[c]] if c in some else p[c] for c in POSTING]
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in parts)
    sizes = np.array([len(planes), len(p["key"])], np.int64).tobytes()
    return sizes + pa.compress(planes, "zstd", asbytes=True)


def unpacked(load: bytes) -> dict[str, np.ndarray]:
    total, n = (int(x) for x in np.frombuffer(load[:16], np.int64))
    planes = np.frombuffer(pa.decompress(load[16:], total, "zstd", asbytes=True), np.uint8)
    out: dict[str, np.ndarray] = {}
    at = 0
    for name, kind in POSTING.items():
        some = present(out["n"])[name] if name.startswith("part") else None
        rows, size = n if some is None else int(some.sum()), np.dtype(kind).itemsize
        column = np.ascontiguousarray(planes[at : at + rows * size].reshape(size, rows).T).view(kind).ravel()
        if some is None:
            out[name] = column
        else:
            out[name] = np.zeros(n, kind)
            out[name][some] = column
        at += rows * size
    out["doc_id"] = np.cumsum(out["doc_id"])
    return out


CANDIDATES = "doc_id bigint, line int, to_doc bigint, to_line int, more boolean"


def mask_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the parity mask of a set of ``n`` words."""
    return np.where(n < WIDE, 1, np.where(n < 2 * WIDE, 2, 4))


def fitting(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of postings that pass the length, positional and parity filters."""
    n, m = p["n"][x], p["n"][y]
    small, large = np.minimum(n, m), np.maximum(n, m)
    both = n + m
    need = least_overlap(both)
    rest = np.minimum(n - p["place"][x], m - p["place"][y])
    differ = p["parity"][x] ^ p["parity"][y]
    out = (100 * small >= PERCENT * large) & (rest >= need) & (np.bitwise_count(differ) <= both - 2 * need)
    # "parity" is the mask folded to 64 bits; its first word follows from it and the others.
    at = np.flatnonzero(out & (small >= WIDE))
    if len(at):
        a, b = x[at], y[at]
        one, two, three = (p[c][a] ^ p[c][b] for c in ("part1", "part2", "part3"))
        zero = differ[at] ^ one ^ two ^ three
        halves = np.bitwise_count(zero ^ two).astype(np.int64) + np.bitwise_count(one ^ three)
        whole = np.sum([np.bitwise_count(w).astype(np.int64) for w in (zero, one, two, three)], axis=0)
        out[at] = np.where(small[at] < 2 * WIDE, halves, whole) <= (both - 2 * need)[at]
    return out


def ranked(later: np.ndarray, earlier: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in order of (later, earlier): which have their rank in low .. high - 1, and whether more follow."""
    begin = np.searchsorted(later, later)
    rank = np.arange(len(later)) - begin
    total = np.searchsorted(later, later, side="right") - begin
    chosen = (rank >= low) & (rank < high)
    return chosen, total > high


def candidates(low: int, high: int | None, marks=None) -> Callable[[Batches], Batches]:
    """Of each posting's earlier candidates under its word those of rank low .. high - 1; loads come by shard.

    Without ``high`` all of them, between the earliest postings of equal sets; ``more`` then says that the row
    is a member of a large group and the first line of that group.

    ``marks`` are broadcast bitmaps of the keys that loads were cut down to and of the lines that ask; all
    without them. A bit that is set by chance gives candidates that are verified like others.
    """

    def of_groups(p: dict[str, np.ndarray]) -> Batches:
        order = np.argsort(p["key"], kind="stable")
        key = p["key"][order]
        twin = key[1:] == key[:-1]
        live = np.zeros(len(key), bool)
        live[1:] |= twin
        live[:-1] |= twin
        order = order[live]
        if not len(order):
            return
        order = order[np.lexsort((p["line"][order], p["doc_id"][order], p["key"][order]))]
        for name in list(p):  # one column at a time
            p[name] = p[name][order]
        begin = np.searchsorted(p["key"], p["key"])
        size = np.searchsorted(p["key"], p["key"], side="right") - begin
        alike = np.lexsort((p["same"], p["parity"], p["key"]))  # stable: equal sets stay in order
        copy = np.zeros(len(alike), bool)  # an equal set stands before it
        copy[alike[1:]] = np.all([p[c][alike[1:]] == p[c][alike[:-1]] for c in ("key", "same", "parity", "n")], axis=0)
        if high is None:
            p = {k: v[~copy] for k, v in p.items()}
            yield from of_all(p)
            return
        asks = p["asks"] & ~copy
        # Few postings of a word: all its pairs of fitting lengths at once. Many: the earliest first, until enough are found.
        pairs = list(of_small(p, np.flatnonzero(size <= SMALL_GROUP), asks))
        if pairs:
            later, earlier = map(np.concatenate, zip(*pairs))
            order = np.lexsort((earlier, later))
            yield from chosen(p, later[order], earlier[order])
        yield from of_large(p, begin, np.flatnonzero((size > SMALL_GROUP) & asks & (np.arange(len(begin)) > begin)))

    def windows(p: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings by key and length, and of each the first one and the number of those before it of a fitting length."""
        by_length = at[np.lexsort((p["n"][at], p["key"][at]))]
        place = (p["key"][by_length].astype(np.int64) << 31) | p["n"][by_length]
        shortest = (p["key"][by_length].astype(np.int64) << 31) | (PERCENT * p["n"][by_length].astype(np.int64) + 99) // 100
        low = np.searchsorted(place, shortest)
        return by_length, low, np.arange(len(by_length)) - low

    def of_small(p: dict[str, np.ndarray], at: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fitting pairs (later, earlier) of the given postings, some at a time."""
        by_length, low, count = windows(p, at)
        done, start = np.r_[0, np.cumsum(count)], 0
        while start < len(by_length):
            stop = max(start + 1, int(np.searchsorted(done, done[start] + PAIRS, side="right")) - 1)
            x = by_length[np.repeat(np.arange(start, stop), count[start:stop])]
            y = by_length[ranges(low[start:stop], count[start:stop])]
            later, earlier = np.maximum(x, y), np.minimum(x, y)
            open_ = asks[later]
            later, earlier = later[open_], earlier[open_]
            fit = fitting(p, later, earlier)
            yield later[fit], earlier[fit]
            start = stop

    def of_all(p: dict[str, np.ndarray]) -> Batches:
        """All fitting pairs, keys of few pairs together; postings come in order of their keys."""
        if not len(p["key"]):
            return
        first = np.flatnonzero(np.r_[True, p["key"][1:] != p["key"][:-1]])
        bounds = np.r_[first, len(p["key"])]
        done, start = np.r_[0, np.cumsum(np.add.reduceat(windows(p, np.arange(len(p["key"])))[2], first))], 0
        while start < len(first):
            stop = max(start + 1, int(np.searchsorted(done, done[start] + PAIRS, side="right")) - 1)
            found = few(p, np.arange(bounds[start], bounds[stop]))
            if found is not None:
                yield from sent(p, *found, np.zeros(len(found[0]), bool))
            else:
                for k in range(start, stop):
                    at = np.arange(bounds[k], bounds[k + 1])
                    found = few(p, at) if stop > start + 1 else None
                    yield from of_dense(p, at) if found is None else sent(p, *found, np.zeros(len(found[0]), bool))
            start = stop

    def few(p: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The fitting pairs, unless there are more than DENSE for each posting."""
        pairs, held = [], 0
        for pair in of_small(p, at, p["asks"]):
            pairs.append(pair)
            held += len(pair[0])
            if held > DENSE * len(at):
                return None
        later, earlier = map(np.concatenate, zip(*pairs))
        return later, earlier

    def of_dense(p: dict[str, np.ndarray], at: np.ndarray) -> Batches:
        """Postings of one key: large groups as members, other pairs as such."""
        group, left = np.full(len(p["key"]), -1), at
        while len(left):
            fit = fitting(p, left, np.full(len(left), left[0]))
            fit[0] = True
            if fit.sum() > 2 * DENSE:
                group[left[fit]] = left[0]
            left = left[~fit]
        members = at[group[at] >= 0]
        yield from sent(p, members, group[members], np.ones(len(members), bool))
        for later, earlier in of_small(p, at, p["asks"]):
            apart = (group[later] < 0) | (group[later] != group[earlier])
            yield from sent(p, later[apart], earlier[apart], np.zeros(int(apart.sum()), bool))

    def of_large(p: dict[str, np.ndarray], begin: np.ndarray, asks: np.ndarray) -> Batches:
        laters, earliers, held = [], [], 0
        for x in asks:
            found, count = [], 0
            for start in range(begin[x], x, SMALL_GROUP):
                y = np.arange(start, min(start + SMALL_GROUP, x))
                found.append(y[fitting(p, np.full(len(y), x), y)])
                count += len(found[-1])
                if count > high:
                    break
            y = np.concatenate(found)[: high + 1]
            laters.append(np.full(len(y), x))
            earliers.append(y)
            held += len(y)
            if held > PAIRS:
                yield from chosen(p, np.concatenate(laters), np.concatenate(earliers))
                laters, earliers, held = [], [], 0
        if held:
            yield from chosen(p, np.concatenate(laters), np.concatenate(earliers))

    def chosen(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> Batches:
        keep, more = ranked(x, y, low, high)
        yield from sent(p, x[keep], y[keep], more[keep])

    def sent(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, more: np.ndarray) -> Batches:
        if len(x):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["doc_id"][x]), pa.array(p["line"][x]), pa.array(p["doc_id"][y]), pa.array(p["line"][y]), pa.array(more)],
                ["doc_id", "line", "to_doc", "to_line", "more"],
            )

    def opened(load: bytes) -> dict[str, np.ndarray]:
        p = unpacked(load)
        p["asks"] = np.ones(len(p["key"]), bool)
        if marks is not None:
            p["asks"] = is_marked(marks.value[1], slot(p["doc_id"], p["line"]))
        return p

    def joined(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """The postings of all loads, column by column; leaves the list empty, so that they are held once."""
        out = {c: np.concatenate([h.pop(c) for h in held]) for c in list(held[0])}
        held.clear()
        return out

    def run(batches: Batches) -> Batches:
        held: list[dict[str, np.ndarray]] = []
        shard = None
        for batch in batches:
            for number, load in zip(batch.column("shard").to_pylist(), batch.column("load")):
                if number != shard and held:
                    yield from of_groups(joined(held))
                shard = number
                held.append(opened(load.as_py()))
        if held:
            yield from of_groups(joined(held))

    return run


def slot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Place of a line in the bitmap."""
    return (mix(mix(doc.astype(np.int64).view(U64)) + line.astype(np.int64).view(U64)) >> U64(64 - MAP_BITS)).astype(np.int64)


def bitmap(lines: DataFrame) -> np.ndarray:
    """A bitmap of 2**MAP_BITS bits with the places of the lines ``(doc_id, line)``."""

    def mark(batches: Batches) -> Batches:
        for batch in batches:
            at = np.unique(slot(batch.column("doc_id").to_numpy(), batch.column("line").to_numpy()))
            words, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first) if len(at) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(words), signed(bits)], ["word", "bits"])

    marked = lines.mapInArrow(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    found = marked.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(U64)


def is_marked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1


def sets_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(doc_id, line, words)`` with the word hashes, in order, of the given lines and by chance of others."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(lines))

    def run(batches: Batches) -> Batches:
        marks = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text"))
                starts, ends, owner = texts.lines
                number = np.arange(len(starts)) - np.searchsorted(owner, owner)
                at = slot(part.column("doc_id").to_numpy()[owner], number)
                wanted = is_marked(marks, at)
                if not wanted.any():
                    continue
                chosen = np.flatnonzero(wanted)
                size = ends[chosen] - starts[chosen]
                line, words, _ = line_sets(Texts(texts.data[ranges(starts[chosen], size)], np.r_[0, np.cumsum(size)], lower=True))
                bounds = np.searchsorted(line, np.arange(len(chosen) + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner[chosen])), pa.array(number[chosen].astype(np.int32)), binary_ranges(short(words), WIDTH * bounds)],
                    ["doc_id", "line", "words"],
                )

    return docs.mapInArrow(run, "doc_id bigint, line int, words binary")


def short(words: np.ndarray) -> np.ndarray:
    """The upper WIDTH bytes of each hash; the order of the hashes stays."""
    return np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).ravel()


def long(held: bytes | pa.Buffer) -> np.ndarray:
    out = np.zeros((len(memoryview(held)) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(held, np.uint8).reshape(-1, WIDTH)
    return out.view(">u8").ravel().astype(U64)


LINKED = "doc_id bigint, line int, n_links bigint, to_doc bigint, to_line int"


def within(root: int, own: np.ndarray, inner: bool, roots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile of the group ``root`` that no lesser group has; lines have their block (``own``) and groups."""
    x, y = np.triu_indices(len(own), 1)
    open_ = np.full(len(x), True) if inner else own[x] != own[y]
    held = np.concatenate(roots)
    holder = np.repeat(np.arange(len(own)), [len(r) for r in roots])
    for other in np.unique(held[held < root]):
        has = np.zeros(len(own), bool)
        has[holder[held == other]] = True
        open_ &= ~(has[x] & has[y])
    return x[open_], y[open_]


def tile_runs(batches: Batches) -> Batches:
    """The tiles in runs of about ``RUN_SETS`` sets; a larger tile is a run of its own."""
    for batch in batches:
        ends = np.cumsum(batch.column("sets").value_lengths().to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + RUN_SETS
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def verify(batches: Batches) -> Batches:
    """How many sets of its tile match a line's (``n_links``), and the earliest of those before it.

    The pairs of some tiles are compared together, those of a group tile by tile.
    """
    for batch in tile_runs(batches):
        sets, pairs = (batch.column(c).flatten() for c in ("sets", "pairs"))
        sizes = [batch.column(c).value_lengths().to_numpy() for c in ("sets", "pairs")]
        tile, pair_tile = (np.repeat(np.arange(batch.num_rows), size) for size in sizes)
        doc, line = sets.field("doc_id").to_numpy(), sets.field("line").to_numpy()
        order = np.lexsort((line, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = sets.field("words")
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        held = long(words.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))) >> U64(64 - 8 * WIDTH)
        first, size = (bounds[:-1] - bounds[0]) // WIDTH, np.diff(bounds) // WIDTH
        roots = sets.field("roots")
        n_roots = roots.value_lengths().fill_null(0).to_numpy()
        all_roots = roots.flatten().to_numpy()
        root_at = np.r_[0, np.cumsum(n_roots)].astype(np.int64)

        def place(d: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
            return mix(mix(mix(d.view(U64)) + k.astype(U64)) + at.astype(U64))

        def of_pairs() -> tuple[np.ndarray, np.ndarray]:
            """Positions of the sets of the pairs that no group has."""
            home = place(doc, line, tile)
            by_home = np.argsort(home)
            sides = []
            for d, k in (("doc_id", "line"), ("to_doc", "to_line")):
                asked = place(pairs.field(d).to_numpy(), pairs.field(k).to_numpy(), pair_tile)
                at = by_home[np.minimum(np.searchsorted(home[by_home], asked), len(by_home) - 1)]
                sides.append(np.where(home[at] == asked, at, -1))
            known = (sides[0] >= 0) & (sides[1] >= 0)
            x, y = (side[known] for side in sides)
            if len(all_roots):
                group = np.sort(mix(mix(np.repeat(np.arange(len(tile)), n_roots).astype(U64)) + all_roots.view(U64)))
                asked = mix(np.repeat(mix(y.astype(U64)), n_roots[x]) + all_roots[ranges(root_at[x], n_roots[x])].view(U64))
                has = group[np.minimum(np.searchsorted(group, asked), len(group) - 1)] == asked
                apart = np.bincount(np.repeat(np.arange(len(x)), n_roots[x]), has, len(x)) == 0
                x, y = x[apart], y[apart]
            return x, y

        def of_groups() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            own, inner = (sets.field(c).to_numpy(zero_copy_only=False) for c in ("own", "inner"))
            ends = np.r_[0, np.cumsum(sizes[0])]
            for k in np.flatnonzero(batch.column("root").is_valid().to_numpy(zero_copy_only=False)):
                a, b = ends[k], ends[k + 1]
                x, y = within(batch.column("root")[int(k)].as_py(), own[a:b], bool(inner[a]), [all_roots[root_at[i] : root_at[i + 1]] for i in range(a, b)])
                x, y = x + a, y + a
                after = rank[x] > rank[y]
                yield np.where(after, x, y), np.where(after, y, x)

        n, least = np.zeros(len(order), np.int64), np.full(len(order), len(order))
        for later, earlier in [*([of_pairs()] if len(pairs) else []), *of_groups()]:
            done, start = np.r_[0, np.cumsum(size[later] + size[earlier])], 0
            while start < len(later):
                stop = max(start + 1, int(np.searchsorted(done, done[start] + COMPARED, side="right")) - 1)
                x, y = later[start:stop], earlier[start:stop]
                both = np.concatenate([np.repeat(np.arange(len(x)), size[s]).astype(U64) << U64(8 * WIDTH) | held[ranges(first[s], size[s])] for s in (x, y)])
                both.sort()
                twice = both[1:][both[1:] == both[:-1]] >> U64(8 * WIDTH)
                common = np.bincount(twice.astype(np.int64), minlength=len(x))
                match = 100 * common >= PERCENT * (size[x] + size[y] - common)
                x, y = x[match], y[match]
                n += np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
                np.minimum.at(least, x, rank[y])
                start = stop
        at = np.flatnonzero(n)
        to = pa.array(order[np.minimum(least[at], len(order) - 1)], mask=least[at] == len(order))
        columns = [pa.array(doc[at]), pa.array(line[at]), pa.array(n[at]), pa.array(doc).take(to), pa.array(line).take(to)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINKED.split(", ")])


def verified(docs: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``(doc_id, line, n_links, to_doc, to_line)``: how many lines match a line, and the earliest of those before it.

    Compared are the ``pairs`` (doc_id, line, to_doc, to_line), the later one first, and all pairs of the groups
    whose ``members`` (doc_id, line) have the same (to_doc, to_line). Lines without a match have no row.
    """
    names = ["doc_id", "line", "to_doc", "to_line"]
    tops = pairs.groupBy("doc_id", "line").agg(F.min(F.struct("to_doc", "to_line")).alias("top"), F.count(F.lit(1)).alias("n"))
    sizes = tops.groupBy("top").agg(F.ceil(F.sqrt(F.sum("n") / TILE_PAIRS)).alias("parts"))
    tops = tops.join(sizes, "top").select("doc_id", "line", "top", "parts")
    split = [F.pmod(F.xxhash64(*side), F.col("parts")) for side in (names[:2], names[2:])]
    # Tiles that share a hash are one tile.
    dealt = stored(pairs.join(tops, names[:2]).select(F.xxhash64("top", *split).alias("tile"), *names), "tiles")
    sides = F.inline(F.array(F.struct("doc_id", "line"), F.struct(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line"))))
    wanted = dealt.select("tile", sides).distinct()
    if members is None:
        wanted = wanted.selectExpr("*", "CAST(NULL AS bigint) root", "CAST(NULL AS bigint) own", "CAST(NULL AS boolean) inner", "CAST(NULL AS array<bigint>) roots")
    else:
        members = members.select("doc_id", "line", F.xxhash64("to_doc", "to_line").alias("root"))
        blocks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        block = F.pmod(F.xxhash64("doc_id", "line"), F.col("parts"))
        grouped = members.join(blocks, "root").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tile = F.xxhash64(F.lit("group"), "root", F.least("own", "other"), F.greatest("own", "other"))
        grouped = grouped.select(tile.alias("tile"), "doc_id", "line", "root", "own", (F.col("own") == F.col("other")).alias("inner"))
        roots = members.groupBy("doc_id", "line").agg(F.collect_set("root").alias("roots"))
        wanted = wanted.unionByName(grouped, allowMissingColumns=True).join(roots, ["doc_id", "line"], "left")
    wanted = stored(wanted, "wanted")
    sent = sets_of(docs, wanted.select("doc_id", "line")).join(wanted, ["doc_id", "line"])
    sent = sent.select("tile", "root", F.struct("doc_id", "line", "words", "roots", "own", "inner").alias("set"))
    both = sent.unionByName(dealt.select("tile", F.struct(*names).alias("pair")), allowMissingColumns=True)
    tiles = both.groupBy("tile", "root").agg(F.collect_set("set").alias("sets"), F.collect_list("pair").alias("pairs"))
    found = tiles.select("root", "sets", "pairs").mapInArrow(verify, LINKED)
    least = F.min(F.when(F.col("to_doc").isNotNull(), F.struct("to_doc", "to_line"))).alias("to")
    return found.groupBy("doc_id", "line").agg(F.sum("n_links").alias("n_links"), least).select("doc_id", "line", "n_links", "to.*")


def near_loads(loads: DataFrame, marks) -> DataFrame:
    """The loads with the postings of marked keys only."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            kept = []
            for load in batch.column("load"):
                p = unpacked(load.as_py())
                near = is_marked(marks.value[0], slot(p["key"], np.zeros(len(p["key"]), np.int64)))
                kept.append(load_of({c: v[near] for c, v in p.items()}) if near.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(kept, pa.binary())], ["shard", "load"])

    return loads.mapInArrow(run, "shard int, load binary").where("load IS NOT NULL")


def keys_of(lines: DataFrame, loads: DataFrame) -> DataFrame:
    """The keys of the given lines, as rows for a bitmap."""
    marks = lines.sparkSession.sparkContext.broadcast(bitmap(lines))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for load in batch.column("load"):
                p = unpacked(load.as_py())
                key = np.unique(p["key"][is_marked(marks.value, slot(p["doc_id"], p["line"]))]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int32))], ["doc_id", "line"])

    return loads.mapInArrow(run, "doc_id bigint, line int")


def links(docs: DataFrame, loads: DataFrame) -> DataFrame:
    """``(doc_id, line, n_links, to_doc, to_line)``: representatives that match others, see ``verified``."""
    near = loads.repartition("shard").sortWithinPartitions("shard").mapInArrow(candidates(0, None), CANDIDATES)
    found = stored(near.distinct(), "candidates")
    pairs, members = (found.where(c).drop("more") for c in ("NOT more", "more"))
    return stored(verified(docs, pairs, members), "links")


def matches(docs: DataFrame, loads: DataFrame) -> DataFrame:
    """``(doc_id, line, to_doc, to_line)``: lines that match an earlier one of another set, and one that they match."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "doc_id bigint, line int, to_doc bigint, to_line int")
    names = ["doc_id", "line", "to_doc", "to_line"]
    marks, low, high = None, 0, 1
    while True:
        open_loads = loads if marks is None else near_loads(loads, marks)
        near = open_loads.repartition("shard").sortWithinPartitions("shard").mapInArrow(candidates(low, high, marks), CANDIDATES)
        pairs = stored(near.groupBy(*names).agg(F.max("more").alias("more")), "candidates")
        checked = stored(verified(docs, pairs.drop("more")).where("to_doc IS NOT NULL").drop("n_links"), "matches")
        found = found.unionByName(checked)
        asks = pairs.where("more").select("doc_id", "line").distinct().join(checked, ["doc_id", "line"], "left_anti")
        asks = stored(asks, "open")
        if asks.isEmpty():
            return found
        low, high = high, 64 * high
        # Later rounds look at the words of the lines that are still open.
        marks = spark.sparkContext.broadcast((bitmap(keys_of(asks, loads)), bitmap(asks)))


def judged_lines(docs: DataFrame, min_tokens: int = 1, *, id_col: str = "doc_id", text_col: str = "text", all_links: bool = False) -> DataFrame:
    """``(doc_id, line, n_tokens, removed, to_doc, to_line)`` for every line with ``min_tokens`` distinct words.

    Lines are numbered from 0. ``to_doc`` and ``to_line`` name an earlier line that a removed one matches.
    Null and empty texts and blank lines have no row. Rows with a null id take no part. Rows that repeat an
    id with the same text count once; ids are expected not to stand for different texts (their lines are
    then compared as if they were lines of one document). Other columns are ignored.

    With ``all_links`` every pair is looked for, and each line also has its class, named by the earliest line of
    the same set (``class_doc``, ``class_line``), and ``n_links``: how many other classes match it.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    counts = word_counts(docs)
    # A shard of postings is held by one task: it stands for 2**23 words of text at most.
    shards = max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counts.sum(dtype=np.int64) >> 23))
    made = stored(docs.mapInArrow(line_rows(counts, min_tokens, shards), LINES), "lines")
    rows, loads = made.where("shard IS NULL"), made.where("shard IS NOT NULL").select("shard", "load")
    sets = ["d1", "d2", "n"]
    place = F.struct("doc_id", "line")
    classes = rows.groupBy(*sets).agg(F.min(place).alias("keep"))
    if all_links:
        later = links(docs, loads)
        extra = [F.col("keep.doc_id").alias("class_doc"), F.col("keep.line").alias("class_line"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")]
    else:
        later, extra = matches(docs, loads), []
    classes = classes.join(later.withColumn("keep", place).drop("doc_id", "line"), "keep", "left")
    all_rows = rows.select("doc_id", "line", *sets).join(classes, sets)
    copy = F.struct("doc_id", "line") != F.col("keep")
    return all_rows.select(
        "doc_id",
        "line",
        F.col("n").alias("n_tokens"),
        (copy | F.col("to_doc").isNotNull()).alias("removed"),
        F.when(copy, F.col("keep.doc_id")).otherwise(F.col("to_doc")).alias("to_doc"),
        F.when(copy, F.col("keep.line")).otherwise(F.col("to_line")).alias("to_line"),
        *extra,
    )


def removed_lines(judged: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` per document with a line: the numbers of the removed lines."""
    out = F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line"))))
    by_doc = judged.groupBy("doc_id").agg(F.count_distinct("line").alias("n_lines"), out.alias("removed"))
    return by_doc.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame, min_tokens: int = 5) -> DataFrame:
    """``docs``, all columns, without the removed lines; a document that loses all its words goes.

    Short lines, of fewer than ``min_tokens`` distinct words, stay. Null and blank texts and rows with a null
    id stay as they are.
    """
    found = removed_lines(judged_lines(docs, min_tokens)).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("removed").alias("__removed"))
    schema = docs.schema
    joined = docs.join(found, docs["doc_id"] == found["__id"], "left").select(*[docs[c] for c in docs.columns], "__removed")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text"))
                starts, ends, owner = texts.lines
                lists = part.column("__removed")
                doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                at = np.searchsorted(owner, doc) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                change = np.zeros(len(texts.data) + 1, np.int64)
                # With its line break, as far as there is one after it.
                np.add.at(change, starts[at], 1)
                np.add.at(change, np.minimum(ends[at] + 1, texts.offsets[owner[at] + 1]), -1)
                keep = np.cumsum(change[:-1]) == 0
                offsets = np.r_[0, np.cumsum(keep)][texts.offsets]
                left = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(texts.data[keep].tobytes()))
                text = pc.if_else(pc.is_valid(part.column("text")), left.cast(pa.string()), pa.scalar(None, pa.string()))
                words = np.bincount(texts.owner[keep[texts.starts]], minlength=len(texts))
                stays = (words > 0) | (np.diff(texts.bounds) == 0)
                columns = [text if n == "text" else part.column(n) for n in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(stays))

    return joined.mapInArrow(run, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, every line with a word: ``(doc_id, n_lines, n_removed, removed, lines)`` per id.

    ``lines`` has the class and the number of links of every line with a word, as (line, n_tokens, class_doc,
    class_line, n_links) in order. A document without such lines has empty arrays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = stored(judged_lines(docs, all_links=True), "judged")
    about = F.array_sort(F.collect_set(F.struct("line", "n_tokens", "class_doc", "class_line", "n_links"))).alias("lines")
    found = removed_lines(judged).join(judged.groupBy("doc_id").agg(about), "doc_id")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_removed")]
    none = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("removed", "lines")]
    return ids.join(found, "doc_id", "left").select("doc_id", *counts, *none)
