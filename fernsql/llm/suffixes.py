"""Exact repeated-substring removal by a distributed difference-cover suffix sort.

Texts are UTF-8 bytes. A window is a string of ``length`` bytes; a byte goes if a window that covers it also starts
earlier: in a document before, or in the same one. All windows are judged on the input.

Suffix sorting is dealt out by content. A window's key is the least hash among its 16-byte substrings, so equal windows
have equal keys wherever they stand. A run is a stretch of at most RUN_WINDOWS windows of one key. Hashes only say
which runs meet: a run whose key no other run has can't repeat. The others are joined to texts, a task for a range of
keys, and their suffixes sorted by the difference-cover method (``suffix_order``): triples at two of three places
sorted and named, recursion on the names, the remaining suffixes sorted by one symbol and a name, and both merged. Neighbours
in that order whose first ``length`` bytes agree are one window's places; the first place stays.

Skew: of runs of one batch of a task whose bytes are equal, the first BATCH_COPIES go on. Runs of one key that together
exceed GROUP_BYTES are sorted in groups: one has the first of each different string, the others some copies each with the
first of theirs, against which the sort holds them. Keys that many runs have are found first, by counts that grow with
the number of tasks; windows of such a key are dealt out singly, by a hash of all their bytes.

Null texts are empty. Rows of equal doc_id stay separate documents, in the order of a hash of the text; null ids come
first. Texts shorter than a window are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, batches, fresh, keyed, rows_of, with_uid

GRAM = 16
#: Text bytes to a range of keys, and suffixes to a sort, about.
PART_BYTES, SORT_BYTES = 12 << 20, 3 << 19
#: Suffixes that are sorted at once, about: whole keys, so few that the sort stays in the cache.
BATCH_BYTES = 100_000
#: Runs with equal bytes that a batch of a task sends on; of more only so many go through the sort.
BATCH_COPIES = 16
#: Windows of a run, and bytes of a key that are sorted in one group, at most.
RUN_WINDOWS, GROUP_BYTES = 512, 64 << 10
#: Runs that a task holds before it sends them on.
FLUSH_RUNS = 150_000
MULTIPLIER = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# Keys and runs ------------------------------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(b: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every substring of the length, modulo 2^64."""
    out, done = None, 0
    h, n, p = BYTE_CODES[b], 1, MULTIPLIER
    while n <= length:
        if length & n:
            # p is the multiplier to the power n, so the longer part moves up by n places
            out = h if out is None else out[: len(out) - n] * np.uint64(p) + h[done : done + len(out) - n] if len(out) > n else out[:0]
            done += n
        if n * 2 <= length:
            h = h[:-n] * np.uint64(p) + h[n:]
        p = p * p % (1 << 64)
        n *= 2
    return out


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        a = best(a[:-n], a[n:])
        n *= 2
    return best(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def runs_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: first window, window after the last, key, and whether the least substring stands in it twice."""
    b = np.frombuffer(data, np.uint8)
    width = length - GRAM + 1
    h = _mix(rolling(b, GRAM))
    m = _sliding(h, width, np.minimum)
    start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    end = np.concatenate([start[1:], [len(m)]])
    pieces = -(-(end - start) // RUN_WINDOWS)
    if len(pieces) < pieces.sum():  # periodic texts have long runs
        first = np.repeat(start, pieces)
        start = first + RUN_WINDOWS * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(start + RUN_WINDOWS, np.repeat(end, pieces))
    key = m[start]
    # A place is the least of some window if it equals the greatest of the minima of the windows over it.
    edge = np.zeros(width - 1, np.uint64)
    over = _sliding(np.concatenate([edge, m, edge]), width, np.maximum)
    at = np.flatnonzero(over == h)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end + width - 1)
    count = hi - lo
    of = np.repeat(np.arange(len(start)), count)
    idx = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[of]
    twice = np.bincount(of[h[at[idx]] == key[of]], minlength=len(start)) > 1
    # Minima crowd at the low end; mixed again they are even, so that ranges of keys are alike.
    return start, end, _mix(key ^ np.uint64(MULTIPLIER)), twice


def units(data: bytes, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, key, twice: runs, but the windows of hot keys singly."""
    start, end, key, twice = runs_of(data, length)
    if len(hot):
        k = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[k] == key
        if is_hot.any():
            n = (end - start)[is_hot]
            single = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[is_hot], n)
            whole = _mix(rolling(np.frombuffer(data, np.uint8), length)[single] ^ np.uint64(MULTIPLIER))
            keep = ~is_hot
            return (
                np.concatenate([start[keep], single]), np.concatenate([(end - start)[keep], np.ones(len(single), np.int64)]),
                np.concatenate([key[keep], whole]), np.concatenate([twice[keep], np.zeros(len(single), bool)]),
            )
    return start, end - start, key, twice


# Packing ------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray, body: bytes = b"") -> bytes:
    """Arrays of 8-byte numbers by byte planes, compressed; body after them."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(n.to_bytes(8, "little") + planes + body)


def unpack(blob: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    out = []
    for i, kind in enumerate(kinds):
        planes = np.frombuffer(data, np.uint8, 8 * n, 8 + 8 * n * i).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
    return out, data[8 + 8 * n * len(kinds) :]


# The suffix sort ----------------------------------------------------------------------------------------------


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the keys, their ranks from 1 (equal for equal ones), and the number of different ones."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), np.int32)
    np.not_equal(k[1:], k[:-1], out=new[1:], casting="unsafe")
    np.cumsum(new, out=new)
    name = np.empty(len(k), np.int32)
    name[order] = new
    return order, name, int(new[-1])


def suffix_order(s: np.ndarray, top: int | None = None) -> np.ndarray:
    """The suffix array of s (numbers from 1 to top), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    bits = int(top or s.max()).bit_length()
    t = np.zeros(n + 5, np.int64)
    t[:n] = s
    # Thirds of the places; where n is 1 modulo 3 a last, empty suffix keeps the two sampled thirds apart.
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3 + (n % 3 == 1), n // 3
    at = lambda first, count: t[first : first + 3 * count : 3]
    two = np.concatenate([(at(1, n1) << bits) | at(2, n1), (at(2, n2) << bits) | at(3, n2)])
    third = np.concatenate([at(3, n1), at(4, n2)])
    if 3 * bits > 62:
        two = _named(two)[1].astype(np.int64)
    order, name, names = _named((two << bits) | third)
    del two, third
    if names < len(name):
        order = suffix_order(name, names)
    rank = np.empty(n1 + n2, np.int64)
    rank[order] = np.arange(1, len(rank) + 1)
    one, other = np.zeros(n1 + 2, np.int64), np.zeros(n1 + 2, np.int64)
    one[:n1], other[:n2] = rank[:n1], rank[n1:]
    low = len(rank).bit_length()
    zero = (at(0, n0) << low) | one[:n0]
    zeros = np.argsort(zero)
    is_one = order < n1
    ones, others = order[is_one], order[~is_one] - n1
    # Of each suffix at a multiple of 3, how many sampled ones come before it.
    before = np.searchsorted(((at(1, n1) << low) | other[:n1])[ones], zero[zeros]) - (n % 3 == 1)
    pair, pair2 = (at(0, n0) << bits) | at(1, n0), (at(2, n2) << bits) | at(3, n2)
    if 2 * bits + low > 62:
        both = _named(np.concatenate([pair, pair2]))[1].astype(np.int64)
        pair, pair2 = both[:n0], both[n0:]
    before += np.searchsorted(((pair2 << low) | one[1 : 1 + n2])[others], ((pair << low) | other[:n0])[zeros])
    out = np.empty(n, np.int32)
    places = before + np.arange(n0)
    rest = np.ones(n, bool)
    rest[places] = False
    out[places] = 3 * zeros
    sampled = np.where(is_one, 3 * order + 1, 3 * (order - n1) + 2)
    out[rest] = sampled[sampled < n]
    return out


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch of n, one after another."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def repeats(begin: np.ndarray, n: np.ndarray, text: bytes, length: int) -> np.ndarray:
    """Of the windows of strings (begin in text, n windows), laid one after another: whether each stands earlier too.

    Strings lie in the order of their places, so of equal windows the least begin is the first place.
    """
    s = np.frombuffer(text, np.uint8)
    begins = _places(begin, n)
    window = np.zeros(len(s) + 1, bool)
    window[begins] = True
    order = suffix_order(s.astype(np.int32) + 1, 256)
    order = order[window[order]]
    words = np.ndarray((len(s) - 7,), "<u8", text, strides=(1,))
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for o in [*range(0, length - 8, 8), length - 8]:
        live = live[words[order[live] + o] == words[order[live - 1] + o]]
    same[live] = True
    heads = np.flatnonzero(~same)
    first = np.minimum.reduceat(order, heads) if len(heads) else order
    again = np.zeros(len(s) + 1, bool)
    again[order] = order != np.repeat(first, np.diff(np.concatenate([heads, [len(order)]])))
    return again[begins]


# The distributed steps ----------------------------------------------------------------------------------------


def _hot_keys(docs: DataFrame, length: int, parts: int, least: int) -> np.ndarray:
    """Sorted keys of so many runs that they would fill a quarter of a range of keys; at most 4 x parts.

    A task reports the keys that are frequent among its own runs: a key with that share of all has it in some task.
    """
    share = 1 / (8 * parts)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("all", pa.int64())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(1, share * size)
            keys, n = keys[some], n[some]
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(n), np.int64), size))], schema=schema)

        for (text,) in rows_of(part, "text"):
            data = (text or "").encode()
            if len(data) >= length:
                held.append(runs_of(data, length)[2])
                size += len(held[-1])
                if size >= FLUSH_RUNS:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    found = docs.select("text").mapInArrow(run, "key long, n long, all long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    # One pass: the total is in the row of key 0, to which every report adds.
    rows = found.filter((F.col("n") >= least) | (F.col("key") == 0)).collect()
    total = next((r["all"] for r in rows if r["key"] == 0), 0)
    keys = [r["key"] for r in rows if r["n"] >= max(least, 2 * share * total)]
    return np.sort(np.array(keys, np.int64).view(np.uint64))


def _table(schema: pa.Schema, *arrays) -> pa.Table:
    return pa.Table.from_arrays([pa.array(a, type=f.type) for a, f in zip(arrays, schema)], schema=schema)


def _gather(docs: DataFrame, length: int, parts: int, hot: np.ndarray) -> DataFrame:
    """(part, kind, blob): runs for their key's part; of those of one batch with equal bytes the first few, the rest as repeats."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: dict[int, bytes] = {}
        size = sent = 0

        def flush() -> Iterator[tuple]:
            nonlocal sent
            uid, start, n, key, fp, twice = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((start, uid, fp, key))
            uid, start, n, key, fp, twice = (x[order] for x in (uid, start, n, key, fp, twice))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
            heads = np.flatnonzero(new)
            later = np.flatnonzero(~new)
            of = heads[np.searchsorted(heads, later, "right") - 1]
            few = (later - of < BATCH_COPIES) & (n[later] > 1)  # hot keys' single windows go once
            new[later[few]] = True
            later, of = later[~few], of[~few]
            for k, a, i, b, j, size_ in zip(later.tolist(), uid[of].tolist(), start[of].tolist(), uid[later].tolist(), start[later].tolist(), (n[later] + length - 1).tolist()):
                new[k] = texts[a][i : i + size_] != texts[b][j : j + size_]
            if not new.all():
                sent += 1
                yield (int(key[0] % np.uint64(parts)) + sent) % parts, 1, pack(uid[~new], start[~new], n[~new])
            info = n[new] * 2 + twice[new]
            uid, start, key, fp = uid[new], start[new], key[new], fp[new]
            to = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            for p, a, b in zip(to[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
                yield p, 0, pack(uid[a:b], start[a:b], info[a:b], key[a:b], fp[a:b])

        for uid, text in rows_of(part, "uid", "text"):
            data = (text or "").encode()
            if len(data) < length:
                continue
            start, n, key, twice = units(data, length, hot)
            digest = xxhash.xxh64_intdigest
            fp = np.fromiter((digest(data[a : a + k + length - 1]) for a, k in zip(start.tolist(), n.tolist())), np.uint64, len(start))
            held.append((np.full(len(start), uid, np.int64), start, n, key, fp, twice))
            texts[uid] = data
            size += len(start)
            if size >= FLUSH_RUNS:
                yield from batches(flush(), schema, 16)
                held, size = [], 0
                texts.clear()
        if held:
            yield from batches(flush(), schema, 16)

    return docs.select("uid", "text").mapInArrow(run, "part int, kind int, blob binary")


PLAN = "uid long, start int, n int, key long, kind int"


def _grouped(uid: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, fp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs are sorted, and in which group; a run may be in several. Runs lie in the order of key, hash and place."""
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    of = np.cumsum(new_key) - 1
    size = np.bincount(of, n + length - 1)
    small = size[of] <= GROUP_BYTES
    rows = np.flatnonzero(small)
    first = new_key | np.concatenate([[True], fp[1:] != fp[:-1]])
    heads = np.flatnonzero(first & ~small)
    # The first of each string of a large key in the key's own group; copies by so many, each time with the first.
    copies = np.flatnonzero(~first & ~small)
    head = np.flatnonzero(first)
    mine = head[np.searchsorted(head, copies, "right") - 1]
    each = np.maximum(1, GROUP_BYTES // (n[copies] + length - 1))
    turn = (copies - mine - 1) // each
    group = _mix(fp[copies] + turn.astype(np.uint64) * np.uint64(MULTIPLIER) + np.uint64(1))
    begins = np.flatnonzero((copies - mine - 1) % each == 0)
    return np.concatenate([rows, heads, copies, mine[begins]]), np.concatenate([key[rows], key[heads], group, group[begins]])


def _plan(gathered: DataFrame, length: int) -> DataFrame:
    """Rows of kind 1: windows that repeat. Of kind 0: runs whose key others have too, to be sorted in the group ``key``."""
    schema = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("kind", pa.int32())])

    def run(key, table):
        parts, out = [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob")):
            if kind:
                (uid, start, n), _ = unpack(blob.as_py(), [np.int64] * 3)
                out.append((uid, start, n, np.zeros(len(uid), np.int64), np.ones(len(uid), np.int32)))
            else:
                parts.append(unpack(blob.as_py(), [np.int64] * 3 + [np.uint64] * 2)[0])
        if parts:
            uid, start, info, k, fp = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(k, kind="stable")
            k = k[order]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            # Only runs that share their key, or may hold a window twice.
            some = ~(new & np.concatenate([new[1:], [True]])) | (info[order] % 2 == 1)
            order = order[some]
            order = order[np.lexsort((start[order], uid[order], fp[order], k[some]))]
            uid, start, n, fp = uid[order], start[order], info[order] // 2, fp[order]
            k = np.sort(k[some])
            if len(order):
                which, group = _grouped(uid, start, n, k, fp, length)
                out.append((uid[which], start[which], n[which], group.view(np.int64), np.zeros(len(which), np.int32)))
        return _table(schema, *(np.concatenate(x) for x in zip(*out))) if out else _table(schema, *([] for _ in schema))

    return gathered.groupBy("part").applyInArrow(run, PLAN)


def _sorted_repeats(docs: DataFrame, plan: DataFrame, length: int) -> DataFrame:
    """(uid, start, n): windows of the strings of kind 0 that the suffix sort finds earlier."""
    todo = plan.filter("kind = 0")
    total = todo.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0
    parts = max(1, -(-total // SORT_BYTES))
    mine = todo.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "key")).alias("runs"))
    cut = docs.select("uid", "text").join(mine, "uid")
    packed = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    def extract(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[tuple]:
            uid, start, n, group = (np.concatenate(x) for x in list(zip(*held))[:4])
            bodies = [b for h in held for b in h[4]]
            to = ((_mix(group) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                k = order[a:b]
                yield int(to[k[0]]), pack(uid[k], start[k], n[k], group[k], body=b"".join([bodies[i] for i in k.tolist()]))

        for batch in part:
            for uid, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.encode()
                start, n, group = (x.to_numpy() for x in runs.values.flatten())
                start, n = start.astype(np.int64), n.astype(np.int64)
                held.append((np.full(len(start), uid, np.int64), start, n, group.view(np.uint64), [data[a : a + k] for a, k in zip(start.tolist(), (n + length - 1).tolist())]))
                size += int(n.sum()) + (length - 1) * len(n)
                if size >= 8 << 20:
                    yield from batches(flush(), packed, 16)
                    held, size = [], 0
        if held:
            yield from batches(flush(), packed, 16)

    out = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def sort(key, table):
        cols, bodies = [], []
        for blob in table.column("blob"):
            arrays, body = unpack(blob.as_py(), [np.int64] * 3 + [np.uint64])
            cols.append(arrays)
            bodies.append(body)
        uid, start, n, group = (np.concatenate(x) for x in zip(*cols))
        text = b"".join(bodies)
        size = n + length - 1
        begin = np.cumsum(size) - size
        # Whole groups to a batch, and within it the order of places.
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(size[order])
        new = np.concatenate([[True], np.diff(group[order]) != 0])
        batch = (ends - size[order])[np.flatnonzero(new)] // BATCH_BYTES
        batch = batch[np.cumsum(new) - 1]
        order = order[np.lexsort((start[order], uid[order], batch))]
        batch = np.sort(batch)
        uid, start, n, size, begin = (x[order] for x in (uid, start, n, size, begin))
        again = []
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(batch) != 0]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
            own = b"".join([text[x : x + k] for x, k in zip(begin[a:b].tolist(), size[a:b].tolist())])
            again.append(repeats(np.cumsum(size[a:b]) - size[a:b], n[a:b], own, length))
        k = np.flatnonzero(np.concatenate(again))
        if not len(k):
            return _table(out, [], [], [])
        of = np.repeat(np.arange(len(n)), n)
        place = _places(start, n)
        new = np.concatenate([[True], (of[k[1:]] != of[k[:-1]]) | (k[1:] != k[:-1] + 1)])
        heads = np.flatnonzero(new)
        return _table(out, uid[of[k[heads]]], place[k[heads]], np.diff(np.concatenate([heads, [len(k)]])))

    dealt = cut.mapInArrow(extract, "part int, blob binary")
    return dealt.groupBy("part").applyInArrow(sort, "uid long, start int, n int")


def removed_runs(windows: list[int], length: int) -> list[list[int]]:
    """Runs [begin, end) of bytes from windows packed as start x 2^32 + number."""
    out: list[list[int]] = []
    for x in sorted(windows):
        a, n = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n + length - 1)
        else:
            out.append([a, a + n + length - 1])
    return out


def find_repeats(spark: SparkSession, rows: DataFrame, length: int = 100, hot_runs: int = 20_000) -> DataFrame:
    """(uid, windows): the windows of each text that repeat, packed as start x 2^32 + number. rows: (uid unique, text)."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    scratch = Scratch(spark, "suffixes")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    hot = _hot_keys(rows, length, parts, hot_runs)
    plan = scratch.save(_plan(_gather(rows, length, parts, hot), length), "plan")
    scratch.collect_garbage()
    late = scratch.save(_sorted_repeats(rows, plan, length), "late")
    scratch.collect_garbage()
    every = plan.filter("kind = 1").select("uid", "start", "n").unionAll(late)
    return every.groupBy("uid").agg(F.collect_list(F.col("start").cast("long") * (1 << 32) + F.col("n")).alias("windows"))


def removed(spark: SparkSession, docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept are the bytes that remain."""
    rows = keyed(docs, Scratch(spark, "suffix-rows"))
    windows = find_repeats(spark, rows.select("uid", "text"), length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for doc_id, text, found in rows_of(part, "doc_id", "text", "windows"):
                data = (text or "").encode()
                spans = removed_runs(found or [], length)
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*(b for b, _ in spans), len(data)]))
                yield doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept

        return batches(each(), schema)

    return rows.join(windows, "uid", "left").select("doc_id", "text", "windows").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut(spark: SparkSession, docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with repeats cut out of text, and n_chars, if there is one, the new number of characters.

    A character that a cut splits goes whole. Rows that lose nothing stay as they are, null texts too.
    """
    uid, windows, kept = (fresh(docs, n) for n in ("uid", "windows", "kept"))
    rows = with_uid(docs, Scratch(spark, "suffix-rows"), uid)
    found = find_repeats(spark, rows.select(F.col(uid).alias("uid"), "text"), length).select(F.col("uid").alias(uid), F.col("windows").alias(windows))

    def trim(texts: Iterator[tuple]) -> Iterator[str | None]:
        for text, found in texts:
            if not found or text is None:
                yield text
                continue
            data = text.encode()
            spans = removed_runs(found, length)
            ends = [0, *(e for _, e in spans)]
            yield "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(ends, [*(b for b, _ in spans), len(data)]))

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in part:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                new = pa.array(trim(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], new], names=[*batch.schema.names[2:], kept])

    others = [f for f in docs.schema.fields if f.name != "text"]
    ready = rows.join(found, uid, "left").select("text", windows, *(f.name for f in others))
    done = ready.mapInArrow(run, StructType([*others, StructField(kept, StringType())])).withColumnRenamed(kept, "text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return done.select(*docs.columns)


def digests(spark: SparkSession, docs: DataFrame, length: int = 100) -> DataFrame:
    return removed(spark, docs, length).drop("kept")
