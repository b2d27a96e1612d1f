"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: hashes of word shingles, a bit set if over half of the hashes have it. Distinct fingerprints are put in
tiles by bit counts; tile pairs whose counts differ beyond the radius are skipped, as no pair of theirs can link. The others
are compared in numpy by exclusive-or and bit counts. From each pair of tiles a spanning forest of its links comes
out, never all pairs, and connected components join the forests. Large tiles are cut in pieces, each pair of
pieces a row of its own; pieces grow with the root of the number of fingerprints, as does the number of bit-count
blocks, so that what is sent stays small beside what is compared.

``near_duplicates`` links 64-bit fingerprints (XXH64, seed 42, shingles with repeats) within a radius.
``near_copies`` links texts whose sets of shingles have a Jaccard similarity of ``least`` or more: candidates are
pairs of 256-bit fingerprints of the sets within WIDE_RADIUS bits, and FIRST_RADIUS among the first 64; candidates are
confirmed by the exact similarity of their sets. Tiles of sets whose sizes already rule the similarity out are skipped
too. A pair at 0.8 differs by 39 bits on average, with a deviation of 6, and by 10 among the first 64, with one of 3, so one in
some 10,000 is missed.

Nulls and texts without words have fingerprint zero and no shingles; they link as any other. Repeated rows share a
component.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, Scratch, batches, join_hot, rows_of
from .components import connected_components

U = np.uint64
#: Blocks whose bit counts make a tile, up to so many fingerprints: more blocks skip more pairs, and send more.
BLOCKS = (2, 1_000_000), (4, 50_000_000), (8, None)
#: Fewest and most fingerprints of a piece of a tile.
PIECES = 4096, 131_072
#: Bits by which candidates for near copies differ at most: of 256, and of the first 64.
WIDE_RADIUS, FIRST_RADIUS = 64, 20
SEEDS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 4).astype(U)
#: Shingles of the sets that are confirmed together, at most about; a candidate group of more than SPREAD goes to several tasks.
PIECE, SPREAD = 1_000_000, 10_000


# Fingerprints -------------------------------------------------------------------------------------------------


def bit_totals(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each bit, from the lowest. Sums of 255 rows fit in a byte."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        if whole < len(part):
            total += bits[whole:].sum(0, dtype=np.uint8)
    return total


def majority(h: np.ndarray) -> int:
    return int(np.packbits(bit_totals(h) * 2 > len(h), bitorder="little").view(U)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Lower-cases A-Z, cuts words at ASCII white space, hashes shingles (fewer words: the sequence)."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, seed) for g in grams), U))


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(((d, signed(fingerprint(t, shingle, seed))) for d, t in rows_of(part, "doc_id", "text")), schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# Tiles --------------------------------------------------------------------------------------------------------


def _near(one: np.ndarray, two: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose words differ by at most radius bits; two's length is a multiple of 8."""
    near = np.bitwise_count(one[:, None] ^ two[None, :]) <= radius
    eights = np.flatnonzero(near.reshape(-1).view(U))  # hits are rare, so they are looked for eight at a time
    if not len(eights):
        return eights, eights
    k, place = np.nonzero(near.reshape(-1, 8)[eights])
    return np.divmod(eights[k] * 8 + place, len(two))


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, first_radius: int | None = None) -> Iterator[tuple[int, int]]:
    """Places (in a, in b; in a where b is None) of links that connect what all pairs within the radius connect.

    Rows are fingerprints of one or more 64-bit words. Only pairs whose sides aren't connected yet leave numpy.
    """
    same, n = b is None, len(a)
    b = a if same else b
    off = 0 if same else n
    parent = np.arange(n if same else n + len(b))
    root = parent.copy()

    def find(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = parent[up]
            x = up
        return x

    one, two = np.ascontiguousarray(a[:, 0]), np.zeros(-(-len(b) // 8) * 8, U)
    two[: len(b)] = b[:, 0]
    step = max(1, (1 << 18) // max(1, len(two)))
    for at in range(0, n, step):
        low = at // 8 * 8 if same else 0
        i, j = _near(one[at : at + step], two[low:], radius if first_radius is None else min(radius, first_radius))
        i, j = i + at, j + low
        there = j < len(b)
        i, j = i[there], j[there]
        apart = root[i] != root[off + j]
        i, j = i[apart], j[apart]
        if len(i) and a.shape[1] > 1:
            near = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= radius
            i, j = i[near], j[near]
        if not len(i):
            continue
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(x), find(off + y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                yield x, y
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        root[:] = parent


def piece_rows(n: int) -> int:
    """Fingerprints of a piece: what is sent and what is compared grow alike if pieces grow with the root of all."""
    return min(PIECES[1], max(PIECES[0], 32 * math.isqrt(n)))


def block_offsets(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the differences of block counts within the radius: each pair of tiles meets once."""

    def vectors(k: int, left: int) -> Iterator[tuple[int, ...]]:
        if not k:
            yield ()
        else:
            for d in range(-left, left + 1):
                yield from ((d, *rest) for rest in vectors(k - 1, left - abs(d)))

    return [d for d in vectors(blocks, radius) if d > (0,) * blocks]


def compare(rows: DataFrame, words: list[str], steps: list[int], rows_each: int, radius: int, first_radius: int | None = None, few: bool = True) -> DataFrame:
    """(a, b): names of linked rows (tile long, name long, words); tiles meet themselves and the tiles these steps on.

    Without words the name is the fingerprint. few: the number of possible tiles is bounded by 100,000.
    """
    sizes = rows.groupBy("tile").count().select("tile", F.ceil(F.col("count") / rows_each).cast("int").alias("cuts"))
    sizes = F.broadcast(sizes) if few else sizes
    placed = rows.join(sizes, "tile").withColumn("cut", F.pmod(F.xxhash64("name"), F.col("cuts")).cast("int"))
    pieces = placed.groupBy("tile", "cut").agg(F.collect_list(F.struct("name", *words)).alias("rows"))
    meet = pieces.select(F.col("tile").alias("own"), F.col("cut").alias("own_cut"), "rows", F.explode(F.array(*(F.lit(s).cast("long") for s in [0, *steps]))).alias("step"))
    meet = meet.withColumn("tile", F.col("own") + F.col("step")).join(sizes, "tile")
    left = meet.select("tile", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "own", "own_cut", "rows").filter("tile != own or cut >= own_cut")
    pairs = left.join(pieces.withColumnRenamed("rows", "others"), ["tile", "cut"]).selectExpr("tile = own and cut = own_cut as same", "rows", "others")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def unpacked(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        name, *rest = (x.to_numpy() for x in rows.values.flatten())
        return name, np.stack(rest or [name], 1).view(U)

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in part:
                same, rows, others = (batch.column(i) for i in range(3))
                for k in range(batch.num_rows):
                    x, a = unpacked(rows[k])
                    y, b = (x, None) if same[k].as_py() else unpacked(others[k])
                    for p, q in forest(a, b, radius, first_radius):
                        yield int(x[p]), int(y[q])

        return batches(each(), schema)

    return pairs.mapInArrow(run, "a long, b long")


# 64-bit fingerprints within a radius --------------------------------------------------------------------------


def links(fps: DataFrame, radius: int = 3, blocks: int | None = None, rows_each: int | None = None) -> DataFrame:
    """(a long, b long): links between distinct fingerprints (column fp) that connect all within the radius."""
    n = fps.count() if blocks is None or rows_each is None else 0
    blocks, rows_each = blocks or next(b for b, most in BLOCKS if most is None or n <= most), rows_each or piece_rows(n)
    bits = 64 // blocks
    count = [F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))) for i in range(blocks)]
    # A block's count is at most its bits; the base keeps codes of neighbours apart.
    base = bits + 2 * radius + 1
    tile = sum((c.cast("long") * base**i for i, c in enumerate(count)), F.lit(0).cast("long"))
    steps = [sum(d * base**i for i, d in enumerate(off)) for off in block_offsets(blocks, radius)]
    return compare(fps.select(tile.alias("tile"), F.col("fp").alias("name")), [], steps, rows_each, radius, few=blocks <= 4)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs; the component's smallest doc_id.

    A null doc_id takes part in linking; a component of null ids only has a null component_id.
    """
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs, shingle, seed), "fps")
    least = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = scratch.save(links(least.select("fp"), radius), "links")
    joined = connected_components(found, scratch)
    # Only fingerprints with links are in the components; the others are their own.
    of = least.join(joined, least.fp == joined.node, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = of.join(ids, "root").select("fp", "n", "component_id")
    return join_hot(fps, roots, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by the similarity of shingle sets ------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; a text of fewer words has its sequence, one without words none."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    take = min(size, len(w))
    x = np.full(len(w) - take + 1, take, U)
    for i in range(take):
        x = _mix(x + w[i : len(w) - take + 1 + i])
    return np.unique(x)


WORDS = ["w0", "w1", "w2", "w3"]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, whole, n, w0 to w3) of docs (row, text): the set's own hash, its size and its 256-bit fingerprint."""
    schema = pa.schema([(c, pa.int64()) for c in ("row", "whole", "n", *WORDS)])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for row, text in rows_of(part, "row", "text"):
                x = shingle_set(text, shingle)
                yield row, signed(xxhash.xxh64_intdigest(x.tobytes())), len(x), *(signed(majority(_mix(x ^ s))) for s in SEEDS)

        return batches(each(), schema)

    return docs.select("row", "text").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def connect(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links (places in sets) that connect what all pairs of a similarity of at least ``least`` connect."""
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    left, mark = np.arange(len(sets)), np.zeros(len(names), bool)
    rest = flat
    while len(left):
        queue = [left[0]]
        rest, left = rest[sizes[left[0]] :], left[1:]
        while queue and len(left):
            x = queue.pop()
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            n = sizes[left]
            both = np.add.reduceat(mark[rest], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = False
            # The quotient of whole numbers, as a direct comparison with the definition has it.
            near = both / (n + sizes[x] - both) >= least
            if near.any():
                found = left[near]
                rest, left = rest[np.repeat(~near, n)], left[~near]
                queue.extend(found)
                yield from ((int(x), int(y)) for y in found)


def _confirmed(members: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b): links between sets; members (component, name, n) are the candidates, names rows of docs.

    What candidates connect is compared exactly, each pair that isn't connected already; a large component in pieces,
    each pair of pieces a unit of its own. Pieces grow with the root of the component, up to a bound.
    """
    sizes = members.groupBy("component").agg(F.sum("n").alias("all")).select("component", F.greatest(F.ceil(F.sqrt(F.col("all") / SPREAD)), F.ceil(F.col("all") / PIECE)).cast("int").alias("cuts"))
    cut = members.join(sizes, "component").withColumn("cut", F.pmod(F.xxhash64("name"), F.col("cuts")).cast("int"))
    other = F.explode(F.when(F.col("cuts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("cuts") - 1), F.col("cut"))))
    texts = docs.select(F.col("row").alias("name"), "text")
    units = texts.join(cut, "name").withColumn("other", other).select("component", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "name", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, unit in itertools.groupby(rows_of(part, "component", "i", "j", "name", "text"), key=lambda r: r[:3]):
                ids, sets = zip(*((r[3], shingle_set(r[4], shingle)) for r in unit))
                for x, y in connect(list(sets), least):
                    yield ids[x], ids[y]

        return batches(each(), schema)

    return units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, least: float, rows_each: int | None = None) -> DataFrame:
    """(a, b): names of sets (name, n, w0 to w3) whose fingerprints are near. Tiles: size bands by bit counts.

    A band's sizes span a factor of the root of 1 / least, so only two bands on can still be similar.
    """
    band = F.floor(2 * F.log("n") / -math.log(least) + 1e-6).cast("long")
    bits = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0]))
    # Counts go by 64 to a tile: tiles whose counts differ beyond the radius are two or more apart.
    rows = sets.select((band * 16 + F.floor(bits / WIDE_RADIUS)).alias("tile"), "name", *WORDS)
    steps = [b * 16 + p for b in (0, 1, 2) for p in (-1, 0, 1) if b or p > 0]
    return compare(rows, WORDS, steps, rows_each or piece_rows(sets.count()), WIDE_RADIUS, FIRST_RADIUS)


def near_copies(spark: SparkSession, docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(row, root) of docs (row unique long, text): rows of one root are one group of near copies."""
    scratch = Scratch(spark, "near-copies")
    rows = scratch.save(signatures(docs, shingle), "signatures")
    key = ["whole", "n", *WORDS]
    sets = scratch.save(rows.groupBy(*key).agg(F.min("row").alias("name"), F.count("*").alias("rows")), "sets")
    # Smaller sets are similar only if equal.
    able = sets.filter(F.col("n") >= math.ceil(least / (1 - least) - 1e-9) if least < 1 else F.lit(False))
    near = connected_components(scratch.save(candidates(able, least), "candidates"), scratch)
    members = scratch.save(sets.join(near, sets.name == near.node).select("component", "name", "n"), "members")
    links = scratch.save(_confirmed(members, docs, shingle, least), "links")
    joined = connected_components(links, Scratch(spark, "near-copies-links"))
    of = sets.join(joined, sets.name == joined.node, "left").select(*key, "rows", F.coalesce("component", "name").alias("root"))
    return join_hot(rows, of, key, "rows").select("row", "root")
