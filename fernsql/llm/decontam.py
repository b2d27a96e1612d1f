"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table. A segment holds some documents; its tokens are numbered, with a gap after each
document, and every term has one row: the segment, the term and its postings, the ascending token numbers.
A search takes the terms of the test items, and in each segment intersects their postings, adjusted by the term's
place in the phrase, starting from the term with the fewest. Documents lie whole in one segment, so a segment
answers alone; nothing but the postings of wanted terms moves, and no term's postings ever meet in one task.

Items come in blocks of about ``block_words`` words, so what goes to each task has a fixed bound.
Nulls have no words. Rows of one doc_id are separate documents. Items without words never match. Ties: rows of
one item_id are separate phrases of the same item. An empty table of items leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, Scratch, batches, rows_of

#: Bytes that part words: ASCII but letters and digits (upper case is folded first).
BREAKS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in FOLD)
#: Tokens of a segment, about; a longer document is a segment of its own.
SEGMENT_TOKENS = 750_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BREAKS).split()


def build_index(docs: DataFrame, gap: int, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """(segment, term, n, postings, doc_ids, firsts): the empty term's row has the documents of the segment.

    postings: little-endian unsigned 32-bit differences of token numbers. firsts: the number of each document's
    first token, and where the next would begin.
    """
    schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64()))])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: dict[bytes, int] = {}
        seq: list[np.ndarray] = []
        doc_ids: list = []
        counts: list[int] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            segment = (task << 24) + made
            made += 1
            lengths = np.array(counts, np.int64)
            firsts = np.concatenate([[0], np.cumsum(lengths + gap)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([b""], pa.binary()), pa.array([int(lengths.sum())]), pa.array([b""], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([firsts], pa.list_(pa.int64()))], schema=schema
            )
            terms = np.concatenate(seq) if seq else np.zeros(0, np.int32)
            places = np.arange(len(terms), dtype=np.int64) + np.repeat(firsts[:-1] - (np.cumsum(lengths) - lengths), lengths)
            order = np.argsort(terms, kind="stable")
            sizes = np.bincount(terms, minlength=len(ids))
            ends = np.cumsum(sizes)
            steps = places[order]
            steps[1:] -= places[order][:-1].copy()
            heads = ends - sizes
            if len(steps):
                steps[heads] = places[order][heads]
            data = steps.astype("<u4").tobytes()
            names = list(ids)
            for at in range(0, len(names), 50_000):
                to = min(len(names), at + 50_000)
                low = int(heads[at])
                offsets = np.concatenate([heads[at:to], ends[to - 1 : to]]) - low
                cut = pa.py_buffer(data[low * 4 : int(ends[to - 1]) * 4])
                blob = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((offsets * 4).astype(np.int32)), cut])
                none = pa.nulls(to - at, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, segment)), pa.array(names[at:to], pa.binary()), pa.array(sizes[at:to]), blob, none, none], schema=schema)
            ids.clear(), seq.clear(), doc_ids.clear(), counts.clear()

        held = 0
        for doc_id, text in rows_of(part, "doc_id", "text"):
            w = words(text)
            if doc_ids and held + len(w) > segment_tokens:
                yield from close()
                held = 0
            for x in w:
                if x not in ids:
                    ids[x] = len(ids)
            seq.append(np.fromiter(map(ids.__getitem__, w), np.int32, len(w)))
            doc_ids.append(doc_id)
            counts.append(len(w))
            held += len(w) + gap
        if doc_ids:
            yield from close()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "segment long, term binary, n long, postings binary, doc_ids array<bigint>, firsts array<bigint>")


def phrase_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id as text, words), in blocks of about block_words words.

    A longer item comes in pieces that overlap by a window less one word, so that no window is lost or made.
    """
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for item_id, text in items.selectExpr("cast(item_id as string) item_id", "text").toLocalIterator():
        w = words(text)
        for at in range(0, max(1, len(w) - window + 1) if w else 0, block_words):
            piece = w[at : at + block_words + window - 1]
            block.append(("" if item_id is None else item_id, piece))
            held += len(piece)
            if held >= block_words:
                yield block
                block, held = [], 0
    if block:
        yield block


def _occurrences(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the phrase begins, and its anchor word's token: lists of token numbers by place, intersected from the shortest.

    With slop, the begin may lie before the document, the anchor doesn't; each word may be up to so many tokens off its place, in any order.
    """
    places = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    found = lists[places[0]] - places[0]
    for i in places[1:]:
        if not len(found):
            break
        want, there = found + i, lists[i]
        k = np.searchsorted(there, want - slop)
        found = found[(k < len(there)) & (there[np.minimum(k, len(there) - 1)] <= want + slop)]
    return found, found + places[0]


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int, slop: int = 0) -> DataFrame:
    """(doc_id, segment, at, n_words, hits, items) of every document of the index.

    hits: flat pairs of begin and end of hit runs of words in the document, sorted and apart. items: ids with
    an occurring window.
    """
    wanted = sorted({w for _, ws in items for w in ws})
    number = {w: i for i, w in enumerate(wanted)}
    coded = [(name, np.array([number[w] for w in ws])) for name, ws in items]
    spark = index.sparkSession
    terms = spark.createDataFrame([(bytearray(b""),), *((bytearray(w),) for w in wanted)], "term binary")
    # The terms of one block: block_words at most.
    rows = index.join(F.broadcast(terms), "term", "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("at", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(key, table):
        names = table.column("term").to_pylist()
        blobs = table.column("postings")
        lists: dict[int, np.ndarray] = {}
        head = names.index(b"")
        firsts = np.array(table.column("firsts")[head].as_py(), np.int64)
        doc_ids = table.column("doc_ids")[head].as_py()
        gap = window + slop
        for i, name in enumerate(names):
            if name:
                lists[number[name]] = np.cumsum(np.frombuffer(blobs[i].as_buffer(), "<u4"), dtype=np.int64)
        begins: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        doc_at: list[np.ndarray] = []
        of_item: list[tuple[str, np.ndarray]] = []
        there = np.zeros(len(number) + 1, bool)
        there[list(lists)] = True
        for name, code in coded:
            size = min(window, len(code))
            missing = np.concatenate([[0], np.cumsum(~there[code])])
            starts = np.flatnonzero(missing[size:] == missing[:-size])
            got = [x for s in starts.tolist() if len((x := _occurrences([lists[c] for c in code[s : s + size].tolist()], slop))[0])]
            if got:
                x, anchor = (np.concatenate(a) for a in zip(*got))
                doc_of = np.searchsorted(firsts, anchor, "right") - 1
                begins.append(x - slop)
                doc_at.append(doc_of)
                lengths.append(np.full(len(x), size + 2 * slop))
                of_item.append((name, np.unique(doc_of)))
        hits: list[list[int]] = [[] for _ in doc_ids]
        found: list[list[str]] = [[] for _ in doc_ids]
        if begins:
            b, n, doc = np.concatenate(begins), np.concatenate(lengths), np.concatenate(doc_at)
            last = firsts[doc + 1] - gap
            e = np.minimum(b + n, last)
            b = np.maximum(b, firsts[doc])
            order = np.argsort(b, kind="stable")
            for d, x, y in zip(doc[order].tolist(), (b - firsts[doc])[order].tolist(), (e - firsts[doc])[order].tolist()):
                run_ = hits[d]
                if run_ and x <= run_[-1]:
                    run_[-1] = max(run_[-1], y)
                else:
                    run_ += [x, y]
            for name, ds in of_item:
                for d in ds.tolist():
                    found[d].append(name)
        return pa.Table.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array([key[0].as_py()] * len(doc_ids), pa.int64()), pa.array(range(len(doc_ids)), pa.int64()), pa.array(np.diff(firsts) - gap), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], schema=schema
        )

    return rows.groupBy("segment").applyInArrow(run, "doc_id long, segment long, at long, n_words long, hits array<bigint>, items array<string>")


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, block_words: int = 200_000) -> DataFrame:
    """(doc_id, n_words, hits, items) of every document; see ``search``. Item ids are sorted as text, distinct."""
    scratch = Scratch(spark, "decontam")
    index = scratch.save(build_index(docs, window + slop), "index")
    found = [scratch.save(search(index, block, window, slop), f"found{i}") if i else search(index, block, window, slop) for i, block in enumerate(phrase_blocks(items, window, block_words))]
    if len(found) <= 1:
        only = found[0] if found else search(index, [], window, slop)
        return only.select("doc_id", "n_words", "hits", F.array_sort(F.array_distinct("items")).alias("items"))
    merged = reduce(DataFrame.unionAll, found)
    both = merged.groupBy("segment", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return _merge(both)


def _merge(found: DataFrame) -> DataFrame:
    """Hits of several blocks of items as sorted runs that are apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for doc_id, n, hits, items in rows_of(part, "doc_id", "n_words", "hits", "items"):
                out: list[int] = []
                for b, e in sorted(zip(hits[::2], hits[1::2])):
                    if out and b <= out[-1]:
                        out[-1] = max(out[-1], e)
                    else:
                        out += [b, e]
                yield doc_id, n, out, items

        return batches(each(), schema)

    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(run, "doc_id long, n_words long, hits array<bigint>, items array<string>")


def digests(found: DataFrame) -> DataFrame:
    """The counts and the digest of items of each row of ``find``."""
    n_hit = F.expr("aggregate(hits, named_struct('t', 0L, 's', -1L), (a, x) -> named_struct('t', a.t + a.s * x, 's', -a.s), a -> a.t)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
