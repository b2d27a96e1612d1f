"""Token ids in binary shards.

A shard holds documents of one range of ids in ascending order. Each document's ids are little-endian unsigned
integers (16 bits if all fit, else 32), compressed alone with a zstandard dictionary that all shards share, so a
short document is read by one seek and one small decompression.

Layout of a shard (all integers little-endian):
  magic 8 bytes | version u32 | id width u32 | documents u64 | index offset u64 | dictionary sha256 32 bytes
  frames, one after the other
  index: documents x (doc_id i64, start u64, tokens u64, frame offset u64, frame bytes u64)
``start`` counts ids of all documents before it, over all shards. The dictionary is a file beside them, named by its
hash; a reader refuses a dictionary whose hash differs. Files are written under another name and renamed, so a
retried task replaces its own work and a half-written shard is never read.

Null texts count as empty: just the end id. Rows of one doc_id are separate documents, in the order of a hash of the
text, then of their ids. A null doc_id comes first and is stored as the least 64-bit integer.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import struct
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import FOLD, Scratch, batches, groups, rows_of

MAGIC = b"TOKSHARD"
HEADER = "<8sIIQQ32s"
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n", "<u8"), ("offset", "<u8"), ("size", "<u8")])
NULL_ID = -(1 << 63)
#: Chunks in each of the two generations of a worker's memo.
MEMO = 900_000
#: Ranges of ids at most, and bytes of frames after which a shard is closed.
MOST_RANGES, SHARD_BYTES = 10_000, 64 << 20
#: Rows whose ids train the dictionary, and the most bytes of ids taken of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 112_640


class Encoder:
    """The tokenizer behind a memo of chunks.

    For tokenizers whose normaliser folds case and whose pre-tokenizer drops white space and parts letters from
    punctuation: neither looks across a space or line feed, so a text's ids are those of its chunks between
    these, one after the other. ``whole`` turns the memo off for tokenizers of which this isn't true.
    """

    def __init__(self, path: str, whole: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.marks = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.plain = None if whole else plain_tokenizer(path)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str, whole: bool = False) -> Encoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        return Encoder(path, whole)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What the memo lacks of all texts is encoded at once."""
        if self.whole:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        get, out, lacking = self.known.get, [], set()
        for text in texts:
            if not any(mark in text for mark in self.marks):  # the normaliser folds case, but not within special tokens
                text = text.encode().translate(FOLD).decode()
            chunks = text.replace("\n", " ").split(" ")
            ids = list(map(get, chunks))
            if None in ids:
                lacking.update([c for c, i in zip(chunks, ids) if i is None])
                out.append((chunks, ids))
            else:
                out.append((None, ids))
        new = self._learn(lacking) if lacking else {}
        return [b"".join(ids) if chunks is None else b"".join([new[c] if i is None else i for c, i in zip(chunks, ids)]) for chunks, ids in out]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the young generation lacks. Once that is full it becomes the old one."""
        if len(self.known) + len(chunks) > MEMO:
            self.older, self.known = self.known, {}
        known, older, got = self.known, self.older, {}
        todo: dict[str, bytes | None] = {}
        tails: list[tuple[str, str, str]] = []
        for c in chunks:
            ids = older.get(c)
            if ids is not None:
                known[c] = got[c] = ids
            elif c[-1:] in (".", ",") and (core := c.rstrip(".,"))[-1:].lower().isalpha():
                # A letter and a full stop or comma are never in one split.
                tail = c[len(core) :]
                tails.append((c, core, tail))
                for part in (core, tail):
                    if part not in known:
                        todo[part] = older.get(part)
            else:
                todo[c] = None
        self._encode([p for p, ids in todo.items() if ids is None], todo)
        got.update(todo)
        for c, core, tail in tails:
            todo[c] = got[c] = (got.get(core) or known[core]) + (got.get(tail) or known[tail])
        if all(len(c) <= 64 for c in todo):
            known.update(todo)
        else:
            known.update((c, ids) for c, ids in todo.items() if len(c) <= 64)
        return got

    def _encode(self, words: list[str], into: dict[str, bytes]) -> None:
        """Plain words go as one text, cut again at the ids that end words; if these don't number the words, singly."""
        plain = [w for w in words if w.isalpha() and max(w) < "\u0250" and w == w.lower()] if self.plain else []
        if plain:
            ids = self.plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids
            cuts = np.flatnonzero(self.ends[np.array(ids)]) + 1
            if len(cuts) == len(plain) and cuts[-1] == len(ids):
                data, at = array("I", ids).tobytes(), 0
                for w, to in zip(plain, (cuts * 4).tolist()):
                    into[w] = data[at:to]
                    at = to
        rest = [w for w in words if into.get(w) is None] if plain else words
        into.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))


def plain_tokenizer(path: str) -> Tokenizer | None:
    """The tokenizer without its normaliser and splits, which leave a lower-case Latin word of letters as it is.

    Such a letter is one composed character, so form C keeps it. None if the tokenizer has other steps or no ends of words.
    """
    out = Tokenizer.from_file(path)
    spec = json.loads(out.to_str())
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [x["type"] for x in normal.get("normalizers", [normal])]
    splits = [x["type"] for x in split.get("pretokenizers", [split])]
    if not spec["model"].get("end_of_word_suffix") or not set(steps) <= {"NFC", "Replace", "Lowercase"} or splits != ["Split", "ByteLevel"]:
        return None
    out.normalizer = None
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, name: str, data: bytes) -> None:
    fs, root = open_fs(uri)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    try:
        fs.move(part, f"{root}/{name}")
    except OSError:  # a store that refuses to replace what an earlier try of this task left
        if fs.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.NotFound:
            raise
        fs.delete_file(f"{root}/{name}")
        fs.move(part, f"{root}/{name}")


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, whole: bool = False) -> bytes:
    """A dictionary from the id arrays of at most SAMPLE_ROWS rows: those of the least hashes of doc_id, then of text."""
    order = F.xxhash64("doc_id", F.lit("dictionary"))
    ids = [r.doc_id for r in docs.select("doc_id").filter("doc_id is not null").orderBy(order, "doc_id").limit(SAMPLE_ROWS).collect()]
    # Parquet skips row groups that have none of the ids. A repeated id brings more rows, of which the limit takes no more.
    rows = docs.filter(F.col("doc_id").isin(ids)).orderBy(order, "doc_id", F.xxhash64("text")).limit(SAMPLE_ROWS)
    schema = pa.schema([("ids", pa.binary())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer_path, whole)
        return batches(((_pack(encoder.encode(t or ""), end_id, width)[:SAMPLE_BYTES],) for (t,) in rows_of(part, "text")), schema)

    samples = [bytes(r.ids) for r in rows.select("text").repartition(16).mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train from: their bytes serve as a raw dictionary
        return b"".join(samples)[:DICTIONARY_BYTES] or struct.pack("<I", end_id)


def _pack(ids: bytes, end_id: int, width: int) -> bytes:
    ids += struct.pack("<I", end_id)
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def range_bounds(ids: DataFrame, ranges: int, null_ranges: int) -> list[tuple[int, int]]:
    """Sorted bounds (id, hash of text) of about so many even ranges; where they fall changes no result.

    An id of many rows is several quantiles at once; its rows are parted by the hash, as are those without id.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = Counter(int(x) for x in ids.approxQuantile("doc_id", shares, 0.1 / ranges)) if shares else Counter()
    bounds = [(i, -(1 << 63)) for i in found]
    for i, times in [*found.items(), (NULL_ID, null_ranges)]:
        bounds += [(i, (k << 64) // (times + 1) - (1 << 63)) for k in range(1, times + 1) if times > 1]
    return sorted(set(bounds))


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, uri: str, shard_rows: int = 4096, level: int = 3, whole: bool = False) -> DataFrame:
    """Writes shards to the folder at uri; returns (shard long, documents long, tokens long).

    A range of ids is sorted in one task, which may spill, and written in shards of at most shard_rows documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 65536 and end_id < 65536 else 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width, whole)
    hashed = hashlib.sha256(dictionary).digest()
    write_file(uri, f"{hashed.hex()}.zdict", dictionary)
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, -(-n // shard_rows)))
    bounds = range_bounds(docs.select("doc_id"), ranges, (n - known) * ranges // max(1, n))
    schema = pa.schema([("part", pa.int32()), ("o", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])
    # The dictionary has a fixed size, so it goes with the function.

    def compress(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer_path, whole)
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))

        def each() -> Iterator[tuple]:
            for rows in groups(rows_of(part, "doc_id", "text")):
                texts = [t or "" for _, t in rows]
                for (doc_id, _), text, ids in zip(rows, texts, encoder.encode_all(texts)):
                    data = _pack(ids, end_id, width)
                    o = NULL_ID if doc_id is None else doc_id
                    h = xxhash.xxh64_intdigest(text) - (1 << 63)
                    yield bisect.bisect_right(bounds, (o, h)), o, h, len(data) // width, z.compress(data)

        return batches(each(), schema)

    frames = docs.mapInArrow(compress, "part int, o long, h long, n long, frame binary")
    placed = frames.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "o", "h", "n", "frame")
    out = pa.schema([("shard", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def write(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, now, made, size = [], [], None, 0, 0

        def close() -> None:
            entries = np.array([(o, 0, n, 0, len(f)) for o, n, f in held], ENTRY)
            entries["start"] = np.cumsum(entries["n"]) - entries["n"]
            entries["offset"] = struct.calcsize(HEADER) + np.cumsum(entries["size"]) - entries["size"]
            body = b"".join(f for _, _, f in held)
            shard = (now << 24) + made
            write_file(uri, file_name(shard), struct.pack(HEADER, MAGIC, 1, width, len(held), struct.calcsize(HEADER) + len(body), hashed) + body + entries.tobytes())
            done.append((shard, len(held), int(entries["n"].sum())))

        for range_, o, n, frame in rows_of(part, "part", "o", "n", "frame"):
            if held and (range_ != now or len(held) >= shard_rows or size >= SHARD_BYTES):
                close()
                held, size, made = [], 0, made + 1 if range_ == now else 0
            now = range_
            held.append((o, n, frame))
            size += len(frame)
        if held:
            close()
        return batches(iter(done), out)

    return Scratch(spark, "shards").save(placed.mapInArrow(write, "shard long, documents long, tokens long"), "manifest")


def file_name(shard: int) -> str:
    return f"{shard >> 24:06d}-{shard & 0xFFFFFF:06d}.tok"


class Shard:
    """Random access to one shard. ``start`` of its entries counts from the shard's first id."""

    def __init__(self, uri: str, shard: int):
        fs, root = open_fs(uri)
        self.file = fs.open_input_file(f"{root}/{file_name(shard)}")
        magic, version, self.width, count, at, self.hash = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC or version != 1:
            raise ValueError(f"shard {shard} has another format")
        self.entries = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, at), ENTRY)
        with fs.open_input_stream(f"{root}/{self.hash.hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.hash:
            raise ValueError("the dictionary's hash differs from the shard's")
        self.z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        e = self.entries[k]
        data = self.z.decompress(self.file.read_at(int(e["size"]), int(e["offset"])))
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this id."""
        a, b = np.searchsorted(self.entries["doc_id"], [doc_id, doc_id + 1])
        return [self.ids(k) for k in range(a, b)]


def read_shards(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files."""
    # Sums before each range of ids (MOST_RANGES rows at most), and before each shard within its range.
    part = F.shiftright("shard", 24)
    ranges = manifest.groupBy(part.alias("part")).agg(F.sum("tokens").alias("tokens"))
    first = ranges.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("part", part).withColumn("within", within).join(F.broadcast(first), "part")
    todo = placed.select("shard", (F.col("first") + F.col("within")).alias("before")).repartition(max(1, min(MOST_RANGES, manifest.count())), "shard")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for shard, first in rows_of(part, "shard", "before"):
                opened = Shard(uri, shard)
                for k, e in enumerate(opened.entries.tolist()):
                    ids = opened.ids(k)
                    yield None if e[0] == NULL_ID else e[0], first + e[1], len(ids), zlib.crc32(ids.tobytes()), shard

        return batches(each(), schema)

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def encode_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encodes docs to shards in the shared folder and reads them back."""
    uri = Scratch(spark, "tokens").root
    return read_shards(spark, write_shards(spark, docs, tokenizer_path, end_id, uri), uri)
