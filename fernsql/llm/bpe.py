"""Byte-level BPE encoding and decoding.

Bytes map to Latin-1 characters, so that one Aho-Corasick automaton finds every vocabulary entry in a
piece. From the longest match at each place the encoder backtracks to shorter ones until each token is
compatible with the one before it: two tokens are compatible if merging their joined bytes gives just
those two. A sequence of compatible neighbours is the sequence that the merges make, so the result
equals rank-by-rank merging. Failed places are remembered, which bounds the work by the piece's length.

Nulls encode as the empty text. Rows are independent: repeats, ties and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches, rows_of

#: Entries kept of the two memo tables of a worker; a full table starts anew.
MEMO = 400_000


class Codec:
    """Encoder and decoder for one rank file (``base64 token`` and ``rank`` on each line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, while any pair has one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest vocabulary entry that is a proper prefix of the token."""
        if token not in self.shorter:
            data = self.tokens[token]
            self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)
        return self.shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * len(data)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - len(self.tokens[token])] = token  # ends ascend, so the last is the longest
        open_at = bytearray(b"\x01") * (len(data) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            while token is not None:
                end = at + len(self.tokens[token])
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token is None:
                if not out:
                    raise ValueError(f"no encoding for bytes {data!r}")
                open_at[at] = 0
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.next_shorter(token)
            else:
                out.append(token)
                at = end
                token = longest[at] if at < len(data) else None
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces, known = self.split(text), self.pieces
        out = [known.get(p) for p in pieces]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    p = pieces[i]
                    ids = known.get(p)
                    if ids is None:
                        tokens = self.encode_piece(p.encode())
                        ids = struct.pack(f"<{len(tokens)}I", *tokens)
                        if len(p) <= 64:
                            if len(known) >= MEMO:
                                known.clear()
                            known[p] = ids
                    out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: token count and digests of the ids and of the bytes they decode to.

    ``round_trip`` says whether the decoded bytes equal the text's. Null texts count as empty.
    """

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)

        def each() -> Iterator[tuple]:
            for doc_id, text in rows_of(part, "doc_id", "text"):
                text = text or ""
                ids = codec.encode_bytes(text)
                decoded = codec.decode(np.frombuffer(ids, "<u4").tolist())
                data = text.encode()
                yield doc_id, len(ids) // 4, len(data), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == data

        return batches(each(), SCHEMA)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id and the token ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        return batches(((d, codec.encode(t or "")) for d, t in rows_of(part, "doc_id", "text")), schema, 256)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id and the text of its ids; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        return batches(((d, codec.decode(i or []).decode("utf-8", "replace")) for d, i in rows_of(part, "doc_id", "ids")), schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
