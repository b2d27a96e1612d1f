"""Toxic spans by a linear-chain conditional random field.

A document's words are one chain of two states. A word's features are itself, its prefixes and its place in the
sentence; the field has a weight for each and for each step between states. Forward-backward marginals give each
word's probability of being toxic. Their sum, maximum, mean and count above one half are a document's evidence,
which a logistic function turns into its score; runs of words above one half are the offending spans.

Labels are of documents, the field learns from labelled words: those words of toxic documents are labelled 1 that
carry a feature found far more often in toxic documents than in others; all other words are labelled 0. Learning
takes at most ``most_docs`` labelled rows of each class (of at most ``most_chars`` characters), chosen by a hash of
doc_id; everything else covers all rows and whole texts.

Null and empty texts have no evidence: they get the score of a document without any. Repeated labels of a document
each count; of repeated rows of a document the text of the least hash is learned from. Without labels of both classes all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import batches, crc32_mod, groups, rows_of

PREFIXES = (3, 4, 5, 6, 7)
CHUNK = 64
MEMO = 200_000
EDGE = re.compile(r"^\W+|\W+$")


def word_features(word: str) -> list[str]:
    w = EDGE.sub("", word).lower()
    if not w:
        return []
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)]


def place_bits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: whether it ends a sentence, and whether it begins in lower case."""
    return np.fromiter((w[-1] in ".!?" for w in words), bool, len(words)), np.fromiter((w[0].islower() for w in words), bool, len(words))


@dataclass
class Field:
    """weights: of word features. places: of (follows a sentence's end) x (begins in lower case)."""

    weights: dict[str, float] = field(default_factory=dict)
    places: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray | None = None
    known: dict[str, int] = field(default_factory=dict)
    scores: list[float] = field(default_factory=list)
    ends: list[bool] = field(default_factory=list)
    lower: list[bool] = field(default_factory=list)

    def __getstate__(self):
        return {"weights": self.weights, "places": self.places, "steps": self.steps, "doc": self.doc}

    def __setstate__(self, state):
        self.__init__(**state)

    def forget(self) -> None:
        """Drops the memo of words."""
        self.known, self.scores, self.ends, self.lower = {}, [], [], []

    def emissions(self, docs: list[list[str]]) -> np.ndarray:
        """The score of state 1 over state 0 of every word of the documents, one after another."""
        words = [w for d in docs for w in d]
        if len(self.known) > MEMO:
            self.forget()
        known = self.known
        ids = [known.get(w) for w in words]
        if None in ids:
            for k, w in enumerate(words):
                if ids[k] is None:
                    if w not in known:
                        known[w] = len(self.scores)
                        self.scores.append(sum(self.weights.get(f, 0.0) for f in word_features(w)))
                        self.ends.append(w[-1] in ".!?")
                        self.lower.append(w[0].islower())
                    ids[k] = known[w]
        at = np.array(ids, np.int64)
        ends = np.array(self.ends, bool)[at]
        after = np.concatenate([[True], ends[:-1]]) if len(at) else ends
        begins = np.cumsum([0, *map(len, docs)])[:-1]
        after[begins[begins < len(at)]] = True
        return np.array(self.scores)[at] + self.places[after.astype(int), np.array(self.lower, bool)[at].astype(int)]


def marginals(emission: np.ndarray, lengths: np.ndarray, steps: np.ndarray, pairs: bool = False):
    """P(state 1) of each word of chains laid one after another, and the expected steps if pairs.

    Chains are cut in chunks. Products of the steps over each chunk, made for all chunks at once, carry the forward
    and backward vectors across the cuts, so the result is that of the whole chain.
    """
    n = len(emission)
    expected = np.zeros((2, 2))
    if not n:
        return (np.zeros(0), expected) if pairs else np.zeros(0)
    lengths = lengths[lengths > 0]
    chunks = -(-lengths // CHUNK)
    first = np.cumsum(lengths) - lengths
    head = np.repeat(first, chunks) + CHUNK * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    last = np.repeat(first + lengths, chunks)
    size = np.minimum(CHUNK, last - head)
    opens = np.zeros(len(head), bool)
    opens[np.cumsum(chunks) - chunks] = True
    at = head[:, None] + np.arange(CHUNK)
    live = np.arange(CHUNK) < size[:, None]
    e = np.where(live, emission[np.minimum(at, n - 1)], 0.0)
    one, zero = np.where(e > 0, 1.0, np.exp(np.minimum(e, 0))), np.where(e > 0, np.exp(-np.maximum(e, 0)), 1.0)
    t = np.exp(steps - steps.max())
    unit = np.eye(2)

    def link(k: int, start: bool) -> tuple:
        """Entries of the step matrix into column k of each chunk; a chain's first word has no step."""
        free = opens & start
        return tuple(np.where(live[:, k], np.where(free, 1.0, t[i, j]) * (one if j else zero)[:, k], unit[i, j]) for i in (0, 1) for j in (0, 1))

    c = len(head)
    m = [np.ones(c), np.zeros(c), np.zeros(c), np.ones(c)]
    for k in range(CHUNK):
        a, b, x, y = link(k, k == 0)
        m = [m[0] * a + m[1] * x, m[0] * b + m[1] * y, m[2] * a + m[3] * x, m[2] * b + m[3] * y]
        s = m[0] + m[1] + m[2] + m[3]
        m = [v / s for v in m]
    fwd, bwd = np.empty((c, 2)), np.empty((c, 2))
    rows = np.stack(m, 1).tolist()
    p, q = 0.5, 0.5
    for k in range(c):
        if opens[k]:
            p, q = 0.5, 0.5
        fwd[k] = p, q
        a, b, x, y = rows[k]
        p, q = p * a + q * x, p * b + q * y
        s = p + q
        p, q = p / s, q / s
    p, q = 0.5, 0.5
    for k in range(c - 1, -1, -1):
        if k == c - 1 or opens[k + 1]:
            p, q = 0.5, 0.5
        bwd[k] = p, q
        a, b, x, y = rows[k]
        p, q = a * p + b * q, x * p + y * q
        s = p + q
        p, q = p / s, q / s
    alpha = np.empty((c, CHUNK, 2))
    p, q = fwd[:, 0], fwd[:, 1]
    for k in range(CHUNK):
        a, b, x, y = link(k, k == 0)
        p, q = p * a + q * x, p * b + q * y
        s = p + q
        p, q = p / s, q / s
        alpha[:, k, 0], alpha[:, k, 1] = p, q
    out = np.empty((c, CHUNK))
    p, q = bwd[:, 0], bwd[:, 1]
    for k in range(CHUNK - 1, -1, -1):
        u, v = alpha[:, k, 0] * p, alpha[:, k, 1] * q
        out[:, k] = v / (u + v)
        a, b, x, y = link(k, k == 0)
        if pairs:
            f0, f1 = (fwd[:, 0], fwd[:, 1]) if k == 0 else (alpha[:, k - 1, 0], alpha[:, k - 1, 1])
            z = [f0 * a * p, f0 * b * q, f1 * x * p, f1 * y * q]
            s = z[0] + z[1] + z[2] + z[3]
            use = live[:, k] & ~(opens & (k == 0))
            for i in range(4):
                expected[i // 2, i % 2] += (z[i] / s)[use].sum()
        p, q = a * p + b * q, x * p + y * q
        s = p + q
        p, q = p / s, q / s
    return (out[live], expected) if pairs else out[live]


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: log of 1 + sum, maximum, mean, log of 1 + count above one half."""
    out = np.zeros((len(lengths), 4))
    some = lengths > 0
    if some.any():
        heads = (np.cumsum(lengths) - lengths)[some]
        total = np.add.reduceat(p, heads)
        out[some] = np.stack([np.log1p(total), np.maximum.reduceat(p, heads), total / lengths[some], np.log1p(np.add.reduceat((p > 0.5).astype(float), heads))], 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for logistic regression with an intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= np.clip(d, -3, 3)
        if np.abs(d).max() < 1e-6:
            break
    return w


def markers(docs: list[list[str]], toxic: np.ndarray, least: int = 3, lift: float = 6.0) -> set[str]:
    """Features found in at least ``least`` toxic documents, and ``lift`` times as often there as in others."""
    counts = (Counter(), Counter())
    for d, t in zip(docs, toxic):
        counts[int(t)].update({f for w in set(d) for f in word_features(w)})
    many, few = toxic.sum() + 1, len(toxic) - toxic.sum() + 1
    return {f for f, a in counts[1].items() if a >= least and (a + 0.5) / many >= lift * (counts[0][f] + 0.5) / few}


def train(texts: list[str], toxic: list[int], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Fits the field, then the logistic function of the evidence."""
    y = np.array(toxic, bool)
    model = Field()
    if not y.any() or y.all():
        return model
    docs = [t.split() for t in texts]
    marked = markers(docs, y)
    words = [w for d in docs for w in d]
    lengths = np.array([len(d) for d in docs])
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    features: dict[str, int] = {}
    rows, cols, hot = [], [], np.zeros(len(names), bool)
    for w, i in names.items():
        for f in word_features(w):
            rows.append(i)
            cols.append(features.setdefault(f, len(features)))
            hot[i] |= f in marked
    rows, cols = np.array(rows), np.array(cols)
    label = hot[ids] & np.repeat(y, lengths)
    # A feature of no labelled word would only be pushed down; leaving it at zero keeps the table small.
    use = np.zeros(len(features), bool)
    used_words = np.zeros(len(names), bool)
    used_words[ids[label]] = True
    use[cols[used_words[rows]]] = True
    keep = use[cols]
    rows, cols = rows[keep], cols[keep]
    ends, lower = place_bits(words)
    after = np.concatenate([[True], ends[:-1]])
    begins = np.cumsum(lengths) - lengths
    after[begins[begins < len(after)]] = True
    place = after.astype(int) * 2 + lower
    w, b, s = np.zeros(len(features)), np.zeros(4), np.zeros(4)
    b[:] = -2.0
    state = [np.zeros_like(v) for v in (w, b, s)]
    inner = np.ones(len(words), bool)
    inner[begins[begins < len(words)]] = False
    prior = np.concatenate([[False], label[:-1]])
    seen = np.bincount((prior * 2 + label)[inner], minlength=4).astype(float)
    n = len(words)
    for _ in range(rounds):
        emission = np.bincount(rows, w[cols], len(names))[ids] + b[place]
        p, pair = marginals(emission, lengths, s.reshape(2, 2), True)
        gap = p - label
        by_word = np.bincount(ids, gap, len(names))
        grads = (np.bincount(cols, by_word[rows], len(features)) + ridge * n * w * use, np.bincount(place, gap, 4), pair.ravel() - seen)
        for v, g, acc in zip((w, b, s), grads, state):
            acc += g * g
            v -= rate * g / (np.sqrt(acc) + 1e-9)
    model.weights = {f: float(w[i]) for f, i in features.items() if use[i] and abs(w[i]) > 1e-4}
    model.places, model.steps = b.reshape(2, 2), s.reshape(2, 2)
    model.doc = _logistic(evidence(marginals(emission, lengths, model.steps), lengths), y.astype(float))
    return model


def score(model: Field, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores and offending word runs (begin, end) of the texts."""
    docs = [t.split() for t in texts]
    lengths = np.array([len(d) for d in docs])
    if model.doc is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    p = marginals(model.emissions(docs), lengths, model.steps)
    x = evidence(p, lengths)
    out = 1 / (1 + np.exp(-np.clip(x @ model.doc[:-1] + model.doc[-1], -30, 30)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    bounds = np.cumsum(lengths)
    hot = np.flatnonzero(p > 0.5)
    for d, k in zip(np.searchsorted(bounds, hot, "right").tolist(), hot.tolist()):
        k -= int(bounds[d] - lengths[d])
        if spans[d] and spans[d][-1][1] == k:
            spans[d][-1] = (spans[d][-1][0], k + 1)
        else:
            spans[d].append((k, k + 1))
    return out, spans


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 5, most_docs: int = 1500, most_chars: int = 12_000) -> Field:
    """Learns from labelled rows whose crc32(doc_id) mod modulus isn't 0."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (crc32_mod(F.col("doc_id"), modulus) != 0))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = None
    for t in (0, 1):
        part = rows.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(most_docs)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = chosen.groupBy("doc_id", "toxic").count()
    # most_docs rows of three numbers for each class. Of rows of one id one text is taken, so no more come to the driver.
    light = docs.select("doc_id", "text").filter(F.char_length("text") <= most_chars).join(F.broadcast(chosen), "doc_id")
    texts = light.groupBy("doc_id", "toxic", "count").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    texts.sort(key=lambda r: (r.doc_id, r.toxic))
    return train([r.text for r in texts for _ in range(r["count"])], [r.toxic for r in texts for _ in range(r["count"])])


def classify(docs: DataFrame, model: Field, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): spans are flat pairs of begin and end character of runs of words."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.int32()))])
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), modulus) == 0).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value

        def each() -> Iterator[tuple]:
            for rows in groups(rows_of(part, "doc_id", "held_out", "text"), 2_000_000, 2000):
                texts = [t or "" for _, _, t in rows]
                s, spans = score(found, texts)
                for (doc_id, held, _), x, runs, text in zip(rows, s.tolist(), spans, texts):
                    yield doc_id, held, x, int(x >= 0.5), offsets(text, runs)
            found.forget()

        return batches(each(), schema)

    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<int>")


def attach(docs: DataFrame, model: Field, name: str) -> DataFrame:
    """docs with a new column of that name (1: toxic), row by row, so that no key has to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for whole in part:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                s, _ = score(found, [t or "" for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, name])
        found.forget()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, IntegerType())]))


def offsets(text: str, runs: list[tuple[int, int]]) -> list[int]:
    """Runs of words as flat pairs of character offsets."""
    if not runs:
        return []
    places = [m.span() for m in re.finditer(r"\S+", text)]
    # str.split and \S agree but on U+001C to U+001F, at which only split parts words.
    if len(places) != len(text.split()):
        places = [m.span() for m in re.finditer("[^\\s\x1c-\x1f]+", text)]
    return [x for a, b in runs for x in (places[a][0], places[b - 1][1])]
