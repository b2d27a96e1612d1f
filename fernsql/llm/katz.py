"""Katz backoff language model.

A text is its words and one end. An n-gram of order m is a token and the m - 1 before it in its text; before a text's
first token stands one start, so the first token has order two at most, the second three, and so on. P(w | h) is the
Good-Turing discounted share of (h, w) among the n-grams with context h if it was seen, else the weight of h
times P(w | h'), where h' lacks the first word of h, and so on down to P(w), the discounted share of w among all tokens;
what the discounts leave there is the probability of the one class of all unseen words. The weight of h makes the
probabilities of all words and that class after h sum to one: 1 less the seen shares, over 1 less the P of the same words
after h'. A context that isn't known has P(w | h) = P(w | h').

Everything is learned from all training rows. Texts are cut in blocks of about BLOCK_TOKENS tokens; a block's tokens are
written once as numbers in a list of its distinct words. Then come exchanges of one form, one for each order: blocks
send their sorted, packed distinct n-grams to ranges; a range merges them and answers each block in the order it asked:
counts, places, and the sums of its contexts that give their weights, these only where the block backs off. What a context
was seen with in all is its own count, as each token but the end is followed by one. An n-gram is named by its range and
place, so one of order m + 1 is a name and a word; those of the last order need no names. A context lies in one range;
one of over HOT_CONTEXT tokens is spread over as many as its count asks for, and its sums meet by a further exchange.
A word or n-gram is one entry of a block however often it occurs. One that only one block has is marked so
in the answer, an n-gram without a name: what follows it can't be elsewhere, so the block counts such longer n-grams itself (they
are in its partition of tokens) and doesn't send them. A block then evaluates its tokens from the lowest order up, which
is the recursion read from its end. The model is the answers that the blocks hold; no other table of it is written.

Words meet by their 64-bit XXH64. Null texts are empty: one end. A null id hashes as the empty text. Repeated rows
each count. Without training rows all words are unseen and every probability is 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, Scratch, batches, rows_of
from .suffixes import pack, unpack
from .tokens import open_fs, write_file

BLOCK_TOKENS = 1_000_000
#: Entries of all blocks that a range merges, about.
RANGE_ENTRIES = 1_500_000
#: Tokens of a context that lie in one range; a more frequent one is spread.
HOT_CONTEXT = 400_000
#: In how many turns each order above one is exchanged: the shuffle files of one are gone before the next.
TURNS = 2
#: Counts up to this are discounted.
K = 5
#: Keys that no word has, as words hold no space.
END, START = (xxhash.xxh64_intdigest(x) for x in (b" ", b"  "))
ROWS = "block long, kind int, part int, blob binary"
SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
U, I, D = np.uint64, np.int64, np.float64
#: Kinds of rows.
WORDS, ASKED, ASKED_HOT, ANSWER, STATS, SUMS, CONTEXTS, HOT_ASKED, HOT_ANSWER = range(9)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def _blobs(table, kind: int) -> list[tuple[int, int, bytes]]:
    """(part, block, blob) of a kind, in this order."""
    found = [(p, b, x.as_py()) for k, p, b, x in zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("block").to_pylist(), table.column("blob")) if k == kind]
    return sorted(found, key=lambda r: r[:2])


def _deltas(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def _sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def _run_deltas(a: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Deltas within the runs of equal values of run; each run's first value stays."""
    out = _deltas(a)
    heads = _heads(run)
    out[heads] = a[heads]
    return out


def _run_sums(a: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Undoes ``_run_deltas``."""
    heads = _heads(run)
    out = _sums(a)
    return out - np.repeat(out[heads] - a[heads], np.diff(np.append(heads, len(a))))


def _heads(a: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, I)


# Blocks -------------------------------------------------------------------------------------------------------


def blocks(docs: DataFrame, modulus: int, uri: str) -> DataFrame:
    """Rows of kind WORDS: sorted keys and training counts, that of the start being its texts'; part: tokens.

    A block's documents (id, null, tokens, held out) and word numbers are a file in the folder at uri, which a retried
    task writes again alike.
    """

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: dict[bytes, int] = {}
        seq: list[np.ndarray] = []
        meta: list[tuple] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal made
            block = (task << 24) + made
            made += 1
            digest = xxhash.xxh64_intdigest
            keys = np.fromiter((digest(w) for w in ids), U, len(ids))
            keys[0], keys[1] = END, START
            order = np.argsort(keys)
            rank = np.empty(len(keys), I)
            rank[order] = np.arange(len(keys))
            numbers = rank[np.concatenate(seq)]
            doc_id, null, n, out = (np.array(x, I) for x in zip(*meta))
            counts = np.bincount(numbers[np.repeat(out == 0, n)], minlength=len(keys))
            counts[rank[1]] = (out == 0).sum()
            tokens = pack(numbers, body=int(rank[1]).to_bytes(8, "little"))
            about = pack(doc_id, null, n, out)
            write_file(uri, f"{block}.tokens", len(about).to_bytes(8, "little") + about + tokens)
            return _table([(block, WORDS, len(numbers), pack(keys[order], counts.astype(I)))]).to_batches()[0]

        for doc_id, text in rows_of(part, "doc_id", "text"):
            if not ids:
                ids[b" end"], ids[b" start"] = 0, 1
            words = (text or "").encode().translate(FOLD).split()
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
            line = np.zeros(len(words) + 1, np.int32)
            line[:-1] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
            seq.append(line)
            out = int(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0)
            meta.append((doc_id or 0, int(doc_id is None), len(line), out))
            held += len(line)
            if held >= BLOCK_TOKENS:
                yield close()
                ids, seq, meta, held = {}, [], [], 0
        if meta:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


# Discounts ----------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to K+1 (the last for all above) from n[r], how many keys have count r.

    Where the counts of counts give no discount between 0 and 1, one half is taken off each count instead.
    """
    d = np.ones(K + 2)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    good = common < 1 and all(n[r] and n[r + 1] for r in range(1, K + 1))
    for r in range(1, K + 1):
        d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if good else 0.0
    if not good or not ((d[1 : K + 1] > 0) & (d[1 : K + 1] < 1)).all():
        d[1 : K + 1] = 1 - 0.5 / np.arange(1, K + 1)
    return d


def _word_p(c: np.ndarray, model: dict) -> np.ndarray:
    """P(w) of words by their counts."""
    if not model["N"]:
        return np.ones(len(c))
    return np.where(c > 0, model["d"][0][np.minimum(c, K + 1)] * c / model["N"], model["unseen"])


# Words --------------------------------------------------------------------------------------------------------


def _slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the parts that sorted 64-bit keys have, by even ranges."""
    part = ((keys >> U(32)) * U(parts) >> U(32)).astype(I)
    heads = _heads(part)
    return zip(part[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(part)])


def _stats(counts: np.ndarray, places: int) -> bytes:
    """Sum and number of the counts, how many are 1, 2 and so on, and how many places the range has."""
    r = counts[counts > 0]
    return pack(np.array([r.sum(), len(r), *(np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2]), places], I))


def count_words(words: DataFrame, parts: int) -> DataFrame:
    """ANSWER to each block: counts (and if only it has the word), and places. STATS."""

    def ask(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for block, blob in rows_of(part, "block", "blob"):
                (keys, c), _ = unpack(blob, [U, I])
                for p, a, b in _slices(keys, parts):
                    yield block, ASKED, p, pack(keys[a:b], c[a:b])

        return batches(each(), SCHEMA, 64)

    def merge(key, table):
        asked = _blobs(table, ASKED)
        got = [unpack(x, [U, I])[0] for _, _, x in asked]
        keys, place = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        c = np.bincount(place, np.concatenate([n for _, n in got]), len(keys)).astype(I)
        alone = np.bincount(place, minlength=len(keys)) == 1
        # Frequent words get low numbers, which pack better.
        number = np.empty(len(keys), I)
        number[np.argsort(-c, kind="stable")] = np.arange(len(keys))
        p, at, rows = key[0].as_py(), 0, []
        for (_, block, _), (k, _) in zip(asked, got):
            mine = place[at : at + len(k)]
            at += len(k)
            rows.append((block, ANSWER, p, pack(c[mine] * 2 + alone[mine], number[mine])))
        return _table([*rows, (0, STATS, p, _stats(np.where(keys == U(START), 0, c), len(keys)))])

    return words.select("block", "blob").mapInArrow(ask, ROWS).groupBy("part").applyInArrow(merge, ROWS)


# Blocks and their n-grams -------------------------------------------------------------------------------------


def _spread(code: np.ndarray) -> np.ndarray:
    x = code.view(U) * U(0x9E3779B97F4A7C15)
    x ^= x >> U(31)
    return (x * U(0xBF58476D1CE4E5B9)) >> U(32)


def _answers(table, level: int, shift: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and names of a block's n-grams of a level, in the order asked, and which only this block has.

    A word's name is its place and then its range, an n-gram's its range and then its place (-1: none).
    """
    c, ids = [], []
    for p, _, blob in _blobs(table, ANSWER + 100 * level):
        if level == 1:
            (n, places), _ = unpack(blob, [I, I])
            ids.append(places * parts + p)
        else:
            (n,), named = unpack(blob, [I])
            name = np.full(len(n), -1, I)
            if named:
                name[n % 2 == 0] = _sums(unpack(named, [I])[0][0]) + (p << shift)
            ids.append(name)
        c.append(n)
    c, ids = (np.concatenate(x) if x else np.zeros(0, I) for x in (c, ids))
    return c >> 1, ids, c % 2 == 1


def _homes(name: np.ndarray, level: int, parts: int, shift: int) -> np.ndarray:
    """The range of n-grams with a context of that name: for words by a hash, for n-grams that of the context itself."""
    return (_spread(name) * U(parts) >> U(32)).astype(I) if level == 2 else name >> shift


class Block:
    """A block's tokens, and for each level its n-grams: counts, names, and which one ends at each token (-1: none).

    own: which n-grams only this block has. Those that follow such a context come last and have no name.
    """

    def __init__(self, uri: str, block: int, table, parts: list[int], shifts: list[int]):
        self.table, self.parts, self.shifts = table, parts, shifts
        fs, root = open_fs(uri)
        with fs.open_input_stream(f"{root}/{block}.tokens") as f:
            data = f.read()
        size = int.from_bytes(data[:8], "little")
        (self.doc_id, self.null, self.n, self.out), _ = unpack(data[8 : 8 + size], [I] * 4)
        (self.seq,), body = unpack(data[8 + size :], [I])
        count, name, own = _answers(table, 1, shifts[0], parts[0])
        # Words are numbered in the order of their names.
        order = np.argsort(name)
        rank = np.empty(len(order), I)
        rank[order] = np.arange(len(order))
        self.count, self.name, self.own = count[order], name[order], own[order]
        self.seq, self.start = rank[self.seq], int(rank[int.from_bytes(body, "little")])
        self.place = np.arange(len(self.seq)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.trained = np.repeat(self.out == 0, self.n)
        self.gram, self.words = self.seq, self.name

    def grams(self, level: int) -> dict:
        """The distinct n-grams of the next level: those to ask for in the order of ranges, context and word, then the own.

        at: tokens that have one. of: which. context, word, lower: places among the contexts (n-grams of the level
        before), words, and n-grams of the level before. r: training counts in the block. sent: how many are to ask for.
        """
        parts = self.parts[level - 1]
        at = np.flatnonzero(self.place >= level - 2)
        before = np.where(self.place[at] == 0, self.start, self.seq[at - 1]) if level == 2 else self.gram[at - 1]
        unique, first, of = np.unique(before * len(self.words) + self.seq[at], return_index=True, return_inverse=True)
        context, word = before[first], self.seq[at[first]]
        own = self.own[context]
        total = np.where(own, 0, self.count[context])
        home = _homes(self.name[context], level, parts, self.shifts[level - 2])
        hot = total > HOT_CONTEXT
        part = np.where(own, parts, home)
        part[hot] = (home[hot] + _spread(self.words[word[hot]]).astype(I) % -(-total[hot] // HOT_CONTEXT)) % parts
        order = np.argsort(part * 2 + hot, kind="stable")
        rank = np.empty(len(order), I)
        rank[order] = np.arange(len(order))
        of = rank[of]
        r = np.bincount(of, self.trained[at], len(order)).astype(I)
        return {
            "at": at, "of": of, "context": context[order], "word": word[order], "lower": self.gram[at[first]][order], "part": part[order], "home": home[order], "hot": hot[order],
            "r": r, "sent": len(order) - int(own.sum()),
        }

    def rise(self, level: int, grams: dict) -> None:
        """Takes the answers of a level, whose n-grams are the contexts of the next."""
        count, name, own = _answers(self.table, level, self.shifts[level - 1], self.parts[level - 1])
        rest = grams["r"][grams["sent"] :]
        self.count = np.concatenate([count, rest])
        self.name = np.concatenate([name, np.full(len(rest), -1, I)])
        self.own = np.concatenate([own, np.ones(len(rest), bool)])
        self.gram = np.full(len(self.seq), -1, I)
        self.gram[grams["at"]] = grams["of"]


def _hot_contexts(grams: dict) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that are spread, and their homes, in the order of homes."""
    context, first = np.unique(grams["context"][grams["hot"]], return_index=True)
    home = grams["home"][grams["hot"]][first]
    order = np.argsort(home, kind="stable")
    return context[order], home[order]


def _pieces(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of equal rows of the keys."""
    if len(keys[0]):
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        heads = np.flatnonzero(new)
        yield from zip(heads.tolist(), [*heads[1:].tolist(), len(new)])


def ask_grams(rows: DataFrame, uri: str, level: int, parts: list[int], shifts: list[int], turn: int, turns: int) -> DataFrame:
    """A block's n-grams for their ranges, its hot contexts for their homes, and the STATS of those that it counts itself.

    Of several turns each is for the ranges whose number leaves that remainder.
    """

    def ask(key, table):
        b = key[0].as_py()
        block = Block(uri, b, table, parts, shifts)
        for m in range(2, level):
            block.rise(m, block.grams(m))
        g = block.grams(level)
        n = g["sent"]
        r = g["r"][:n]
        low = np.where(r > 0, block.count[g["lower"][:n]], 0)
        context, word = block.name[g["context"][:n]], block.words[g["word"][:n]]
        found = [] if turn else [(b, STATS, b % parts[level - 1] // turns * turns, _stats(g["r"][n:], 0))]
        for x, y in _pieces(g["part"][:n], g["hot"][:n]):
            if g["part"][x] % turns == turn:
                found.append((b, ASKED_HOT if g["hot"][x] else ASKED, int(g["part"][x]), pack(_deltas(context[x:y]), _run_deltas(word[x:y], context[x:y]), r[x:y], low[x:y])))
        hot, home = _hot_contexts(g)
        for x, y in _pieces(home):
            if home[x] % turns == turn:
                found.append((b, HOT_ASKED, int(home[x]), pack(block.name[hot[x:y]])))
        return _table(found)

    return rows.groupBy("block").applyInArrow(ask, ROWS)


def _asked(blob: bytes) -> tuple[np.ndarray, ...]:
    """Context, word, count and lower count of the n-grams that a block asks for."""
    (context, word, r, low), _ = unpack(blob, [I] * 4)
    context = _sums(context)
    return context, _run_sums(word, context), r, low


def _merged(got: list) -> tuple[np.ndarray, ...]:
    """Distinct (context, word) of the asks, in their order, with summed counts, and if only one asks; the place of each entry."""
    context, word, r, low = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, I) for i in range(4))
    if not len(context):
        return context, word, r, low, context, context
    top = int(word.max()) + 1
    order = np.argsort(context * top + word) if int(context.max()) < (1 << 62) // top else np.lexsort((word, context))
    a, b = context[order], word[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    heads = np.flatnonzero(new)
    place = np.empty(len(order), I)
    place[order] = np.cumsum(new) - 1
    alone = np.diff(np.append(heads, len(order))) == 1
    return a[heads], b[heads], np.add.reduceat(r[order], heads), np.maximum.reduceat(low[order], heads), alone, place


def _context_sums(context: np.ndarray, r: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct contexts and, for each level of count, the sums of their seen n-grams' counts; then of the lower ones'."""
    heads = _heads(context)
    out = []
    for c in (r, np.where(r > 0, low, 0)):
        level = np.minimum(c, K + 1)
        out += [np.add.reduceat(np.where(level == k, c, 0), heads) if len(heads) else np.zeros(0, I) for k in range(1, K + 2)]
    return context[heads], out


def _backs_off(r: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which of the contexts that begin at heads have an n-gram that training hasn't."""
    return np.add.reduceat(r == 0, heads, dtype=I) > 0 if len(heads) else np.zeros(0, bool)


def count_grams(asked: DataFrame, level: int, parts: int, shift: int, named: bool) -> DataFrame:
    """To each block: ANSWER, as for words (named: with places of those that other blocks have too), and CONTEXTS. SUMS of hot ones. STATS.

    CONTEXTS: which contexts have discounted n-grams, and of those with an n-gram of the block that training hasn't the
    sums by level of count: of the n-grams but for the last level, which the context's count gives, and of the lower ones.
    """

    def merge(key, table):
        p, rows, sizes = key[0].as_py(), [(b, kind, p, x) for kind in (HOT_ASKED, STATS) for p, b, x in _blobs(table, kind)], 0
        counts = []
        answers: dict[int, list] = {}
        for kind in (ASKED, ASKED_HOT):
            asked = _blobs(table, kind)
            got = [_asked(x) for _, _, x in asked]
            context, word, r, low, alone, place = _merged(got)
            marked = r * 2 + alone if named else r * 2
            places = _sums((~alone).astype(I)) - 1 + sizes if named else place
            of, sums = _context_sums(context, r, low)
            discounted = (sum(sums[:K]) > 0).astype(I)
            at = 0
            for (_, block, _), (own, *_) in zip(asked, got):
                mine = place[at : at + len(own)]
                at += len(own)
                answers.setdefault(block, []).append((marked[mine], places[mine[~alone[mine]]] if named else mine[:0]))
                if kind == ASKED:
                    heads = _heads(own)
                    k = np.searchsorted(of, own[heads])
                    off = k[_backs_off(r[mine], heads)]
                    rows.append((block, CONTEXTS, p, pack(discounted[k], body=pack(*(x[off] for x in (*sums[:K], *sums[K + 1 :]))))))
            sizes += int((~alone).sum()) if named else 0
            counts.append(r)
            if kind == ASKED_HOT and len(of):
                home = _homes(of, level, parts, shift)
                order = np.argsort(home, kind="stable")
                for x, y in _pieces(home[order]):
                    rows.append((0, SUMS, int(home[order[x]]), pack(of[order[x:y]], *(s[order[x:y]] for s in sums))))
        for block, found in answers.items():
            n, place = (np.concatenate(x) for x in zip(*found))
            rows.append((block, ANSWER, p, pack(n, body=pack(_deltas(place)) if named else b"")))
        rows.append((0, STATS, p, _stats(np.concatenate(counts), sizes)))
        return _table(rows)

    return asked.groupBy("part").applyInArrow(merge, ROWS)


def answer_hot(rows: DataFrame) -> DataFrame:
    """HOT_ANSWER to each block: the sums of its hot contexts, met in their homes."""

    def merge(key, table):
        got = [unpack(x, [I] * (2 * K + 3))[0] for _, _, x in _blobs(table, SUMS)]
        context, place = np.unique(np.concatenate([g[0] for g in got]) if got else np.zeros(0, I), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([g[k] for g in got]), len(context)).astype(I) for k in range(1, 2 * K + 3)] if got else []
        p, out = key[0].as_py(), []
        for _, block, blob in _blobs(table, HOT_ASKED):
            (ids,), _ = unpack(blob, [I])
            k = np.searchsorted(context, ids)
            out.append((block, HOT_ANSWER, p, pack(*(s[k] for s in sums))))
        return _table(out)

    return rows.groupBy("part").applyInArrow(merge, ROWS)


# Evaluation ---------------------------------------------------------------------------------------------------


def _weights(table, level: int, g: dict, count: np.ndarray, r: np.ndarray, below: np.ndarray | float, lower: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Divisor and backoff weight of each n-gram of the level before as a context (1 where it isn't known).

    count, r: counts of the n-grams of the level before and of this one. below: divisors of the contexts of the level
    before; lower: which of those a context has without its first word. The weight is right only where a context backs off.
    """
    n = [np.zeros(len(count), I) for _ in range(2 * K + 2)]
    sent = g["sent"]
    own, sums = _context_sums(g["context"][sent:], r[sent:], count[g["lower"][sent:]])
    for k, x in enumerate(sums):
        n[k][own] = x
    got = [unpack(x, [I] * (2 * K + 2))[0] for _, _, x in _blobs(table, HOT_ANSWER + 100 * level)]
    if got:
        hot = _hot_contexts(g)[0]
        for k, x in enumerate(zip(*got)):
            n[k][hot] = np.concatenate(x)
    got = [unpack(x, [I]) for _, _, x in _blobs(table, CONTEXTS + 100 * level)]
    if got:
        cold = ~g["hot"][:sent]
        context = g["context"][:sent][cold]
        heads = _heads(context)
        where = context[heads]
        n[0][where] = np.concatenate([x for (x,), _ in got])
        off = where[_backs_off(r[:sent][cold], heads)]
        for k, x in enumerate(zip(*(unpack(body, [I] * (2 * K + 1))[0] for _, body in got))):
            n[k + (k >= K)][off] = np.concatenate(x)
        n[K][where] = count[where] - sum(x[where] for x in n[:K])
    d, before = model["d"][level - 1], model["d"][level - 2]
    total = sum(n[: K + 1])
    kept = sum(x * d[k] for k, x in enumerate(n[: K + 1], 1))
    mass = sum(x * before[k] for k, x in enumerate(n[K + 1 :], 1)) / np.maximum(below if np.isscalar(below) else below[lower], 1)
    # Where nothing was discounted one count is added for the words that weren't seen.
    divisor = np.where(total - kept > 0, total, total + 1)
    return divisor, (1 - kept / divisor) / np.maximum(1 - mass, 1e-300)


def evaluate(rows: DataFrame, uri: str, parts: list[int], shifts: list[int], model: dict) -> DataFrame:
    """Scores of each block's documents, token by token: the n-gram's share, else the weight times the P of the level below."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key, table):
        block = Block(uri, key[0].as_py(), table, parts, shifts)
        known = block.count[block.seq]
        p = _word_p(known, model)
        below, lower = float(model["N"]), np.zeros(0, I)
        for level in range(2, len(parts) + 1):
            g, count = block.grams(level), block.count
            block.rise(level, g)
            r = block.count
            divisor, alpha = _weights(table, level, g, count, r, below, lower, model)
            share = model["d"][level - 1][np.minimum(r, K + 1)] * r / divisor[g["context"]]
            p[g["at"]] = np.where(r > 0, share, 0.0)[g["of"]] + np.where(r > 0, 0.0, alpha[g["context"]])[g["of"]] * p[g["at"]]
            below, lower = divisor, g["lower"]
        N, V = model["N"], model["V"]
        base = np.log10((known + 0.1) / (N + 0.1 * (V + 1)))
        heads = np.cumsum(block.n) - block.n
        return pa.Table.from_arrays(
            [pa.array(block.doc_id, mask=block.null.astype(bool)), pa.array(block.out == 1), pa.array(block.n), pa.array(np.add.reduceat((known > 0).astype(I), heads)), pa.array(np.full(len(heads), N, I)), pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(np.log10(p), heads))], schema=schema
        )

    return rows.groupBy("block").applyInArrow(run, OUT)


def _totals(table: DataFrame) -> list[int]:
    """Sums over the STATS rows, and the most places of a range."""
    names = [f"s{i}" for i in range(K + 4)]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches((tuple(unpack(b, [I])[0][0].tolist()) for (b,) in rows_of(part, "blob")), schema)

    rows = table.filter(F.col("kind") == STATS).select("blob").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    found = rows.agg(*(F.sum(n) for n in names[:-1]), F.max(names[-1])).first()
    return [x or 0 for x in found]


def _of_level(table: DataFrame, level: int, *kinds: int) -> DataFrame:
    """Rows of kinds, marked with the level."""
    return table.filter(F.col("kind").isin(*kinds)).select("block", (F.col("kind") + 100 * level).alias("kind"), "part", "blob")


def score(spark: SparkSession, docs: DataFrame, modulus: int = 10, order: int = 3) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod modulus isn't 0 and scores all rows, with n-grams up to the order."""
    scratch = Scratch(spark, "katz")
    uri = f"{scratch.root}/tokens"
    made = scratch.save(blocks(docs, modulus, uri), "blocks", "kind")
    size, tokens = made.agg(F.sum(F.octet_length("blob")), F.sum(F.col("part").cast("long"))).first()
    if not size:
        return spark.createDataFrame([], OUT)
    # Blobs hold about 9 bytes a word.
    parts = [max(1, size // (9 * RANGE_ENTRIES) + 1)] + [max(1, tokens // RANGE_ENTRIES + 1)] * (order - 1)
    words = scratch.save(count_words(made.filter(F.col("kind") == WORDS), parts[0]), "words", "kind")
    n = _totals(words)
    model = {"N": n[0], "V": n[1], "d": [discounts([0, *n[2:-1]])]}
    shifts = [n[-1].bit_length()]
    taken = sum((1 - model["d"][0][r]) * r * k for r, k in enumerate(n[2 : 2 + K], 1))
    model["unseen"] = taken / model["N"] if model["N"] and taken else 1.0 / (model["N"] + 1)
    scratch.free(f"blocks/kind={WORDS}")
    asks = _of_level(words, 1, ANSWER)
    every = asks
    for level in range(2, order + 1):
        grams = None
        for turn in range(TURNS):
            asked = ask_grams(asks, uri, level, parts, shifts, turn, TURNS)
            some = scratch.save(count_grams(asked, level, parts[level - 1], shifts[level - 2], level < order), f"grams{level}-{turn}", "kind")
            scratch.collect_garbage()
            grams = some if grams is None else grams.unionAll(some)
        n = _totals(grams)
        model["d"].append(discounts([0, *n[2:-1]]))
        shifts.append(n[-1].bit_length())
        hot = scratch.save(answer_hot(grams.filter(F.col("kind").isin(SUMS, HOT_ASKED)).select("block", "kind", "part", "blob")), f"hot{level}")
        scratch.free(*(f"grams{level}-{turn}/kind={kind}" for turn in range(TURNS) for kind in (SUMS, HOT_ASKED)))
        asks = asks.unionAll(_of_level(grams, level, ANSWER))
        every = every.unionAll(_of_level(grams, level, ANSWER, CONTEXTS)).unionAll(_of_level(hot, level, HOT_ANSWER))
    return evaluate(every, uri, parts, shifts, model)
