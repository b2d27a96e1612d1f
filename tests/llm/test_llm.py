"""The training-data operators on small tables, against brute force and with odd rows."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernsql.llm import bpe, common, components, decontam, fingerprints, katz, licenses, pipeline, simhash, suffixes, tokens, toxicity, urls
from fernsql.llm.queries import BYTE_BPE, PATTERN, URL_RULES

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, windows int, predicted int, uid string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x", 1, 2, "u") for d, t in rows], SCHEMA)


def made(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("thnderioné") for _ in range(rng.randint(1, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i, t in enumerate(texts):
        if i % 7 == 1:
            t = texts[i - 1]
        if i % 7 == 2:
            t = t + " " + passage + ". " + t[:50]
        if i % 7 == 3:
            t = texts[i - 1].replace("e", "E", 1) + " extra"
        rows.append((i, t))
    return rows


#: Nulls, empties, repeated rows and ids, a very long text, odd characters.
ODD = [(None, None), (None, "a b c"), (5, ""), (5, None), (7, "same row again " * 12), (7, "same row again " * 12), (8, "ab" * 40_000), (9, "Ünïcödé ½ é \u3000 İ\t\r\n\x1c x"), (9, "  "), (-3, "negative id")]


def collected(df):
    return [r.asDict() for r in df.collect()]


# Byte-level BPE


def test_bpe_equals_tiktoken(spark):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Codec.load(BYTE_BPE, PATTERN).ranks, special_tokens={})
    rows = made() + ODD
    got = sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in collected(bpe.encode_digests(table(spark, rows), BYTE_BPE, PATTERN)))
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(d), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_bpe_round_trip(text):
    codec = bpe.Codec.load(BYTE_BPE, PATTERN)
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode()
    assert ids == [i for p in codec.split(text) for i in codec.merge(p.encode())]


def test_bpe_ids_and_text_back(spark):
    back = bpe.decode_ids(bpe.encode_ids(table(spark, ODD), BYTE_BPE, PATTERN), BYTE_BPE, PATTERN)
    assert Counter(r["text"] for r in collected(back)) == Counter(t or "" for _, t in ODD)


# Token shards


def test_shards_read_back(spark, tmp_path):
    rows = made() + ODD
    uri = f"file://{tmp_path}/shards"
    manifest = tokens.write_shards(spark, table(spark, rows), WORDS, 2, uri, shard_rows=16)
    got = collected(tokens.read_shards(spark, manifest, uri))
    plain = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_shard_random_access_and_hash(spark, tmp_path):
    uri = f"file://{tmp_path}/shards"
    tokens.write_shards(spark, table(spark, made()), WORDS, 2, uri, shard_rows=1000)
    text = dict(made())[11]
    (ids,) = tokens.Shard(uri, 0).find(11)
    assert ids.tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids + [2]
    assert tokens.Shard(uri, 0).find(10**9) == []
    (path,) = (tmp_path / "shards").glob("*.zdict")
    path.write_bytes(b"another dictionary")
    with pytest.raises(ValueError):
        tokens.Shard(uri, 0)


def test_shards_of_an_empty_table(spark):
    assert collected(tokens.encode_table(spark, table(spark, []), WORDS)) == []


@given(st.text(alphabet="aAéİΣ .,'\n\t<|>1½\u0301ßﬁǅ한", max_size=60))
@settings(max_examples=200, deadline=None)
def test_memo_changes_no_ids(text):
    assert tokens.Encoder.load(WORDS).encode(text) == tokens.Encoder.load(WORDS, True).encode(text)


# URLs


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    h, p = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url).groups()
    h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
    fits = [(len(r), v, r) for v, r in URL_RULES for rh, rp in [(r[: r.index("/")], r[r.index("/") :])] if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return h, p, max(fits)[1:] if fits else None


def test_url_rules(spark):
    found = ["http://A.Example.ORG/es/x", "https://example.org/en/1?q", "https://example.org/en/2", "http://x.com/de/", "http://x.com", None, "no scheme", "http://", "x://notorg/", "http://a.example.org/en/1#f", "http://a.example.org/en/1#f"]
    pages = spark.createDataFrame([(i, u, "<html></html>", "r") for i, u in enumerate(found)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in collected(urls.filter_urls(spark, pages, spark.createDataFrame(URL_RULES, "verdict string, rule string")))}
    for i, u in enumerate(found):
        h, p, best = brute_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (h, p, best and best[1], best[0] if best else "allow"), u


def test_url_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (0, "http://a.net/1", link.format("http://b.net/2")), (1, "http://b.net/2#top", '<meta http-equiv="refresh" content="0; url=http://x.com/de/bad">'), (2, "http://x.com/fr/ok", link.format("http://a.net/1")),
        (3, "http://c.net/", ""), (4, "http://d.net/p/q", link.format("r")), (5, "http://d.net/p/r", None), (6, None, None),
    ]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://d.net/p/r", "http://x.com/de/z"), (None, "http://x.com/de/z")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in collected(urls.filter_urls(spark, pages, spark.createDataFrame(URL_RULES, "verdict string, rule string"), redirects))}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow"}


def test_url_oracle_follows_links(spark):
    import duckdb

    link = '<LINK href="{}" rel="canonical">'
    rows = [(0, "http://a.net/1", link.format("//B.net/2?x=1&amp;y=2")), (1, "http://b.net/2?x=1&y=2#top", "<meta http-equiv=refresh content='0; url=http://x.com/de/bad'>"), (2, "HTTP://x.com/fr/ok", link.format("http://a.net/1")), (3, "http://c.net/p/q", link.format("r")), (4, "http://c.net/p/r", None), (5, None, "x"), (6, "http://c.net", link.format("/p/r")), (7, "http://org/", link.format("http://org/#self"))]
    rows += [(8, "http://e.net/a/b/c?q", link.format("../../d/./x") + link.format("?z=1")), (9, "http://e.net/d/x", None), (10, "http://e.net/a/b/c?z=1", link.format("#top") + link.format("http://x.com/fr/../de/y/..")), (11, "http://x.com/de/", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id bigint, url varchar, html varchar)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    from fernsql.llm.queries import oracle_sql

    rel = con.sql(oracle_sql()["op3_urls"])
    want = sorted(str(dict(zip(rel.columns, r))) for r in rel.fetchall())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = urls.filter_urls(spark, pages, spark.createDataFrame(URL_RULES, "verdict string, rule string"))
    assert sorted(str({c: r[c] for c in rel.columns}) for r in collected(found)) == want


@pytest.mark.parametrize("hot", [10**6, 2])
def test_url_filter_with_hot_urls(spark, hot, monkeypatch):
    """Repeated urls, a large component and many rows without url get the verdicts of single ones."""
    monkeypatch.setattr(components, "FEW_EDGES", hot - 2)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    link = '<link href="http://x.com/de/bad" rel="canonical">'
    rows = [(i, "http://hub.net/", link) for i in range(30)] + [(100 + i, f"http://n{i}.net/", link) for i in range(30)] + [(200 + i, None, link) for i in range(30)] + [(300, "http://free.net/", "")]
    got = {r["page_id"]: (r["verdict"], r["component"]) for r in collected(urls.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(URL_RULES, "verdict string, rule string")))}
    assert got == {i: ("block", "http://hub.net/") if i < 200 else ("allow", None) for i, *_ in rows}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert collected(urls.filter_urls(spark, empty, spark.createDataFrame(URL_RULES, "verdict string, rule string"))) == []


@pytest.mark.parametrize("few, hot", [(300_000, 10**6), (0, 10**6), (0, 3)])
def test_components_match_brute_force(spark, few, hot, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"))
    assert {r["node"]: r["component"] for r in collected(got)} == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# SimHash


@pytest.mark.parametrize("blocks, rows_each, hot", [(None, None, 10**6), (2, 3, 2), (4, 2, 10**6), (8, 2, 2)])
def test_simhash_components(spark, blocks, rows_each, hot, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, blocks, rows_each))
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = made(n=80) + [(500 + i, "w" + " same words here again and again" * 5 + f" {i % 3}") for i in range(9)] + ODD
    fps = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in collected(simhash.near_duplicates(spark, table(spark, rows)))) == want


def test_simhash_bits():
    import xxhash

    text = "A b c d"
    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d")]
    assert simhash.fingerprint(text) == h[0] & h[1]
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(" \t") == 0 and simhash.fingerprint(None) == 0


# Suffix arrays


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=150, deadline=None)
def test_suffix_order(values):
    s = np.array(values, np.int64)
    assert suffixes.suffix_order(s).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def brute_repeats(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@given(st.lists(st.integers(1, 3), max_size=60), st.integers(3, 1 << 30))
@settings(max_examples=100, deadline=None)
def test_suffix_order_of_large_symbols(values, top):
    s = np.array(values, np.int64) * (top // 3)
    assert suffixes.suffix_order(s, top).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


@pytest.mark.parametrize("hot, group, copies", [(20_000, 64 << 10, 16), (1, 64 << 10, 1), (20_000, 500, 2)])
def test_repeats_match_brute_force(spark, hot, group, copies, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_COPIES", copies)
    monkeypatch.setattr(suffixes.find_repeats, "__defaults__", (100, hot))
    monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffixes, "RUN_WINDOWS", 20)
    monkeypatch.setattr(suffixes, "FLUSH_RUNS", 150)
    monkeypatch.setattr(suffixes, "PART_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SORT_BYTES", 3000)
    rows = made(n=70) + [(900, "ab" * 300), (901, "x" * 450), (902, "abc" * 90 + "é" * 80), (903, None), (904, "")]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(suffixes.digests(spark, table(spark, rows))))
    assert got == brute_repeats(rows, 100)


def test_repeats_with_odd_keys(spark):
    rows = [r for r in ODD if r[0] != 8] + [(8, "ab" * 400)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in collected(suffixes.digests(spark, table(spark, rows))))
    assert got[7, 180, 180] == 1 and sum(n for (d, _, _), n in got.items() if d == 7) == 2
    assert len(collected(suffixes.cut(spark, table(spark, rows)))) == len(rows)
    assert collected(suffixes.digests(spark, table(spark, []))) == []


def fast_repeats(rows, length):
    """As brute_repeats, by a set of hashed windows, for long texts; rows lie in order."""
    seen, out = set(), Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            w = hash(b[i : i + length])
            if w in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(w)
        out[d, len(b), int((np.cumsum(gone)[: len(b)] > 0).sum())] += 1
    return out


def test_repeats_of_long_periodic_texts(spark):
    rows = [(8, "ab" * 40_000), (9, "0" * 300_000), (10, "abcdefg" * 3000 + "tail"), (11, "0" * 1000 + "1" + "0" * 99), (12, "x" + "abcdefg" * 2000), (13, ("p" * 150 + "q") * 800)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in collected(suffixes.digests(spark, table(spark, rows))))
    assert got == fast_repeats(rows, 100)


def test_cut_with_clashing_names(spark):
    text = "some words that come again in another text and are long enough to be cut " * 2
    rows = spark.createDataFrame([(1, text, "u", 1, "k", 5), (None, text, "v", 2, "l", 6), (None, "b", "w", 3, "m", 7)], "doc_id long, text string, uid string, windows int, kept string, uid_part int")
    got = sorted((r["text"], r["uid"], r["windows"], r["kept"]) for r in collected(suffixes.cut(spark, rows)))
    assert [g[1:] for g in got] == [("u", 1, "k"), ("w", 3, "m"), ("v", 2, "l")] and [len(g[0]) for g in got] == [0, 1, len(text)]


def test_cut_keeps_columns_and_characters(spark):
    text = "".join(chr(0x100 + i) for i in range(70)) + "tail"
    rows = [(1, text), (2, "z" + text), (3, None)]
    out = suffixes.cut(spark, table(spark, rows))
    assert out.columns == [c for c, *_ in table(spark, rows).dtypes]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in collected(out)}
    assert got[1] == (text, 74) and got[3] == (None, None)
    assert got[2] == ("z", 1)


# Fingerprints


def test_canonical_fingerprints(spark):
    rows = [(1, "Café  x"), (2, "cafe\u0301 X "), (3, "cafe x"), (4, None), (5, " \u3000"), (5, "Straße"), (6, "STRASSE"), (None, "q")]
    got = {}
    for r in collected(fingerprints.fingerprint(table(spark, rows))):
        got.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert got[1] == got[2] != got[3] and got[4] <= got[5] and got[6] <= got[5] and len(got[5]) == 2


@pytest.mark.parametrize("digest", [fingerprints.wide, lambda c: F.substring(fingerprints.wide(c), 1, 1)])
def test_edited_fingerprints(spark, digest, monkeypatch):
    monkeypatch.setattr(fingerprints.following, "__defaults__", (7,))
    rows = made(n=40) + [(100, None), (101, ""), (102, "x"), (103, "é" * 9), (-4, "low")]
    got = {r["doc_id"]: r for r in collected(fingerprints.edited_fingerprints(spark, table(spark, rows), digest))}
    order = sorted(rows, key=lambda r: -r[0])
    by: dict = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, text in (("fingerprint", t), ("edited_fingerprint", edited)):
            by.setdefault(" ".join(text.casefold().split()), set()).add(got[d][name])
        assert got[d]["near_next"] == float(" ".join(t.casefold().split()) == " ".join(nxt.casefold().split()))
    # One fingerprint a text, one text a fingerprint, also where digests collide.
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


@pytest.mark.parametrize("digest", [fingerprints.wide, lambda c: F.lit("x")])
def test_fingerprints_without_and_with_repeated_ids(spark, digest):
    """Bytes are compared whatever the id: one fingerprint a canonical text, one canonical text a fingerprint."""
    texts = ["one", "ONE ", "two", "three", None, "", "very long " * 30_000, "very long " * 30_000 + "x"]
    rows = [(i, t) for i in (None, 5, 5) for t in texts] + [(9, "two"), (10, "Two")]
    by: dict = {}
    canon = lambda t: " ".join((t or "").casefold().split())
    got = collected(fingerprints.fingerprint(table(spark, rows), digest))
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    names = Counter((r["doc_id"], r["fingerprint"]) for r in got)
    for d, t in rows:
        by.setdefault(canon(t), set())
    assert len({r["fingerprint"] for r in got}) == len(by) and sorted(names.values()) == sorted(Counter((d, canon(t)) for d, t in rows).values())
    edited = collected(fingerprints.edited_fingerprints(spark, table(spark, rows), digest))
    assert len(edited) == len(rows) and len({r["fingerprint"] for r in edited}) == len(by)
    # Of two rows with equal own fingerprints the canonical texts are equal, so their lengths without spaces at the ends are.
    sizes: dict = {}
    for r in edited:
        sizes.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert sorted(map(sorted, sizes.values())) == sorted(sorted({len(t or "") for t in texts + ["Two"] if canon(t) == c}) for c in by)


def test_following_is_circular(spark):
    got = {r["doc_id"]: r["next_text"] for r in collected(fingerprints.following(spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string"), {}, 6))}
    assert got == {i: str(i - 1 if i else 49) for i in range(50)}
    assert collected(fingerprints.edited_fingerprints(spark, table(spark, []))) == []


# Decontamination


def brute_hits(rows, items, window):
    w = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: w.findall((t or "").encode().translate(common.FOLD))
    wins: dict = {}
    for i, t in items:
        ws = words(t)
        for a in range(max(1, len(ws) - window + 1)) if ws else ():
            wins.setdefault(tuple(ws[a : a + window]), set()).add(str(i))
    out = []
    for d, t in rows:
        ws, hit, names = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    names |= wins[tuple(ws[a : a + n])]
        out.append((d, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block, segment", [(200_000, 750_000), (15, 200)])
def test_decontamination(spark, block, segment, monkeypatch):
    monkeypatch.setattr(decontam.build_index, "__defaults__", (segment,))
    rows = made(n=40) + [r for r in ODD if r[0] != 8] + [(700, "the the the the " * 9)]
    items = [(1, rows[2][1]), (2, "Short one"), (2, " ".join(rows[5][1].split()[:12])), (3, None), (4, "the the the the the the the the the the the"), (5, ""), (10, "say: short, ONE!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows.append((701, "a short one; say short one"))
    got = Counter(tuple(r.values()) for r in collected(decontam.digests(decontam.find(spark, table(spark, rows), bench, block_words=block))))
    assert got == brute_hits(rows, items, 10)


def test_decontamination_without_items(spark):
    got = collected(decontam.digests(decontam.find(spark, table(spark, ODD[:4]), spark.createDataFrame([], "item_id long, text string"))))
    assert len(got) == 4 and not any(r["contaminated"] for r in got)
    assert collected(decontam.digests(decontam.find(spark, table(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")))) == []


def test_proximity(spark):
    docs = table(spark, [(1, "alpha filler beta gamma"), (2, "alpha beta gamma"), (3, "gamma far away from the others alpha")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = {r["doc_id"]: r["items"] for r in collected(decontam.find(spark, docs, items, 3, slop=1))}
    assert found == {1: ["1"], 2: ["1"], 3: []}


# Katz


@pytest.mark.parametrize("order, hot", [(1, 400_000), (2, 400_000), (3, 3), (3, 400_000), (4, 10)])
def test_katz_against_brute_force(spark, order, hot, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "RANGE_ENTRIES", 500)
    monkeypatch.setattr(katz, "HOT_CONTEXT", hot)
    passage = "the same few words come again in a passage that many texts share and that is long enough"
    rows = made(n=50) + [(None, None), (None, "a"), (5, ""), (300, "the the the a the")] + [(400 + i, passage + (f" w{i}" if i % 3 else "")) for i in range(12)]
    low = lambda t: (t or "").encode().translate(common.FOLD).split() + [" end"]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows]
    # counts[m]: n-grams of order m; a text's k-th token (from 0) has orders up to k + 2.
    counts = [None, *(Counter() for _ in range(order))]

    def grams(w, k):
        return [tuple([" start", *w][k + 2 - m : k + 2]) for m in range(1, min(order, k + 2) + 1)]

    for (_, t), h in zip(rows, held):
        if not h:
            for k in range(len(low(t))):
                for g in grams(low(t), k):
                    counts[len(g)][g] += 1
    d = [None, *(katz.discounts([0, *(sum(1 for x in c.values() if x == r) for r in range(1, 7))]) for c in counts[1:])]
    n, v = sum(counts[1].values()), len(counts[1])
    unseen = 1 - sum(d[1][min(k, 6)] * k for k in counts[1].values()) / n
    after: dict = {}
    for m in range(2, order + 1):
        for g, r in counts[m].items():
            after.setdefault(g[:-1], []).append((g[-1], r))

    def p(g):
        """P of the last word after the others, by the definition."""
        m = len(g)
        if m == 1:
            return d[1][min(counts[1][g], 6)] * counts[1][g] / n if counts[1][g] else unseen
        seen = after.get(g[:-1])
        if not seen:
            return p(g[1:])
        total, kept = sum(r for _, r in seen), sum(d[m][min(r, 6)] * r for _, r in seen)
        total += total - kept <= 0
        if counts[m][g]:
            return d[m][min(counts[m][g], 6)] * counts[m][g] / total
        return (1 - kept / total) / (1 - sum(p((*g[1:-1], w)) for w, _ in seen)) * p(g[1:])

    vocabulary = [w for (w,) in counts[1]]
    for context in list(after)[:: max(1, len(after) // 8)]:
        assert math.isclose(sum(p((*context, w)) for w in vocabulary) + p((*context, "never seen")), 1)
    want = []
    for (i, t), h in zip(rows, held):
        w = low(t)
        s = sum(math.log10(p(grams(w, k)[-1])) for k in range(len(w)))
        want.append((str(i), h, len(w), sum(counts[1][x,] > 0 for x in w), n, round(sum(math.log10((counts[1][x,] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6), round(s, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in collected(katz.score(spark, table(spark, rows), order=order))]
    assert sorted(got) == sorted(want)


def test_katz_keeps_what_blocks_need(spark, monkeypatch):
    """On disk stay counts, names of shared n-grams, and sums where a block backs off: under a byte for each token and order."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 10_000)
    monkeypatch.setattr(katz, "RANGE_ENTRIES", 50_000)
    save, kept = common.Scratch.save, []

    def saved(self, df, name, *parts):
        out = save(self, df, name, *parts)
        if name.startswith("grams"):
            kept.append(out.agg(F.sum(F.octet_length("blob"))).first()[0])
        return out

    monkeypatch.setattr(common.Scratch, "save", saved)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(3000 ** rng.random())}" for _ in range(200))) for i in range(500)]
    katz.score(spark, table(spark, rows))
    assert 0 < sum(kept) < 2 * 500 * 201


def test_katz_sums_only_where_a_block_backs_off(spark):
    """Two blocks ask for n-grams after 7; only the second has one that training lacks, so it alone gets sums."""

    def ask(block, *ngrams):
        context, word, r, low = (np.array(x) for x in zip(*ngrams))
        return block, katz.ASKED, 0, katz.pack(katz._deltas(context), katz._run_deltas(word, context), r, low)

    rows = [ask(1, (5, 1, 1, 3), (5, 4, 2, 4), (7, 2, 9, 9), (7, 3, 1, 2)), ask(2, (7, 2, 1, 9), (7, 3, 1, 2), (7, 6, 0, 0))]
    got = {(r["block"], r["kind"]): bytes(r["blob"]) for r in collected(katz.count_grams(spark.createDataFrame(rows, katz.ROWS), 3, 1, 20, False))}
    assert [katz.unpack(got[b, katz.ANSWER], [np.int64])[0][0].tolist() for b in (1, 2)] == [[2, 4, 20, 4], [20, 4, 0]]
    (first, none), (second, some) = (katz.unpack(got[b, katz.CONTEXTS], [np.int64]) for b in (1, 2))
    assert first[0].tolist() == [1, 1] and second[0].tolist() == [1]
    assert [len(x) for x in katz.unpack(none, [np.int64] * 11)[0]] == [0] * 11
    # One n-gram after 7 occurs twice and one ten times; the lower ones twice and nine times.
    assert [x.tolist() for x in katz.unpack(some, [np.int64] * 11)[0]] == [[x] for x in (0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 9)]


def test_katz_without_training_rows(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = collected(katz.score(spark, table(spark, [(held, "a b")])))
    assert r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0
    assert collected(katz.score(spark, table(spark, []))) == []


def test_good_turing():
    d = katz.discounts([0, 1000, 300, 130, 70, 45, 30])
    assert (d[1:6] > 0).all() and (d[1:6] < 1).all() and d[6] == 1
    assert (katz.discounts([0, 5, 0, 0, 0, 0, 0])[1:6] < 1).all()


# Toxicity


def test_marginals_are_exact(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 9, 1])
    e, steps = rng.normal(size=15) * 3, rng.normal(size=(2, 2))
    want, at = [], 0
    for n in lengths:
        x = e[at : at + n]
        at += n
        w = {z: math.exp(sum(x[i] * z[i] for i in range(n)) + sum(steps[z[i], z[i + 1]] for i in range(n - 1))) for z in itertools.product((0, 1), repeat=int(n))}
        want += [sum(v for z, v in w.items() if z[i]) / sum(w.values()) for i in range(n)]
    for chunk in (2, 4, 64):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(toxicity.marginals(e, lengths, steps), want)


def test_toxicity_held_out(spark):
    docs, labels = (common.read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(spark, docs, labels)
    held = docs.join(labels, "doc_id").filter(common.crc32_mod(F.col("doc_id"), 5) == 0)
    got = {r["doc_id"]: r for r in collected(toxicity.classify(held.drop("toxic", "quality"), model))}
    truth = {r["doc_id"]: r["toxic"] for r in held.select("doc_id", "toxic").collect()}
    assert all(r["held_out"] for r in got.values())
    assert sum(got[d]["predicted"] == t for d, t in truth.items()) / len(truth) > 0.95
    toxic = [got[d]["predicted"] for d, t in truth.items() if t]
    assert sum(toxic) / len(toxic) > 0.75


def test_toxicity_odd_rows(spark):
    model = toxicity.train(["you scum , idiot scum", "a fine day", "the scum idiot", "good words here"] * 6, [1, 0, 1, 0] * 6)
    rows = ODD + [(50, "what an idiot scum"), (51, "a \x1c idiot")]
    got = collected(toxicity.classify(table(spark, rows), model))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    hit = next(r for r in got if r["doc_id"] == 50)
    assert hit["predicted"] == 1 and hit["spans"][-1] == len("what an idiot scum")
    kept = toxicity.attach(table(spark, rows), model, "toxic")
    assert kept.columns == [*table(spark, rows).columns, "toxic"] and kept.count() == len(rows)
    assert toxicity.train(["a"], [0]).doc is None
    assert [r["score"] for r in collected(toxicity.classify(table(spark, rows[:2]), toxicity.train(["a"], [0])))] == [0.0, 0.0]


# Licences


@pytest.fixture(scope="module")
def classifier():
    return licenses.train(["The quick brown fox went home.", "Some prose about public rooms and work.", "version two of the film"] * 20)


def test_licence_families(classifier):
    text = "Hello there.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nCopyright law is hard.\nThis work is licensed under the GNU General Public License, version 3."
    assert [(a, b, f) for a, b, f, _, _ in classifier.scan(text)] == [(1, 2, "MIT"), (2, 3, "Apache-2.0"), (4, 5, "GPL")]
    for name, templates in licenses.TEMPLATES.items():
        assert sum(name in {s[2] for s in classifier.scan(t)} for t in templates) >= len(templates) * 0.6, name


def test_licence_unknown(classifier):
    for text in licenses.NEAR_MISSES + ["", "\n\n", "license", "a b c d"]:
        assert classifier.scan(text) == []
    p = classifier.probabilities([[], [b"fox"]])
    assert np.allclose(p.sum(1), 1) and p[1, -1] > 0.5


def test_licence_scan(spark, classifier):
    rows = ODD + [(60, "x\nReleased under the MIT License.\n"), (61, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in collected(licenses.scan(table(spark, rows), classifier))}
    assert got[60]["families"] == "MIT" and got[61]["top_family"] == "CC-BY-NC" and got[8]["families"] == "" and got[None]["top_family"] == "unknown"


def test_licence_calibration():
    rng = np.random.default_rng(3)
    scores = np.log(rng.dirichlet(np.ones(4), 3000))
    p = np.exp(scores / 2.0)
    truth = np.array([rng.choice(4, p=x / x.sum()) for x in p])
    assert 1.7 < licenses.calibrated(scores, truth) < 2.4
    with pytest.raises(ValueError):
        licenses.calibrated(scores, scores.argmax(1))


#: The licence lines of the test tables.
LICENCE_LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_licence_recall_and_precision(spark, sf):
    """Of all lines of the whole table: those found in their family, and those found that are licence lines."""
    docs = common.read(spark, f"/root/testdata/{sf}", "documents")
    model = licenses.fit(spark, docs)
    assert licenses.COLDEST * 1.01 < model.temperature < licenses.HOTTEST / 1.01
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = {(d, k, LICENCE_LINES[x.strip()]) for d, t in texts.items() for k, x in enumerate((t or "").split("\n")) if x.strip() in LICENCE_LINES}
    got = set()
    for r in collected(licenses.scan(docs, model)):
        for span in filter(None, r["spans"].split(",")):
            at, family, *_ = span.split(":")
            a, b = map(int, at.split("-"))
            got |= {(r["doc_id"], k, family) for k in range(a, b)}
    assert len(want) > 20 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_licence_sample_ignores_order_and_hot_ids(spark, classifier):
    rows = [(i, f"line {i} of prose\nand more") for i in range(40)] + [(None, "x")] * 5 + [(3, "hot row")] * 30
    models = [licenses.fit(spark, table(spark, r).repartition(n), most_docs=20) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].temperature == models[1].temperature
    assert licenses.fit(spark, table(spark, [])).scan("Released under the MIT License.")
    assert collected(licenses.scan(table(spark, []), classifier)) == []
    (r,) = collected(licenses.scan(table(spark, [(1, "Released under the MIT License.\n" * 20_000 + "end")]), classifier))
    assert r["n_licence"] == 20_000 and r["spans"].startswith("0-20000:MIT")


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.extend(zip(texts, labels)))
    docs = table(spark, [(1, f"text {i}") for i in range(500)] + [(2, "a"), (3, None), (None, "b")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    toxicity.fit(spark, docs, labels, modulus=1 << 30)
    assert Counter(y for _, y in taken) == {1: 1, 0: 2}


# The pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.read(spark, sf, "documents")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    model = toxicity.fit(spark, docs, common.read(spark, sf, "labels"))
    scores, _ = toxicity.score(model, [t for _, t in rows])
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    roots = brute_groups([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    seen, kept = set(), []
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(b[i : i + 100])
        parts = [bytes(x for x, _ in g) for k, g in itertools.groupby(zip(b, gone), key=lambda x: x[1]) if not k]
        kept.append((d, "".join(p.decode("utf-8", "ignore") for p in parts)))
    items = [tuple(r) for r in common.read(spark, sf, "benchmark").select("item_id", "text").collect()]
    clean = {k[0] for k in brute_hits(kept, items, 10) if not k[-1]}
    codec = bpe.Codec.load(BYTE_BPE, PATTERN)
    want = {d: hashlib.sha256(codec.encode_bytes(t)).hexdigest() for d, t in kept if d in clean}
    got = pipeline.run(spark, sf)
    assert {r["doc_id"]: r["ids_sha256"] for r in collected(got)} == want
    assert 100 < len(want) < docs.count()


@pytest.mark.parametrize("rows", [[], ODD + made(n=20)])
def test_stages_keep_columns(spark, rows):
    docs = table(spark, rows)
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.Scratch(spark, "stage").save(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == table(spark, rows).columns
    docs = pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert docs.count() <= len(rows)


def test_stages_row_by_row(spark):
    """Which rows stay, on nulls, repeated ids and rows: each stage against brute force on what the one before left."""
    sf = "/root/testdata/sf0.001"
    item = next(r["text"] for r in common.read(spark, sf, "benchmark").collect() if len(r["text"].split()) > 12)
    long = " ".join(f"word{i}" for i in range(90))
    rows = ODD + made(n=14) + [(None, item), (5, "x " + item), (21, long), (21, long + " end"), (None, long), (21, "another text under one id"), (None, "unlike all others, without id")]
    steps = dict(pipeline.STAGES)
    as_rows = lambda df: [(r["doc_id"], r["text"]) for r in collected(df)]
    model = toxicity.fit(spark, table(spark, rows), common.read(spark, sf, "labels"))
    scores, _ = toxicity.score(model, [t or "" for _, t in rows])
    clean = [r for r, s in zip(rows, scores) if s < 0.5]
    got = as_rows(steps["toxicity"](spark, table(spark, rows), sf))
    assert Counter(got) == Counter(clean)
    roots = brute_groups([t for _, t in clean])
    groups: dict = {}
    for root, (d, t) in zip(roots, clean):
        groups.setdefault(root, []).append((d is None, d or 0, t))
    one = as_rows(steps["simhash"](spark, table(spark, clean), sf))
    # One row of each group, with the least id of the group.
    assert len(one) == len(groups)
    left = [sorted(g, key=lambda r: r[:2]) for g in groups.values()]
    for d, t in one:
        mine = next(g for g in left if (d is None, d or 0) == g[0][:2] and t in [x for *r, x in g if tuple(r) == g[0][:2]])
        left.remove(mine)
    cut = as_rows(steps["suffixes"](spark, table(spark, one), sf))
    # Within an id the order is that of a text's hash, so what stays of all texts is compared, not where.
    assert Counter(d for d, _ in cut) == Counter(d for d, _ in one)
    order = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(one)], "i int, text string").select("i", F.xxhash64("text")).collect()
    by = {r[0]: r[1] for r in order}
    ranked = sorted(range(len(one)), key=lambda i: (one[i][0] is not None, one[i][0] or 0, by[i], one[i][1] is not None, one[i][1] or ""))
    whole = sum((n - m) * k for (_, n, m), k in fast_repeats([one[i] for i in ranked], 100).items())
    # A character that is cut in two goes whole.
    assert 0 <= whole - sum(len((t or "").encode()) for _, t in cut) <= 4 * len(one)
    items = [tuple(r) for r in common.read(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = Counter(r for r in cut if not list(brute_hits([r], items, 10))[0][-1])
    kept = as_rows(steps["decontamination"](spark, table(spark, cut), sf))
    assert Counter(kept) == want and (None, item) not in kept
    ids = collected(steps["byte_bpe"](spark, table(spark, kept), sf))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in ids) == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in kept)


def five_word_sets(texts):
    for t in texts:
        w = (t or "").encode().translate(common.FOLD).split()
        yield {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """The least place of each text's group: five-word Jaccard of 0.8 or more, texts without words alike."""
    sets = list(five_word_sets(texts))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("piece, rows_each", [(1_000_000, 4096), (400, 5)])
def test_near_copies_against_brute_force(spark, piece, rows_each, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "PIECES", (rows_each, rows_each))
    rng = random.Random(8)
    rows = made(n=30)
    for base in range(8):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
        for k in range(6):
            own = list(words)
            for _ in range(k):
                own[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
            rows.append((1000 + base * 10 + k, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  TWO")]
    roots = brute_groups([t for _, t in rows])
    fps = [simhash.fingerprint(t) for _, t in rows]
    assert any(roots[j] == i and (fps[i] ^ fps[j]).bit_count() > 3 for i, j in itertools.combinations(range(len(rows)), 2))
    got = collected(pipeline.one_of_each_group(spark, table(spark, rows), ""))
    assert sorted(r["doc_id"] for r in got) == [rows[i][0] for i in range(len(rows)) if roots[i] == i]


def test_near_copies_of_the_test_data(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    roots = brute_groups([t for _, t in rows])
    got = collected(pipeline.one_of_each_group(spark, docs, ""))
    assert sorted(r["doc_id"] for r in got) == [rows[i][0] for i in range(len(rows)) if roots[i] == i]


def test_near_copies_under_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (5, a + " more"), (5, b), (6, b + " more")]
    got = collected(pipeline.one_of_each_group(spark, table(spark, rows), ""))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(3, a), (5, b)])


def test_stages_judge_rows_without_id(spark):
    sf = "/root/testdata/sf0.001"
    item = next(r["text"] for r in common.read(spark, sf, "benchmark").collect() if len(r["text"].split()) > 12)
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a + " more"), (4, b), (None, b), (None, "alone"), (None, "so it says: " + item), (None, item + " at the end of some other text")]
    one = collected(pipeline.one_of_each_group(spark, table(spark, rows[:5]), sf))
    assert Counter((r["doc_id"], r["text"][:2]) for r in one) == Counter([(None, "a0"), (4, "b0"), (None, "al")])
    clean = collected(pipeline.without_benchmark(spark, table(spark, rows), sf))
    assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter(rows[:5])


def test_proximity_anchor_near_the_start(spark):
    docs = table(spark, [(1, "nothing here"), (2, "beta alpha gamma"), (3, "alpha gamma alpha gamma")]).coalesce(1)
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = {r["doc_id"]: (r["items"], r["hits"]) for r in collected(decontam.find(spark, docs, items, 3, slop=2))}
    assert found == {1: ([], []), 2: (["1"], [0, 3]), 3: ([], [])}
