"""DuckDB's SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"'(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)'"


def _low(e: str) -> str:
    return f"translate({e}, '{UPPER}', '{LOWER}')"


def _part(e: str, k: int) -> str:
    return f"regexp_extract({e}, {PARTS}, {k})"


def _node(e: str) -> str:
    return f"CASE WHEN contains({e}, '://') THEN {_low(_part(e, 1))} || '://' || {_low(_part(e, 2))} || {_part(e, 3)} || {_part(e, 4)} END"


def _absolute(base: str, link: str) -> str:
    root = f"{_part(base, 1)} || '://' || {_part(base, 2)}"
    folder = f"regexp_extract(CASE WHEN {_part(base, 3)} = '' THEN '/' ELSE {_part(base, 3)} END, '(?s)^(.*/)', 1)"
    return f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN starts_with({link}, '//') THEN {_part(base, 1)} || ':' || {link} WHEN starts_with({link}, '/') THEN {root} || {link} WHEN starts_with({link}, '?') THEN {root} || {_part(base, 3)} || {link} WHEN starts_with({link}, '#') THEN {base} ELSE {root} || {folder} || {link} END"


def _undotted(url: str) -> str:
    """The url without ``.`` and ``..`` segments in its path."""
    path = _part(url, 3)
    kept = f"list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]), lambda done, s: CASE WHEN s[1] = '.' THEN done WHEN s[1] = '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE done || s END)"
    whole = f"CASE WHEN regexp_matches({path}, '/[.]{{1,2}}(/|$)') THEN array_to_string({kept}, '/') || CASE WHEN regexp_matches({path}, '/[.]{{1,2}}$') THEN '/' ELSE '' END ELSE {path} END"
    return f"{_part(url, 1)} || '://' || {_part(url, 2)} || {whole} || {_part(url, 4)}"


def url_filter(rules: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in rules)
    return f"""
WITH RECURSIVE rules(said, rule, rhost, rpath) AS (VALUES {values}),
tags AS (
  SELECT url, regexp_extract_all(html, '(?is)(<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>)', 1) AS c, regexp_extract_all(html, '(?is)(<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>)', 1) AS m
  FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')),
links AS (
  SELECT url, replace(link, '&amp;', '&') AS link FROM (
    SELECT url, regexp_extract(c, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS link FROM (SELECT url, unnest(c) AS c FROM tags)
    UNION ALL SELECT url, regexp_extract(m, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM (SELECT url, unnest(m) AS m FROM tags)) WHERE link <> ''),
places AS (SELECT url, {_absolute('url', 'link')} AS whole FROM links),
ends AS (SELECT {_node('url')} AS a, {_undotted('whole')} AS far FROM places WHERE contains(whole, '://')),
edges AS (SELECT DISTINCT a, b FROM (SELECT a, {_node('far')} AS b FROM ends) WHERE b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
component AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY n),
keyed AS (SELECT page_id, url, {_node('url')} AS node FROM pages),
nodes AS (SELECT node FROM keyed WHERE node IS NOT NULL UNION SELECT node FROM component),
parts AS (SELECT node, {_part('node', 2)} AS host, {_part('node', 3)} AS path FROM nodes),
judged AS (
  SELECT node, rule, said FROM (
    SELECT p.node, r.rule, r.said, row_number() OVER (PARTITION BY p.node ORDER BY length(r.rule) DESC, r.said, r.rule) AS k
    FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) WHERE k = 1),
blocked AS (SELECT DISTINCT c.component FROM component c JOIN judged j ON j.node = c.node WHERE j.said = 'block')
SELECT k.page_id, coalesce({_low(_part('k.url', 2))}, '') AS host, coalesce({_part('k.url', 3)}, '') AS path, j.rule, coalesce(j.said, CASE WHEN b.component IS NOT NULL THEN 'block' END, 'allow') AS verdict, c.component
FROM keyed k LEFT JOIN judged j ON j.node = k.node LEFT JOIN component c ON c.node = k.node LEFT JOIN blocked b ON b.component = c.component"""


def decontamination(window: int = 10) -> str:
    words = f"regexp_extract_all({_low('coalesce(text, chr(32))')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS varchar) AS item, {words} AS w FROM benchmark),
size AS (SELECT item, w, least(len(w), {window}) AS n FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS gram FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM size)),
lengths AS (SELECT DISTINCT n FROM size),
grams AS (SELECT k, n, s, list_slice(w, s, s + n - 1) AS gram FROM (SELECT k, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d CROSS JOIN lengths WHERE len(w) >= n)),
hits AS (SELECT g.k, g.n, g.s, x.item FROM grams g JOIN wins x ON x.n = g.n AND x.gram = g.gram),
places AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY k),
named AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS bigint) AS n_words, CAST(coalesce(p.n_hit, 0) AS bigint) AS n_hit, CAST(coalesce(n.n_items, 0) AS bigint) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places p ON p.k = d.k LEFT JOIN named n ON n.k = d.k"""
