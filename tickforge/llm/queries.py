"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, capfilters, chat, licenses, mixing, neardup, substrings, topk, toxicity, urls
from .store import table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, similarity=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_copies", "place", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.format_chats(chat.from_rows(rows)))


def op9_capfilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_substrings": op2_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_urls": op4_urls,
    "op5_topk": op5_topk,
    "op6_neardup": op6_neardup,
    "op7_mixing": op7_mixing,
    "op8_chat": op8_chat,
    "op9_capfilters": op9_capfilters,
    "op10_bpe": op10_bpe,
}

_LOW, _HIGH = 0.9 / 1.1, 1.1 / 0.9  # of a template's size: the sizes of sets that can match it
_QUOTED = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, ts in licenses.TEMPLATES.items() for t in ts)

_ESCAPED = r"replace(replace(replace({c}, '\', '\e'), '<', '\l'), '>', '\g')"

ORACLE: dict[str, str] = {
    "op1_licenses": f"""
WITH t0(name, text) AS (VALUES {_QUOTED}),
tw AS (SELECT name, row_number() OVER () AS tid, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t0),
tb AS (SELECT name, tid, b, len(b) AS n, ceil(len(b) * {_LOW!r} - 1e-9)::BIGINT AS need, floor(len(b) * {_HIGH!r} + 1e-9)::BIGINT AS most
  FROM (SELECT name, tid, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM tw)),
lines AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, [regexp_extract_all(translate(x, '{licenses.UPPER}', '{licenses.LOWER}'), '[a-z0-9]+') FOR x IN string_split(coalesce(text, ''), chr(10))] AS ws FROM documents),
units AS (SELECT r, unnest(CASE WHEN len(ws) > 1 THEN list_concat(ws, [flatten(ws)]) ELSE ws END) AS w, generate_subscripts(CASE WHEN len(ws) > 1 THEN list_concat(ws, [flatten(ws)]) ELSE ws END, 1) AS u FROM lines),
sets AS (SELECT r, u, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM units WHERE len(w) > 1),
scored AS (SELECT r, u, name, 2.0::DOUBLE * len(list_intersect(s.b, tb.b)) / (len(s.b) + n) AS dice FROM sets s, tb WHERE n BETWEEN len(s.b) * {_LOW!r} AND len(s.b) * {_HIGH!r}),
judged AS (SELECT r, u, min((-dice, name)) AS best FROM scored WHERE dice >= 0.9 GROUP BY ALL),
left_of AS (SELECT r, list(w ORDER BY u) AS ws FROM (SELECT units.r, units.u, CASE WHEN best IS NULL THEN w ELSE [NULL FOR x IN w] END AS w
  FROM units JOIN lines ON units.r = lines.r AND u <= len(ws) LEFT JOIN judged ON judged.r = units.r AND judged.u = units.u)
  WHERE r NOT IN (SELECT judged.r FROM judged JOIN lines ON judged.r = lines.r WHERE len(ws) > 1 AND u > len(ws)) GROUP BY r),
rest AS (SELECT r, flatten(ws) AS w FROM left_of),
grams AS (SELECT r, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g, unnest(range(1, len(w))) AS i FROM rest WHERE len(w) > 1),
hits AS (SELECT r, tid, i, row_number() OVER (PARTITION BY r, tid ORDER BY i) AS k FROM grams JOIN (SELECT tid, unnest(b) AS g FROM tb) USING (g)),
spans AS (SELECT a.r, a.tid, a.i AS a, e.i AS e FROM hits a JOIN tb ON a.tid = tb.tid JOIN hits e ON e.r = a.r AND e.tid = a.tid AND e.i >= a.i AND e.i < a.i + most WHERE e.k - a.k + 1 >= need),
measured AS (SELECT spans.r, name, tb.tid, a, e, tb.b, n, list_distinct(list_filter([w[i] || ' ' || w[i + 1] FOR i IN range(a, e + 1)], lambda x: x IS NOT NULL)) AS s,
  (len(list_filter([w[i] || ' ' || w[i + 1] FOR i IN range(a, e + 1)], lambda x: x IS NULL)) > 0)::INT AS blank FROM spans JOIN tb ON spans.tid = tb.tid JOIN rest ON rest.r = spans.r),
runs AS (SELECT r, name, tid, a, min((-dice, e)) AS best FROM (SELECT *, 2.0::DOUBLE * len(list_intersect(s, b)) / (len(s) + blank + n) AS dice FROM measured) WHERE dice >= 0.9 GROUP BY ALL),
sorted AS (SELECT r, list({{'n': 1, 'm': best[1], 'a': a, 'e': best[2]}} ORDER BY a, best[1], best[2]) AS l FROM runs GROUP BY r),
counted AS (SELECT r, list_reduce(l, lambda s, x: CASE WHEN x.a > s.e THEN {{'n': s.n + 1, 'm': x.m, 'a': x.a, 'e': x.e}} WHEN x.m < s.m THEN {{'n': s.n, 'm': x.m, 'a': x.a, 'e': x.e}} ELSE s END).n AS n FROM sorted),
found AS (SELECT r, best[1] AS minus, best[2] AS name FROM judged UNION ALL SELECT r, best[1], name FROM runs),
best AS (SELECT r, min((minus, name)) AS best FROM found GROUP BY r),
whole AS (SELECT r, count(*) AS n FROM judged GROUP BY r)
SELECT doc_id, best[2] AS license, coalesce(-best[1], 0.0::DOUBLE) AS dice, (coalesce(whole.n, 0) + coalesce(counted.n, 0))::BIGINT AS n_units
FROM lines LEFT JOIN best USING (r) LEFT JOIN whole USING (r) LEFT JOIN counted USING (r)""",
    "op2_substrings": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM x),
o AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM g) WHERE owner < doc_id),
c AS (SELECT DISTINCT r, i + k AS i FROM o, range(0, 13) t(k)),
l AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (r) LEFT JOIN k USING (r)""",
    "op4_urls": r"""
WITH r(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
ok AS (SELECT hosts.r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fit AS (SELECT ok.r, page_id, host, path, h || p AS rule, verdict FROM ok LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op5_topk": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
t(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.doc_id, l.v FROM t JOIN l ON t.reach = l.u)
SELECT doc_id, n::BIGINT AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept FROM t JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op7_mixing": f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS w FROM n),
r AS (SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM w),
m AS (SELECT source, greatest(1, ceil(rate / {mixing.MEAN_MOST!r}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {mixing.MEAN_MOST!r})) AS mean FROM r),
p AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM m, range(0, {mixing.PLACES + 1}) x(k)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, documents.source, text, parts FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.source),
i AS (SELECT r, source, '7:' || coalesce(doc_id::VARCHAR, 'null') || CASE WHEN parts > 1 THEN ':' || i ELSE '' END AS t FROM (SELECT *, unnest(range(0, parts)) AS i FROM d)),
u AS (SELECT r, source, ('0x' || substr(md5(t), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u FROM i),
c AS (SELECT r, count(*) FILTER (c <= u) AS n_copies FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source GROUP BY r),
e AS (SELECT doc_id, source, text, n_copies, unnest(range(0, n_copies)) AS copy FROM d JOIN c USING (r))
SELECT doc_id, source, copy, n_copies, ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS place, sha256(coalesce(text, '')) AS text_sha256 FROM e""",
    "op8_chat": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, {_ESCAPED.format(c='role')}, {_ESCAPED.format(c='text')})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, {_ESCAPED.format(c='role')}, {_ESCAPED.format(c='text')}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op9_capfilters": """
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_sum([y * y FOR y IN x])) AS n FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
t(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.vec_id, l.v FROM t JOIN l ON t.reach = l.u),
k AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u),
m AS (SELECT vec_id, min(reach) AS component_id FROM t GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)""",
}
