from __future__ import annotations

import hashlib
import re
import textwrap

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tickforge.llm import bpe, capfilters, chat, licenses, mixing, neardup, queries, store, substrings, topk, toxicity, urls
from tickforge.llm.components import components
from tickforge.llm.fmindex import FMIndex

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
PASSAGE = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    (1, "a b c"), (2, None), (3, ""), (4, PASSAGE + " own"), (5, "start " + PASSAGE), (6, PASSAGE + " own"), (6, PASSAGE + " own"), (None, PASSAGE), (7, "x " * 30000), (8, "x " * 30000 + "y"),
    (9, "one"), (10, "one"), (11, " \n\t"), (12, PASSAGE.upper()), (13, " ".join(f"w{i}" for i in range(38)) + " z z2 own"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "bucket": F.lit(1), "label": F.lit("x"), "score": F.lit("clash"), "copy": F.lit(9)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("1 = 0")


@pytest.mark.parametrize("name", [n for n in sorted(queries.ORACLE)])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    show = lambda names, values: sorted(tuple(f"{r[names.index(c)]:.9g}" if isinstance(r[names.index(c)], float) else str(r[names.index(c)]) for c in sorted(names)) for r in values)
    mine, theirs = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert show(mine.columns, [tuple(r) for r in mine.collect()]) == show(names, theirs.fetchall())


def of_sql(name, **tables):
    con = duckdb.connect()
    for k, (columns, values) in tables.items():
        con.execute(f"CREATE TABLE {k} ({columns})")
        con.executemany(f"INSERT INTO {k} VALUES ({', '.join('?' * (columns.count(',') + 1))})", values)
    return con.execute(queries.ORACLE[name]).fetchall()


def test_mixing_sql_of_a_small_source(spark, tmp_path):
    rows = [(i, "few" if i < 3 else None if i < 5 else "rest", f"t{i}") for i in range(6000)] + [(7, "rest", "t7")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_mixing(spark, str(tmp_path)).select("doc_id", "source", "copy", "n_copies", "place", "text_sha256").collect()
    assert max(r.n_copies for r in got) > 40
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, of_sql("op7_mixing", documents=("doc_id BIGINT, source VARCHAR, text VARCHAR", rows))))


def test_licenses_sql_of_runs(spark):
    fill = " ".join(f"w{i}" for i in range(30))
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    wrapped = [f"{fill}\n" + "\n".join(textwrap.wrap(t, 25)) + f"\n{fill}" for t in notices]
    r = np.random.default_rng(3)
    mixed = ["\n".join(f"{fill[: int(r.integers(0, 90))]} {notices[int(r.integers(len(notices)))]} {' '.join(textwrap.wrap(notices[int(r.integers(len(notices)))], 30)[1:])}" for _ in range(4)) for _ in range(20)]
    texts = [*notices, *wrapped, *mixed, (notices[0] + " ") * 30, "\n".join([notices[-1]] * 3), " ".join(notices), "\n".join(notices), "the of and " * 500, None, "", fill]
    rows = list(enumerate(texts)) + [(0, notices[0])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license", "dice", "n_units").collect()
    show = lambda values: sorted((i, str(n), round(d, 9), k) for i, n, d, k in values)
    assert show(tuple(x) for x in got) == show(of_sql("op1_licenses", documents=("doc_id BIGINT, text VARCHAR", rows)))


def test_substrings_brute_force(spark, docs, empty):
    known, want = {}, []
    rows = [(i, (t or "").split()) for i, t in TEXTS]
    for i, w in rows:
        for k in range(len(w) - 12):
            if i is not None:
                known[tuple(w[k : k + 13])] = min(i, known.get(tuple(w[k : k + 13]), i))
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and known[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substrings.dedup(docs)
    assert set(docs.columns) < set(got.columns)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == sorted(want)
    assert substrings.dedup(empty).count() == 0


def test_matching_statistics():
    r = np.random.default_rng(5)
    seqs = [r.integers(1, 5, int(r.integers(0, 30))) for _ in range(10)]
    index = FMIndex(np.concatenate([np.append(s, 0) for s in seqs]), 5)
    ask = r.integers(1, 5, 60)
    length, _ = index.matching_statistics(ask, np.array([0, 60]), 13)
    for i in range(60):
        n = 0
        while n < min(13, 60 - i) and any(tuple(ask[i : i + n + 1]) == tuple(s[j : j + n + 1]) for s in seqs for j in range(len(s) - n)):
            n += 1
        assert length[i] == n


def test_near_duplicates_brute_force(spark, docs, empty):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))

    base = [f"v{i}" for i in range(60)]
    more = [(100 + k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(40)] + [(200 + k, " ".join(base[k : k + 45])) for k in range(15)]
    texts = TEXTS + more
    sets = [shingles(t) for _, t in texts]
    ids = [i for i, _ in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i if i is not None else 1 << 60, least.get(find(k), 1 << 60))
    want = sorted((str(i), len(sets[k]), str(None if i is None else least[find(k)])) for k, i in enumerate(ids))
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("size,similarity", [(5, 0.8), (3, 0.5), (1, 0.95)])
def test_near_duplicates_of_other_sizes(spark, size, similarity):
    r = np.random.default_rng(4)
    words = [f"v{i}" for i in range(200)]
    texts = [" ".join(f"n{k}" if k in gone else w for k, w in enumerate(words)) for gone in [set(range(9, 9 + 24 * m, 24)) for m in range(9)] + [set(r.choice(200, 40).tolist()) for _ in range(8)]]
    texts += ["one two three", "One two three", "one two", "one", "one two three four five", "one two three four", "", None]
    sets = [neardup.shingles(t, size) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        want = [min([want[i]] + [want[j] for j in range(len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]) for i in range(len(texts))]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, similarity).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_stage_keeps_what_differs_in_five_words(spark):
    words = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(f"n{k}" if k % 25 == 9 else w for k, w in enumerate(words))), (3, " ".join([*words, "end"]))]  # 0.85 of two words, 0.66 of five
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(x.doc_id for x in kept.collect()) == [1, 2]


def test_stage_keeps_rows_without_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(str(tuple(x)) for x in kept.collect()) == sorted(str(x) for x in rows[:5])


def test_tables_can_be_cleared(spark):
    made = store.materialize(spark.range(5), "five")
    assert made.count() == 5
    store.clear(spark)
    with pytest.raises(Exception, match="NOT_EXIST|not exist"):
        made.collect()


def test_banding():
    assert neardup.banding(0.8) == (40, 6)
    assert all((1 - s**rows) ** bands <= neardup.MISSED for s in (0.05, 0.3, 0.5, 0.9, 1.0) for bands, rows in [neardup.banding(s)])


def test_densified_fills_every_bin():
    least = np.full((2, neardup.BINS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    least[0, 3] = 7
    out = neardup.densified(least)
    assert (out[0] == 7).all() and (out[1] == least[1]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 45: 40, 50: 40}


def test_bpe_is_tiktoken(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    texts = ["", "a" * 5000, "the cat's  sat\n\n on\x1c it ", "naïve 日本語 😀", "ab" * 777, "0123456789" * 99, "<|endoftext|>"]
    df = docs.unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    codec = bpe.Tokenizer(path, public_tokenizers.PATTERN)
    for rows in (codec.decode(codec.encode(df)), codec.round_trip(df)):
        assert rows.count() == df.count()
        for r in rows.collect():
            assert list(r.ids) == known.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in codec.digests(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, known.encode_ordinary(r.text or ""))).encode()).hexdigest()
    assert codec.encode(empty).count() == codec.round_trip(empty).count() == 0


def test_chat_folds(spark):
    events = [(1, 1, 1, "delta", "user", "he"), (1, 2, 1, "delta", "user", "llo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 2, "regenerate", "assistant", None), (1, 5, 2, "delta", "assistant", r"g\o<od>"), (1, 6, 1, "edit", "user", "bye"), (None, 1, None, None, None, None)]
    got = chat.format_chats(spark.createDataFrame(events, "conv_id long, seq long, msg long, kind string, role string, text string")).orderBy("conv_id", "turn_no").collect()
    assert [list(chat.parse(r.formatted)) for r in got] == [[("", "")], [("user", "bye")], [("assistant", r"g\o<od>")]]
    whole = "".join(r.formatted for r in got[1:])
    assert chat.unescape(whole[got[2].loss_from : got[2].loss_to]) == r"g\o<od>"


def test_chat_events_of_messages(spark):
    text = "a <b> " * 20000
    events = [
        (1, 1, 1, "message", "user", "hello"), (1, 2, 1, "edit", "user", "bye"), (1, 3, 2, "message", "assistant", "bad"), (1, 4, 2, "regenerate", "assistant", None), (1, 5, 2, "delta", "assistant", "go"), (1, 6, 2, "delta", "assistant", "od"),
        (1, 7, 1, "edit", "user", "see you"), (2, 1, 5, "message", "user", "x"), (2, 1, 5, "message", "user", "x"), (2, None, None, None, "system", "s"), (2, 3, 6, "edit", None, text), (2, 4, 7, "delta", "user", "b"), (2, 4, 8, "delta", "user", "a"),
        (3, 1, 1, "delta", "assistant", "1"), (3, 1, 1, "message", "assistant", "0"), (3, 1, 1, "regenerate", "assistant", "x"), (3, 1, 1, "edit", "assistant", "e"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, msg long, kind string, role string, text string").withColumns({"turn_no": F.lit("x"), "formatted": F.lit("x")})
    got: dict = {}
    for r in chat.format_chats(df).orderBy("conv_id", "turn_no").collect():
        got.setdefault(r.conv_id, []).extend(chat.parse(r.formatted))
    assert got == {1: [("user", "see you"), ("assistant", "good")], 2: [("system", "s"), ("user", "x"), ("user", "x"), ("", text), ("user", "a"), ("user", "b")], 3: [("assistant", "e1")]}
    assert chat.format_chats(df.limit(0)).count() == 0 and chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_logs_of_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "y" * 1000), (1, 1, "assistant", "y" * 1000), (1, 1, "assistant", "<" * 300), (1, 1, None, None), (None, None, "user", ""), (2, 5, "assistant", None), (2, 5, "assistant", "z" * 256)]
    log = chat.from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == set(chat.KINDS)
    got = [(r.conv_id, r.seq, chat.unescape(r.role), chat.unescape(r.text)) for r in chat.fold(log).collect()]
    assert sorted(got, key=str) == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)


def test_urls(spark):
    rows = [(1, "http://A.example.COM/en/7x?q"), (2, None), (3, "no scheme"), (4, "x://com"), (5, "https://example.net/de/89"), (6, "h://net/de/"), (6, "h://net/de/"), (7, "h://notcom/en/"), (8, "h://example.com/en/8#f")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.net/de/8", "block"), 6: ("net/de/", "allow"), 7: (None, "allow"), 8: ("com/en/", "block")}


def test_cascade_is_exact(spark):
    names = [f"k{i}" for i in range(30000)]
    universe = spark.createDataFrame([(n,) for n in names], "key string")
    for n in (500, 3, 0):
        cascade = urls.build(names[:n], universe, len(names))
        assert list(cascade.member(urls._hashes(pa.array(names)))) == [True] * n + [False] * (len(names) - n)
    cascade = urls.build(names[:500], universe, len(names))
    print(len(cascade.levels), "levels of", [f.m for f in cascade.levels], "bits")
    assert len(cascade.levels) > 2 and sum(f.m for f in cascade.levels) < 500 * 16


def test_urls_of_other_tables(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0
    rows = [(1, "h://" + "a." * 20000 + "com/en/" + "x" * 50000, "r", "v"), (2, "h://com", "r", "v"), (2, "h://com", "r", "v"), (3, "h:///en/", "r", "v"), (4, "h://" + "com" * 9000, None, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, keys string"), queries.RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, str(r.rule), r.verdict) for r in got.collect()) == [(1, "com/en/", "block"), (2, "None", "allow"), (2, "None", "allow"), (3, "None", "allow"), (4, "None", "allow")]


def test_urls_by_brute_force_of_many_rules(spark):
    r = np.random.default_rng(8)
    hosts = [".".join(r.choice(["a", "b", "c", "d"], int(r.integers(1, 5)))) for _ in range(400)]
    paths = ["/" + "/".join(r.choice(["p", "q"], int(r.integers(0, 5)))) for _ in range(400)]
    rules = {(hosts[i], paths[i]): ("allow", "block")[i % 2] for i in range(120)}
    pages = [(i, f"x://{h}{p}") for i, (h, p) in enumerate(zip(hosts[::-1], paths, strict=True))]
    want = {}
    for i, u in pages:
        host, path = u[4:].split("/", 1)[0], u[4 + len(u[4:].split("/", 1)[0]) :]
        fit = [(len(h + p), len(h), h + p, a) for (h, p), a in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = max(fit)[2:] if fit else (None, "allow")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), [(h, p, a) for (h, p), a in rules.items()]).collect()
    assert {x.page_id: (x.rule, x.verdict) for x in got} == want


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1.0, 0.0]), (6, [None, 1.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 5, 65536), (50, 1, 0, 32768), (50, 2, 1, 32768)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [70000.0, 1.0]), (1, [70000.0, 2.0]), (2, [1.0, 0.0]), (50, [1e15, -3.0]), (3, [-2e15, 5.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0]), (6, [1e308, 0.0]), (7, [1.5, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit("x"), "ids": F.lit(1)})
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows if i != 6}  # which overflows by the scale
    for k in (2, 9):
        got = {}
        for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q in (0, 50):
            best = sorted(((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), topk.NONE + 1), -topk.NONE - 1), i) for i, v in whole.items() if i != q))[:k]
            assert got[q] == [(i, -s) for s, i in best]


def test_cap_filters_of_other_tables(spark):
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.9), (3, [1.0, 0.0], 1.2), (3, [1.0, 0.0], 1.2), (4, [1.0, 0.01], 1.9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double").withColumns({"cap": F.lit("x"), "node": F.lit("x"), "n_links": F.lit("x"), "v": F.lit("x")})
    got = sorted(tuple(r) for r in capfilters.near_vectors(df).collect())
    assert got == [(1, 2, 1, True), (2, 1, 2, True), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 2, False)]
    text = capfilters.near_vectors(df.withColumn("label", F.concat(F.lit("l"), F.col("label"))))
    assert sorted(tuple(r) for r in text.collect()) == got and capfilters.near_vectors(df.limit(0)).count() == 0


def test_top_k_prunes():
    r = np.random.default_rng(2)
    blocks = [(np.arange(i * 50, i * 50 + 50), (r.integers(-20, 20, (50, 16)) + 40 * (i % 4)).astype(np.int32)) for i in range(20)]
    ask = r.integers(1, 9, (7, 16)).astype(np.int32)
    ids, scores, scored = topk.search(ask, np.full(7, -1), blocks, 5)
    names, rows = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
    for q in range(7):
        s = rows @ ask[q]
        want = sorted(zip(-s, names))[:5]
        assert [(-int(a), int(b)) for a, b in zip(scores[q], ids[q])] == [(int(a), int(b)) for a, b in want]
    assert scored < 7 * 20


def test_cap_filters_edge_cases(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [0.0, 0.0, 0.0], 1), (5, None, 1), (6, [1.0, 0.0, 0.0], None), (7, [1.0, None, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [0.0, 1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 9)}
    assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False)}


def test_licenses(spark, docs, empty):
    rows = [(1, "abc\nLicensed under the Apache License, Version 2.0.\nx"), (2, licenses.TEMPLATES["MIT"][1].replace(", ", ",\n")), (3, "licensed to nobody"), (4, None), (5, "")]
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("Apache-2.0", 1) and got[2][0] == "MIT" and got[3] == got[4] == got[5] == (None, 0)
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(empty).count() == 0


def test_licenses_of_repeated_notices(spark):
    rows = [(1, "x\n" + "Licensed under the Apache License, Version 2.0. " * 30), (2, "x\n" + (licenses.TEMPLATES["MIT"][1] + " ") * 3)]
    got = {r.doc_id: (r.license, r.dice > 0.9) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Apache-2.0", True), 2: ("MIT", True)}


def test_licenses_within_and_across_lines(spark):
    fill, mit = " ".join(f"w{i}" for i in range(60)), licenses.TEMPLATES["MIT"][1]
    wrap = lambda t, n: "\n".join(textwrap.wrap(t, n))
    head, tail = mit.split(" The above copyright")
    canonical = f"MIT License\n\nCopyright (c) 2020 A\n\n{head}\n\nThe above copyright{tail}\n\n{fill}"
    rows = [
        (1, f"{fill}\n{wrap(mit, 40)}\n{fill}"), (2, canonical), (3, "\n\n".join(wrap(x, 78) for x in canonical.split("\n\n"))), (4, f"{fill}\n{wrap(licenses.TEMPLATES['ISC'][0], 30)}\n{fill}"),
        (5, f"{fill} {licenses.TEMPLATES['GPL-3.0'][0]} {fill}"), (6, f"{fill}\n{wrap(licenses.TEMPLATES['GPL-3.0'][0], 20)}\n{fill}\nLicensed under CC BY 4.0.\n{wrap(licenses.TEMPLATES['MPL-2.0'][0], 30)}"),
        (7, f"{fill} {mit} {mit} {mit} {fill}"), (8, f"{fill} {head[:200]} {fill}"), (9, f"{fill} licensed under the big apache of license and version"),
    ]
    got = {r.doc_id: (r.license, round(r.dice, 3), r.n_units) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["MIT", "MIT", "MIT", "ISC", "GPL-3.0", "CC-BY-4.0", "MIT", None, None]
    assert all(got[i][1:] == (1.0, 1) for i in (1, 2, 3, 4, 5)) and got[6][2] == 3 and got[7][1:] == (1.0, 3)


def test_mixing_means(spark, docs, empty):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 < 3, "b").alias("source"), F.lit("t").alias("text"))
    got = {r.source: r["count"] for r in mixing.mix(df, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(got["a"] - 15000) < 500 and abs(got["b"] - 5000) < 300 and None not in got
    assert mixing.mix(docs, alpha=1.0).count() > 0 and mixing.mix(empty).count() == 0


def test_mixing_gives_small_sources_their_weight(spark):
    df = spark.range(40000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "few").otherwise("rest").alias("source"))
    got = mixing.mix(df, {"few": 1.0, "rest": 1.0}).filter("source = 'few'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("told"), F.countDistinct("copy").alias("copies"), F.max("copy").alias("last")).collect()
    assert len(got) == 40 and all(r.n == r.told == r.copies == r.last + 1 for r in got)
    n = np.array([r.n for r in got])  # of mean 500, so that the sum has mean 20,000 and a deviation of 141
    assert abs(n.sum() - 20000) < 700 and 12 < n.std() < 36
    hot = mixing.mix(df.filter("doc_id in (1, 50)"), {"few": 1e6, "rest": 1.0}, size=70000.0).filter("source = 'few'").agg(F.count("*"), F.countDistinct("copy")).first()
    assert abs(hot[0] - 140000) < 2500 and hot[0] == hot[1]


def test_toxicity_learns(spark, docs, empty):
    r = np.random.default_rng(1)
    names = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(300)]  # words of prose repeat; a mark's ending is new each time
    word = lambda: str(r.choice(names))
    rows = [(i, " ".join([word() for _ in range(int(r.integers(5, 120)))] + (["zorq" + word()] if i % 2 else [])), i % 2) for i in range(400)]
    texts, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    got = toxicity.score(texts, labels).filter("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9
    none = toxicity.score(docs, labels.filter("toxic = 0")).collect()
    assert len(none) == len(TEXTS) and all(r.score == 0.0 for r in none)
    assert toxicity.score(empty, labels.limit(0)).count() == 0


def naive_logit(w, words):
    """The network's logit of one window, place by place, in doubles; words are (bucket, n-gram buckets)."""
    sigmoid, h = (lambda v: 1 / (1 + np.exp(-v))), toxicity._H
    x = [np.concatenate([w["word"][b], np.mean([w["gram"][g] for g in grams], axis=0) if len(grams) else np.zeros(toxicity._DC)]) for b, grams in words]
    states = []
    for d in "fb":
        state, out = np.zeros(h), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, u = x[t] @ w[f"W{d}"] + w[f"b{d}"], state @ w[f"U{d}"]
            z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
            out[t] = state
        states.append(out)
    s = [np.concatenate(pair) for pair in zip(*states, strict=True)]
    e = np.exp([np.tanh(v @ w["Wa"] + w["ba"]) @ w["va"] for v in s])
    return float(sum(a * v for a, v in zip(e / e.sum(), s, strict=True)) @ w["wo"] + w["bo"][0])


def test_toxicity_scores_by_brute_force(spark):
    r = np.random.default_rng(6)
    names = ["".join(r.choice(list("abcdeé😀"), int(r.integers(1, 9)))) for _ in range(90)]
    texts = [" ".join(r.choice(names, n)) for n in (1, 2, 31, 32, 33, 57, 200)] + ["", "...", None, "A,b-c"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(60)], "doc_id long, text string")
    net = toxicity.trained(docs, labels)
    double = {k: v.astype(np.float64) for k, v in net.w.items()}
    for got in toxicity.score(docs, labels).collect():
        t = toxicity.Texts(pa.array([got.text], pa.string()))
        index = t.index(np.arange(len(t.begin)))
        assert set(index[index >= 0].tolist()) == set(t.word.tolist())
        of = lambda k, t=t: (t.bucket[k], t.grams(np.array([k]))[0])
        logits = [naive_logit(double, [of(k) for k in row if k >= 0]) for row in index]
        assert abs(got.score - (1 / (1 + np.exp(-max(logits))) if logits else 0.0)) < 1e-4


def test_toxicity_gradients_are_slopes():
    r = np.random.default_rng(7)
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs, index = r.standard_normal((6, toxicity._D)), np.array([[0, 1, 2, 3, -1], [5, 4, 0, 0, 1], [2, -1, -1, -1, -1]])
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        x = net.forward(inputs, index)
        return float((weight * (np.logaddexp(0, x) - labels * x)).sum() / weight.sum())

    g, dx = net.gradients(inputs, index, labels, weight)
    for k, table in [*((k, net.w[k]) for k in g), ("inputs", inputs)]:
        slope = dx if k == "inputs" else g[k]
        for at in zip(*(r.integers(0, n, 4) for n in table.shape), strict=True):
            kept, table[at] = table[at], table[at] + 1e-3
            up, table[at] = loss(), kept - 1e-3
            down, table[at] = loss(), kept
            assert abs((up - down) / 2e-3 - slope[at]) < 2e-3 * max(1, abs(slope[at])) , k


def test_toxicity_takes_whole_long_texts(spark):
    rows = [(i, "plain words here " * 5000 + ("zorq " if i % 2 else "calm ")) for i in range(1, 40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert toxicity.trained(docs, labels) is not None  # 85,000 characters each
    assert toxicity.trained(docs, labels, chars=50_000) is None
    assert sum(len(x.text) for x in toxicity.sample(docs, labels, 3).collect()) == 6 * 85_005


def test_windows_overlap_and_cover():
    text, start = toxicity.spans(np.array([0, 5, 32, 33, 100]))
    assert [list(start[text == t]) for t in range(5)] == [[], [0], [0], [0, 1], [0, 16, 32, 48, 64, 68]]
    whole = toxicity.WINDOW - toxicity.STRIDE + 1
    for n in (whole, 47, 100):
        own = toxicity.spans(np.array([n]))[1]
        assert all(any(b <= i and i + whole <= b + toxicity.WINDOW for b in own) for i in range(n - whole + 1))
