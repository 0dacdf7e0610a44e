"""The pipeline's stages, and all of them, against plain Python."""

from __future__ import annotations

import hashlib
import math
import tracemalloc

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tickforge.llm import bpe, substrings, toxicity

DATA = "/root/testdata/sf0.001"
CLASH = ["score", "predicted", "held_out", "copy", "n_copies", "place", "n_words", "n_removed", "kept_text", "row_key", "kept", "component_id", "n_shingles", "ids", "decoded"]


def near(rows, size=5):
    """Indices of the rows that stay."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    has: dict = {}
    for i, s in enumerate(sets):
        for g in s if rows[i][0] is not None else ():
            has.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common: dict = {}
        for g in s if rows[i][0] is not None else ():
            for j in has[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out, seen = [], set()
    for i, (doc, t) in enumerate(rows):
        if doc is None:
            out.append(i)
        elif doc == least[find(i)] and (doc, t) not in seen:
            seen.add((doc, t))
            out.append(i)
    return out


def cut(rows, window=13):
    """The texts that are left."""
    words, owner = [(t or "").encode().split() for _, t in rows], {}
    for (doc, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1) if doc is not None else ():
            owner[tuple(w[k : k + window])] = min(doc, owner.get(tuple(w[k : k + window]), doc))
    out = []
    for (doc, t), w in zip(rows, words, strict=True):
        gone = {k + i for k in range(len(w) - window + 1) if doc is not None and owner[tuple(w[k : k + window])] < doc for i in range(window)}
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t)
    return out


def counts(rows, alpha=0.5):
    """How often each row (doc_id, source) stands in the mix."""
    n: dict = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    total, out = sum(v**alpha for v in n.values()), []
    for doc, s in rows:
        rate = n[s] ** alpha / total * len(rows) / n[s]
        assert rate <= 20
        u, p, c, k = int(hashlib.md5(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate), math.exp(-rate), 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out.append(k)
    return out


@pytest.fixture(scope="module")
def known():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, passage + " own", "s"), (5, "start here then " + passage, "t"), (6, passage + " Own", "t"), (6, passage + " Own", "t"), (None, passage, "t"), (None, None, "s"),
        (None, None, "s"), (7, "x " * 20000, "s"), (8, "x " * 20000 + "y", "s"), (9, "one", "u"), (10, "one", "u"), (11, " \n\t", "u"), (12, "other " * 9 + passage + " and more of it " * 5, "u"),
    ]
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})


def told(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def check_clash(df, names):
    assert df.columns == names
    for r in df.collect():
        assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in CLASH)


def test_toxicity_stage(spark, docs):
    got = cp.toxic(spark, docs, DATA)
    want = toxicity.score(docs.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")).filter("score < 0.7")
    assert told(got, "doc_id", "text") == told(want, "doc_id", "text")
    check_clash(got, docs.columns)


def test_near_duplicates_stage(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = cp.near_duplicates(spark, docs, DATA)
    assert told(got, "doc_id", "text") == sorted((rows[i] for i in near(rows)), key=str)
    check_clash(got, docs.columns)


def test_substrings_stage(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = cp.cut_substrings(spark, docs, DATA)
    assert told(got, "doc_id", "text", "n_chars") == sorted(((i, t, None if t is None else len(t)) for (i, _), t in zip(rows, cut(rows), strict=True)), key=str)
    check_clash(got, docs.columns)


def test_mixing_stage(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    got = cp.mixed(spark, docs, DATA)
    n = counts([r[:2] for r in rows])
    assert told(got, "doc_id", "source", "text") == sorted((r for r, k in zip(rows, n, strict=True) for _ in range(k)), key=str)
    check_clash(got, docs.columns)


def test_bpe_stage(spark, docs, known):
    for r in cp.tokenized(spark, docs, DATA).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.round_trip and list(r.ids) == known.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
    assert cp.tokenized(spark, docs, DATA).count() == docs.count()


def test_stages_of_an_empty_table(spark, docs):
    empty = docs.filter("1 = 0")
    for name, stage in cp.STAGES:
        out = stage(spark, empty, DATA)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_run(spark, known):
    source = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, source, lang FROM '{DATA}/documents.parquet'").fetchall()}
    toxic = cp.toxic(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).select("doc_id", "text").orderBy("doc_id").collect()
    rows = [tuple(r) for r in toxic]
    rows = [rows[i] for i in near(rows)]
    rows = [(i, t) for (i, _), t in zip(rows, cut(rows), strict=True)]
    want = [(i, *reversed(source[i]), known.encode_ordinary(t or "")) for (i, t), k in zip(rows, counts([(i, source[i][0]) for i, _ in rows]), strict=True) for _ in range(k)]
    got = cp.run(spark, DATA).collect()
    assert all(r.round_trip for r in got) and 0 < len(toxic) < len(source)
    assert sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in got) == sorted(want)


def test_workers_drop_the_memos_of_other_stages(spark, docs, monkeypatch):
    sent, frame = [], type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, send=frame.mapInArrow, **k: sent.append(f) or send(self, f, *a, **k))
    for stage in (cp.toxic, cp.near_duplicates, cp.cut_substrings):
        stage(spark, docs, DATA)
    told = pa.table({"rows": [], "starts": [], "masks": []})
    rows = pa.table({"__sd_row": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    cut = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    calls = [lambda f=f: list(f(iter([]))) for f in sent] + [lambda: substrings._pieces(13, 6, 4)((), told, rows), lambda: substrings._removed(13, [], cut)((), told, rows)]
    assert len(sent) >= 7
    for call in calls:
        bpe._codec(b"YQ== 0\n", ".")[1]["a"]
        call()
        assert bpe._codec.cache_info().currsize == 0


def test_memory_of_the_words_of_a_sample():
    column = pa.array([" ".join(f"w{(i * k) % 9973:04d}" for i in range(170_000)) for k in (3, 5, 7, 11)])
    tracemalloc.start()
    t = toxicity.Texts(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert t.counts.tolist() == [170_000] * 4 and len(t.bucket) == 9973
    assert [t.data[t.starts[w] : t.ends[w]].tobytes() for w in t.word[-2:]] == [f"w{(i * 11) % 9973:04d}".encode() for i in (169_998, 169_999)]
    assert peak < 15 * column.nbytes, peak / column.nbytes
