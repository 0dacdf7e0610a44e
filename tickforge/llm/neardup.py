"""Op 6: near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document's set holds its distinct shingles of `size` words. Each shingle's hash goes to one of BINS bins, a bin keeps its least hash,
and empty bins are filled by optimal densification (each empty bin tries bins by a hash of its own number and the attempt
until one is full). Bands of bins are hashed to buckets; their number follows the asked `similarity`, so that two sets just as
similar share no bucket with probability MISSED at most: (1 - 0.8^6)^40 = 5e-6 with Jaccard similarity 0.8.

Equal sets (128 bits of sums over the set, and its size) are one class, so copies make no pairs. A bucket's centre and size come from
partial aggregates and meet its classes in a join, which Spark splits where a bucket is large. A bucket gives a star: edges
from one class to the others, whose texts are then compared in full; a bucket of at most SMALL classes gives all its pairs.
One star cannot see links among its points, so a star with another centre follows for buckets that still hold several
components, to points of other components only. Buckets that hold several components even then (by a common passage, say)
are settled exactly and without pairs as rows: the bucket's sets go to one task, or, of more than TILE sets or TILE_SHINGLES
shingles, to tiles of two chunks each; a product of the sets' incidence matrices counts what each two have in common, and
the task reports a spanning forest of the links. Pairs are pruned only by size (smaller < similarity * larger can't link).

Results: one row per row: doc_id, row_key, n_shingles, component_id (smallest doc_id reachable), kept. Null and empty texts,
and texts of white space, have an empty set and are linked with nothing. Fewer than `size` words are a set of one sequence. Rows with a null
doc_id are linked with nothing, with a null component_id, and kept. Rows with equal doc_ids are nodes of their own; repeated
rows get the same result. Only doc_id and text are read. Very long texts are whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize, small_batches
from .text import LOWER, forget, mix, ngram_hashes, slices, strings, word_hashes, words

SIZE, SIMILARITY = 2, 0.8
BINS, MISSED = 240, 1e-5
#: Classes of a bucket whose pairs are all compared; rounds of stars for larger ones.
SMALL, STARS = 5, 2
TILE, TILE_SHINGLES = 1024, 400_000
#: Unsettled buckets whose sizes are broadcast (under 20 MB).
MOST_BUCKETS = 500_000
_UPPER = bytes(LOWER.tobytes())
SIGNED = "doc_id long, row_key long, n_shingles long, c1 long, c2 long, bands array<long>"


def densified(least: np.ndarray) -> np.ndarray:
    """Rows of bins (all bits set: empty) with each empty bin's value taken from the first full one that its hashes name."""
    out, empty = least.copy(), np.uint64(0xFFFFFFFFFFFFFFFF)
    row, place = np.nonzero((least == empty) & (least != empty).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(least.shape[1])).astype(np.int64)
        found = least[row, source]
        full = found != empty
        out[row[full], place[full]] = found[full]
        row, place = row[~full], place[~full]
    return out


def banding(similarity: float) -> tuple[int, int]:
    """(bands, bins of a band): the longest bands by which two sets of this similarity share a bucket but with probability MISSED."""
    for rows in range(BINS, 0, -1):
        if (1 - similarity**rows) ** (BINS // rows) <= MISSED:
            return BINS // rows, rows
    raise ValueError(f"{BINS} bins can't find pairs of similarity {similarity}")


def _similar(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction, for exact comparisons."""
    return Fraction(str(similarity)).as_integer_ratio()


def sign(texts: pa.Array, words_each: int = SIZE, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two sums over the set, band hashes) of each text."""
    n_bands, n_rows = banding(similarity)
    size, c1, c2 = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    least = np.full((len(texts), BINS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i, s in enumerate(hashed(texts, words_each)):
        size[i], c1[i], c2[i] = len(s), s.sum(), mix(s ^ np.uint64(0x3C6EF372FE94F82B)).sum()
        np.minimum.at(least[i], ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64), s & np.uint64(0xFFFFFFFF))
    full = densified(least)
    odd = mix(np.arange(1, n_rows + 1, dtype=np.uint64)) | np.uint64(1)
    bands = mix((full[:, : n_bands * n_rows].reshape(len(texts), n_bands, n_rows) * odd).sum(axis=2, dtype=np.uint64) ^ mix(np.arange(n_bands, dtype=np.uint64) + np.uint64(77)))
    return size, c1, c2, bands


def _signed(words_each: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, "text"):
            size, c1, c2, bands = sign(b.column(2), words_each, similarity)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands.shape[1], pa.int32()), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists], ["doc_id", "row_key", "n_shingles", "c1", "c2", "bands"])

    return run


def hashed(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The set of each text as sorted hashes of its shingles."""
    data, at = strings(texts)
    data = LOWER[data]
    starts, ends, first = words(data, at)
    h = word_hashes(data, starts, ends)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    g = ngram_hashes(padded, size)[: len(h)]
    n = np.diff(first)
    for k in range(1, size):
        few = first[:-1][n == k]
        if len(few):
            g[few] = mix((h if k == 1 else ngram_hashes(padded, k))[few] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + k - 1))
    for i, k in enumerate(n):
        s = np.sort(g[first[i] : max(first[i + 1] - size + 1, first[i] + 1)]) if k else g[:0]
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if k else s


def shingles(text: str | None, size: int = SIZE) -> set:
    w = (text or "").encode().translate(_UPPER).split()
    return {tuple(w)} if 0 < len(w) < size else set(zip(*(w[i:] for i in range(size))))  # noqa: B905


def _compared(size: int, similarity: float):
    part, whole = _similar(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[int, set] = {}
        for b in batches:
            keep = []
            for i, (u, v, a, c) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):  # noqa: B905
                if len(known) > 64:
                    known.clear()
                x = known[u] if u in known else known.setdefault(u, shingles(a, size))
                y = known[v] if v in known else known.setdefault(v, shingles(c, size))
                common = len(x & y)
                if common and whole * common >= part * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])

    return run


def _linked(edges: DataFrame, texts: DataFrame, compared: Callable) -> DataFrame:
    """Those of the edges (u, v) whose whole sets are similar."""
    pairs = edges.join(texts.select(F.col("row_key").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("row_key").alias("v"), F.col("text").alias("c")), "v")
    return materialize(pairs.select("u", "v", "a", "c").mapInArrow(compared, "u long, v long"), "similar")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Distinct edges (u < v) of rows (u, nu, v, nv) that sizes allow."""
    part, whole = _similar(similarity)
    rows = rows.filter(f"u != v and {whole} * least(nu, nv) >= {part} * greatest(nu, nv)")
    return rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _mixed(members: DataFrame, labels: DataFrame, star: int) -> tuple[DataFrame, DataFrame]:
    """Members with their components, and the buckets of several components, each with a centre by a hash of its own for this star."""
    now = members.join(labels, members["node"] == labels["node"], "left").select("bucket", members["node"], "n", F.coalesce("label", members["node"]).alias("label"))
    by = now.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min(F.struct(F.xxhash64("node", F.lit(star)).alias("by"), "node", "n", "label")).alias("centre"))
    return now, by.filter("a != b").select("bucket", "centre")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in hashed(b.column(1), size)], pa.binary())], ["node", "set"])

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    (ta, ra), (tb, rb) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (a, b))
    both = np.intersect1d(ta, tb)
    for i in range(0, len(both), 4096):
        part, m = both[i : i + 4096], []
        for t, r, n in ((ta, ra, len(a)), (tb, rb, len(b))):
            at = np.minimum(np.searchsorted(part, t), len(part) - 1)
            hit = part[at] == t
            x = np.zeros((n, len(part)), np.float32)
            x[r[hit], at[hit]] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _settled(similarity: float):
    """Links that join different labels, of sorted rows (bucket, ta, tb, side, node, label, set)."""
    part, whole = _similar(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))  # noqa: B905
        for _, group in groupby(rows, key=lambda r: r[:3]):
            sides: tuple[list, list] = ([], [])
            for r in group:
                sides[r[3]].append(r)
            a, b = sides[0], sides[1] or sides[0]
            if not a or len({r[5] for r in a} | {r[5] for r in b}) < 2:
                continue
            x, y = ([np.frombuffer(r[6], np.uint64) for r in s] for s in (a, b))
            n, m = np.array([len(v) for v in x]), np.array([len(v) for v in y])
            common = _common(x, y).astype(np.int64)
            hit = (whole * common >= part * (n[:, None] + m[None] - common)) & (common > 0)
            u, v = np.nonzero(hit & (np.array([r[5] for r in a])[:, None] != np.array([r[5] for r in b])[None]))
            label: dict[int, int] = {}

            def root(k: int, label: dict[int, int] = label) -> int:
                while label.get(k, k) != k:
                    k = label[k]
                return k

            kept = []
            for i, j in zip(u.tolist(), v.tolist()):  # noqa: B905
                p, q = root(a[i][5]), root(b[j][5])
                if p != q:
                    label[max(p, q)] = min(p, q)
                    kept.append((a[i][4], b[j][4]))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], ["u", "v"])

    return run


def _settle(members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (u, v) between members (bucket, node, n, label) of each bucket, a spanning forest over labels."""
    nodes = members.select("node").distinct().join(texts, F.col("node") == F.col("row_key")).select("node", "text").dropDuplicates(["node"])
    sets = materialize(nodes.mapInArrow(_sets(size), "node long, set binary"), "sets")
    sizes = members.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("chunks"))
    sizes = materialize(sizes, "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BUCKETS else sizes  # so that a large bucket's members stay where they are
    tiled = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("bucket", F.least("own", "with").alias("ta"), F.greatest("own", "with").alias("tb"), (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "label")
    dealt = tiled.join(sets, "node").select("bucket", "ta", "tb", "side", "node", "label", "set").repartition("bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb")
    return materialize(dealt.mapInArrow(_settled(similarity), "u long, v long"), "settled")


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least `similarity` of their shingles of `size` words."""
    small_batches(docs.sparkSession)
    compared = _compared(size, similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    signed = materialize(rows.mapInArrow(_signed(size, similarity), SIGNED), "signatures")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    one = known.groupBy("c1", "c2", "n_shingles").agg(F.min(F.struct("doc_id", "row_key")).alias("one"), F.first("bands").alias("bands"))
    classes = materialize(one.select("c1", "c2", "n_shingles", F.col("one.doc_id").alias("doc_id"), F.col("one.row_key").alias("node"), "bands"), "classes")

    placed = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    groups = placed.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(placed.join(groups, "bucket").select("bucket", "node", "n", "size", F.col("centre.node").alias("centre"), F.col("centre.n").alias("nc")), "members")
    texts = materialize(rows.join(members.select(F.col("node").alias("row_key")).distinct(), "row_key", "left_semi").select("row_key", "text"), "texts")

    stars = members.filter(F.col("size") > SMALL).select(F.col("centre").alias("u"), F.col("nc").alias("nu"), F.col("node").alias("v"), F.col("n").alias("nv"))
    few = members.filter(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("all"))  # at most SMALL
    few = few.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("b"))
    few = few.select(F.col("a.node").alias("u"), F.col("a.n").alias("nu"), F.col("b.node").alias("v"), F.col("b.n").alias("nv"))
    tried = materialize(_pairs(stars.unionByName(few), similarity), "tried")
    labels = components(_linked(tried, texts, compared))
    large = members.filter(F.col("size") > SMALL).select("bucket", "node", "n")
    for star in range(2, STARS + 1):
        now, mixed = _mixed(large, labels, star)
        found = now.join(mixed, "bucket").filter("label != centre.label").select(F.col("centre.node").alias("u"), F.col("centre.n").alias("nu"), F.col("node").alias("v"), F.col("n").alias("nv"))
        edges = materialize(_pairs(found, similarity).join(tried, ["u", "v"], "left_anti"), "edges")
        if not edges.isEmpty():
            tried, labels = tried.unionByName(edges), components(_linked(edges, texts, compared), labels)
    now, mixed = _mixed(large, labels, STARS + 1)
    unsettled = materialize(now.join(mixed.select("bucket"), "bucket", "left_semi"), "unsettled")
    if not unsettled.isEmpty():
        labels = components(_settle(unsettled, texts, size, similarity), labels)

    placed = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("c1", "c2", "n_shingles", "doc_id", "label")
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "label").select("c1", "c2", "n_shingles", "component_id")
    out = signed.select("doc_id", "row_key", "n_shingles", "c1", "c2").join(named, ["c1", "c2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
