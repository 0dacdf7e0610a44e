"""Op 9: near-duplicate vectors by spherical-cap filters.

A structured random product code gives filter directions: the space is rotated and cut to four parts, each with CODES random
unit vectors, and a direction is one vector of each part, CODES^4 in all. Each unit vector is list-decoded to all directions
whose cap it is in (inner product at least `alpha`): sums over two parts are pruned by what the other two can add, so most
combinations are never formed. `alpha` is set so that a random vector is in about LISTED caps; a vector always takes its LEAST
best directions as well. Vectors with cosine 0.98 then share a cap with probability above 0.99 (measured in the README).

Equal vectors of equal label are one class with a count. Classes are joined on (label, direction), and all pairs in a cap are
verified in double precision. A pair counts in the smallest cap that both are in, so no pair is emitted: a cap gives each of
its classes a number of links, and edges of a spanning forest. Only caps with several classes get vectors (in the table's own
precision). A cap of more than TILE classes is cut to tiles of two chunks.

Vectors that are null, empty, zero, or hold null or non-finite components, rows with a null label and rows with a null vec_id
link with nothing: n_links 0, component_id vec_id, kept. Vectors of unequal length don't link. Repeated rows are other vectors;
a vec_id names one vector. Labels of any type are equal if their texts are.
Other columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize
from .text import give_back
from .topk import matrices

THRESHOLD = 0.98
CODES, LISTED, LEAST = 32, 20, 8
TILE = 2048
_KNOWN: dict[int, tuple] = {}


def code(dim: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """(rotation, codes of each part, alpha) for vectors of this length; parts beyond the length are of length 0."""
    if dim not in _KNOWN:
        r = np.random.default_rng(dim)
        rotation = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        sizes = [len(x) for x in np.array_split(np.arange(dim), 4)]
        codes = [r.standard_normal((CODES, n)) for n in sizes]
        codes = [np.unique(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300), axis=0) for c in codes]  # a line has two
        x = r.standard_normal((64, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        low, high = _halves(x @ rotation, codes)
        most = 8 * LISTED
        best = np.concatenate([np.sort((a[:, None] + b).ravel())[-most:] if len(a) * len(b) <= most else np.partition((a[:, None] + b).ravel(), -most)[-most:] for a, b in zip(low, high)])  # noqa: B905
        _KNOWN[dim] = rotation, codes, float(np.sort(best)[-min(len(best), LISTED * len(x))])
    return _KNOWN[dim]


def _halves(x: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cut = np.cumsum([0] + [c.shape[1] for c in codes])
    s = [x[:, cut[i] : cut[i + 1]] @ codes[i].T * 0.5 for i in range(4)]
    return (s[0][:, :, None] + s[1][:, None]).reshape(len(x), -1), (s[2][:, :, None] + s[3][:, None]).reshape(len(x), -1)


def decode(x: np.ndarray) -> list[np.ndarray]:
    """The directions of each unit vector, ascending."""
    rotation, codes, alpha = code(x.shape[1])
    out = []
    for i in range(0, len(x), 16):
        low, high = _halves(x[i : i + 16] @ rotation, codes)
        top = np.sort((np.sort(low, axis=1)[:, -LEAST:, None] + np.sort(high, axis=1)[:, None, -LEAST:]).reshape(len(low), -1), axis=1)
        top = top[:, -min(LEAST, top.shape[1])]
        need = np.minimum(alpha, top) - 1e-12
        row, a = np.nonzero(low >= (need - high.max(axis=1))[:, None])
        pair, b = np.nonzero(low[row, a][:, None] + high[row] >= need[row][:, None])
        caps = a[pair] * high.shape[1] + b
        at = np.searchsorted(row[pair], np.arange(len(low) + 1))
        out += [np.sort(caps[at[j] : at[j + 1]]).astype(np.int32) for j in range(len(low))]
    return out


def _units(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, size = {}, {}
            for dim, ids, x in matrices(b, 1, 0):
                some = np.abs(x).max(axis=1) > 0
                for i, v in zip(ids[some].tolist(), x[some].astype(kind)):  # noqa: B905
                    known[i], size[i] = v.tobytes(), dim
            ids = [i if l is not None else None for i, l in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]  # noqa: B905
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([size.get(i) for i in ids], pa.int32()), pa.array([known.get(i) for i in ids], pa.binary())], ["vec_id", "label", "dim", "v"])

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _capped(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dims, node, v = (c.to_pylist() for c in b.columns)
            for dim in sorted(set(dims)):
                own = [i for i, d in enumerate(dims) if d == dim]
                caps = decode(_unit(np.frombuffer(b"".join(v[i] for i in own), kind).reshape(-1, dim).astype(np.float64)))
                n = [len(c) for c in caps]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([label[i] for i in own], n).tolist(), pa.string()), pa.array(np.full(sum(n), dim, np.int32)), pa.array(np.concatenate(caps)), pa.array(np.repeat([node[i] for i in own], n))], ["label", "dim", "cap", "node"])

    return run


def _seen_before(a: list[np.ndarray], b: list[np.ndarray], cap: int) -> np.ndarray:
    """Whether the lists of row and column share a cap smaller than this one."""
    out = np.zeros((len(a), len(b)), bool)
    early = lambda lists: (np.repeat(np.arange(len(lists)), [np.searchsorted(x, cap) for x in lists]), np.concatenate([x[: np.searchsorted(x, cap)] for x in lists] or [np.zeros(0, np.int32)]))
    (ra, ca), (rb, cb) = early(a), early(b)
    shared = np.intersect1d(ca, cb)
    for i in range(0, len(shared), 4096):
        part = shared[i : i + 4096]
        g = []
        for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            m = np.zeros((n, len(part)), np.float32)
            at = np.minimum(np.searchsorted(part, c), len(part) - 1)
            hit = part[at] == c
            m[r[hit], at[hit]] = 1
            g.append(m)
        out |= g[0] @ g[1].T > 0
    return out


LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _verified(threshold: float, kind: str):
    def tile(rows: list[dict]) -> pa.Table:
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        alone = not sides[1]
        a, b = sides[0], sides[0] if alone else sides[1]
        if not a or not b or (alone and len(a) < 2):
            return LINKS.empty_table()
        x, y = (_unit(np.frombuffer(b"".join(r["v"] for r in s), kind).reshape(len(s), -1).astype(np.float64)) for s in (a, b))
        hit = x @ y.T >= threshold
        if alone:
            np.fill_diagonal(hit, False)
        i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(i):
            return LINKS.empty_table()
        hit = hit[np.ix_(i, j)]
        na, nb = np.array([a[k]["node"] for k in i]), np.array([b[k]["node"] for k in j])
        lists = [[np.array(s[k]["caps"], np.int32) for k in w] for s, w in ((a, i), (b, j))]
        new = hit & ~_seen_before(*lists, rows[0]["cap"])
        ca, cb = np.array([a[k]["count"] for k in i]), np.array([b[k]["count"] for k in j])
        la, lb = new @ cb, new.T @ ca
        least_a, least_b = na.copy(), nb.copy()  # labels fall along hits until they stand
        while True:
            to_a = np.minimum(least_a, np.where(hit, least_b[None], np.iinfo(np.int64).max).min(axis=1))
            to_b = np.minimum(least_b, np.where(hit, to_a[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (to_a == least_a).all() and (to_b == least_b).all():
                break
            least_a, least_b = to_a, to_b
        if alone:
            return pa.table([na, least_a, la], schema=LINKS)
        return pa.table([np.concatenate([na, nb]), np.concatenate([least_a, least_b]), np.concatenate([la, lb])], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["label"], r["dim"], r["cap"], r["ta"], r["tb"])):
            yield from tile(list(group)).to_batches()
        give_back()

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    kind = "f4" if "array<float>" in dict(vectors.dtypes)["embedding"] else "f8"
    units = materialize(rows.mapInArrow(_units(kind), "vec_id long, label string, dim int, v binary"), "units")
    classes = units.filter("v is not null").groupBy("label", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("count"))
    classes = materialize(classes, "vectors")
    key = ["label", "dim", "cap"]
    capped = classes.select("label", "dim", "node", "v").mapInArrow(_capped(kind), "label string, dim int, cap int, node long")
    capped = materialize(capped, "decoded")
    sizes = capped.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
    capped = materialize(capped.join(sizes, key), "caps")
    lists = capped.groupBy("node").agg(F.sort_array(F.collect_list("cap")).alias("caps"))
    tiled = capped.withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiled = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select(*key, F.least("own", "with").alias("ta"), F.greatest("own", "with").alias("tb"), (F.col("own") > F.col("with")).cast("int").alias("side"), "node")
    full = tiled.join(classes.select("node", "count", "v").join(lists, "node"), "node")
    dealt = full.repartition(*key, "ta", "tb").sortWithinPartitions(*key, "ta", "tb")
    found = materialize(dealt.mapInArrow(_verified(threshold, kind), "node long, other long, links long"), "near")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = _named(classes, links, labels)
    out = units.join(named, ["label", "dim", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _named(classes: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.withColumnRenamed("label", "component_id")
    n = F.coalesce("links", F.lit(0)) + F.col("count") - 1
    return classes.join(links, "node", "left").join(own, "node", "left").select("label", "dim", "v", n.alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
