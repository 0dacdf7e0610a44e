"""Op 5: exact top-k search by block-at-a-time pruning.

Terms are (component, sign); a vector's weights are its integer components. Rows are ordered by vec_id and cut to blocks of
BLOCK rows; a block holds a forward index (the matrix of its rows) and each component's largest and smallest weight. A query's
bound for a block is the sum of its term maxima: sum over components of max(q * largest, q * smallest). Each query goes
through the blocks by falling bound and scores whole blocks until the next bound is below its k-th score so far.

Queries are cut to chunks of CHUNK and blocks to parts; a task has one chunk and one part, so each row is read once for each
chunk, and no task holds more than a chunk and a part. A query's best k of each part meet in a window by query.

Components become floor(scale * x), x as double, however large; scores are exact integers, those
beyond 64 bits the nearest of NONE + 1 to -NONE - 1, and ranked as such. Vectors that are null or empty, or hold null or non-finite components, or components that
are not finite after scaling, take no part, nor do rows with a null vec_id; only vectors of equal length are compared. Columns
other than vec_id and embedding are left out, whatever their names. A row's own vec_id is no candidate, so repeated rows don't find themselves; they do
occur as often as they stand for other queries. Ties go to the smaller vec_id. No queries or no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, scaled

BLOCK, CHUNK = 256, 1024
PART_BYTES, LEAST_PARTS = 32 << 20, 24
#: Below every score.
NONE = 1 - (1 << 63)
#: Chunks are rows of two numbers; so many are broadcast (under 50 MB).
MOST_CHUNKS = 1_000_000
PACKED = "dim int, ids binary, rows binary"


def matrices(b: pa.RecordBatch, column: int, ids: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, doubles) of the usable vectors of a batch, by length."""
    lists, names = b.column(column), b.column(ids)
    if pa.types.is_fixed_size_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad |= ~np.isfinite(values)
    before = np.concatenate([[0], np.cumsum(bad)])
    n = np.diff(at)
    ok = (before[at[1:]] == before[at[:-1]]) & (n > 0) & lists.is_valid().to_numpy(zero_copy_only=False) & names.is_valid().to_numpy(zero_copy_only=False)
    own = names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(n[ok]):
        which = np.flatnonzero(ok & (n == dim))
        yield int(dim), own[which], values[at[which][:, None] + np.arange(dim)]


def _packed(scale: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list] = {}  # by length and number type: 4 bytes where components fit, else doubles

        def send(key: tuple[int, str], all_of_it: bool) -> Iterator[pa.RecordBatch]:
            dim, (ids, rows) = key[0], (np.concatenate(x) for x in zip(*held[key], strict=True))
            stop = len(ids) if all_of_it else len(ids) // most * most
            for i in range(0, stop, most):
                j = min(i + most, stop)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[i:j].tobytes()]), pa.array([rows[i:j].tobytes()])], ["dim", "ids", "rows"])
            held[key] = [(ids[stop:], rows[stop:])]

        for b in batches:
            for dim, ids, x in matrices(b, 1, 0):
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                most_of = np.abs(x).max(axis=1)
                for kind, some in (("i4", most_of < 1 << 24), ("f8", (most_of >= 1 << 24) & np.isfinite(most_of))):
                    if some.any():
                        held.setdefault((dim, kind), []).append((ids[some], x[some].astype(kind)))
                        yield from send((dim, kind), False)
        for key in list(held):
            yield from send(key, True)

    return run


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; of Python's integers where they may not fit in 62 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[list(map(int, row)) for row in x.tolist()] for x in (a, b)]
    return np.array([[sum(map(operator.mul, x, y)) for y in whole[1]] for x in whole[0]], object).reshape(len(a), len(b))


def _long(x: np.ndarray) -> np.ndarray:
    """Numbers beyond 64 bits as the nearest long above NONE."""
    return np.clip(x, NONE + 1, -NONE - 1).astype(np.int64) if x.dtype == object else x


def search(queries: np.ndarray, own: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of each query's best k over blocks of (ids, rows), best first, padded with the score NONE; and how many (query, block) pairs were scored."""
    up, down = np.stack([r.max(axis=0) for _, r in blocks]), np.stack([r.min(axis=0) for _, r in blocks])
    bound = _dot(np.maximum(queries, 0), up) + _dot(np.minimum(queries, 0), down)
    bound = _long(bound)
    ids, scores, scored = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), NONE), 0
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(len(blocks)):
        which = order[active, turn]
        go = bound[active, which] >= scores[active, -1]
        active, which = active[go], which[go]
        if not len(active):
            break
        scored += len(active)
        for block in np.unique(which):
            mine = active[which == block]
            names, rows = blocks[block]
            new = _long(_dot(queries[mine], rows))
            new[names[None] == own[mine, None]] = NONE
            all_ids = np.concatenate([ids[mine], np.broadcast_to(names, new.shape)], axis=1)
            all_scores = np.concatenate([scores[mine], new], axis=1)
            if all_scores.shape[1] > 4 * k:
                low = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
                for i, q in enumerate(mine):
                    some = np.flatnonzero(all_scores[i] >= low[i])
                    best = some[np.lexsort((all_ids[i, some], -all_scores[i, some]))[:k]]
                    ids[q], scores[q] = all_ids[i, best], all_scores[i, best]
            else:
                for i, q in enumerate(mine):
                    best = np.lexsort((all_ids[i], -all_scores[i]))[:k]
                    ids[q], scores[q] = all_ids[i, best], all_scores[i, best]
    return ids, scores, scored


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int):
    def run(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not queries.num_rows or not blocks.num_rows:
            return FOUND.empty_table()
        dim = key[0].as_py()
        kind = lambda i, r: np.int32 if 2 * len(r) == dim * len(i) else np.float64
        unpack = lambda t: [(np.frombuffer(i, np.int64), np.frombuffer(r, kind(i, r)).reshape(-1, dim)) for i, r in zip(t.column("ids").to_pylist(), t.column("rows").to_pylist())]  # noqa: E731, B905
        asked = unpack(queries)
        own, rows = np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked])
        ids, scores, _ = search(rows, own, unpack(blocks), k)
        real = scores > NONE
        return pa.table([np.repeat(own, k)[real.ravel()], ids[real], scores[real]], schema=FOUND)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best k rows; both tables have vec_id and embedding."""
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    parts = scaled(vectors, PART_BYTES, LEAST_PARTS)
    ranged = pick(vectors).repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    blocks = ranged.mapInArrow(_packed(scale, BLOCK), PACKED)
    asked = materialize(pick(queries).mapInArrow(_packed(scale, CHUNK), PACKED).withColumn("chunk", F.xxhash64("ids")), "queries")
    chunks = asked.select(F.col("dim").alias("asked_dim"), F.col("chunk").alias("with")).distinct()
    chunks = F.broadcast(chunks) if chunks.count() <= MOST_CHUNKS else chunks
    blocks = blocks.withColumn("piece", (F.shiftrightunsigned(F.xxhash64("ids"), 1) % parts).cast("int")).join(chunks, F.col("dim") == F.col("asked_dim"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = asked.groupBy("dim", "chunk", "part").cogroup(blocks.groupBy("asked_dim", "with", "piece")).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
