r"""Op 2: substring dedup. Words covered by a window of `window` words that also starts in a document with a smaller doc_id go.

1. Of the `ANCHOR`-word strings in a window, the one of least hash is the window's anchor, so equal windows have equal
   anchors wherever they stand, and neighbouring windows mostly share one. Anchors (a hash, and the block of documents that
   has it) are combined in each task and sent to the anchor's shard, which tells each block its anchors that at least two
   documents have. This only sends windows where their equals can be; it decides nothing.
2. Each block sends the runs of windows under shared anchors, as text, to the anchor's shard, one of equal runs only.
3. A shard builds a compressed FM-index (fmindex.py) of its distinct runs, and searches every run backward through the
   wavelet matrix. Matching statistics give the places that match `window` words and their interval of suffixes; the least
   doc_id in an interval owns the window. Windows whose owner is smaller than their document are reported.
4. Reported windows meet their block, and covered words are cut.

Blocks and shards grow in number with the input and stay bounded in size. Equal runs of one block meet in one row, so a
passage in a third of all documents sends each shard at most a row per block. Any lost task is recomputed from its input.

Results: n_words, n_removed, kept_text (kept words joined by one space). Null and empty texts have no words. Rows with a
null doc_id neither own windows nor lose words. Rows with the same doc_id are one document for comparison, each judged by its
own words; repeated rows give repeated results. Texts shorter than a window keep all words. Other columns pass through, those
of the results' names are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fmindex import DEPTH, FMIndex
from .store import scaled, small_batches
from .text import forget, give_back, ngram_hashes, slices, strings, word_hashes, words

WINDOW, ANCHOR = 13, 6
#: Bytes of input files for each block and shard, and their least number.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 256
#: Anchors that a task holds before it sends them.
HELD = 1 << 20


def runs(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, end, text) of the runs of neighbouring windows that share an anchor's place. Windows are named by their first word."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = ngram_hashes(h, anchor)
    best, place = a[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - anchor + 1):
        less = a[j : n + j] < best
        best[less] = a[j : n + j][less]
        place[less] = j
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    own = np.flatnonzero(np.arange(n) + window <= first[text + 1])
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = own + place[own]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[own[1:]] != text[own[:-1]])]))
    return best[own[new]], own[new], np.append(own[new[1:] - 1], own[-1]) + 1, text[own[new]]


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = strings(column)
    starts, ends, first = words(data, at)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _cut(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a sorted array's runs."""
    if not len(order_key):
        return order_key, np.zeros(1, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], order_key[1:] != order_key[:-1]]))
    return order_key[edge], np.append(edge, len(order_key))


def _anchors(window: int, anchor: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("blocks", pa.binary()), ("many", pa.binary())])

    def send(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, block, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, a))
        a, block, row = a[order], block[order], row[order]
        new_key = np.concatenate([[True], a[1:] != a[:-1]])
        new_row = new_key | np.concatenate([[True], row[1:] != row[:-1]])
        key = np.cumsum(new_key) - 1
        many = np.bincount(key, new_row)[key] > 1
        order = np.lexsort((block, a, (a >> np.uint64(32)) % np.uint64(shards)))
        a, block, many = a[order], block[order], many[order]
        one = np.concatenate([[True], (a[1:] != a[:-1]) | (block[1:] != block[:-1])])
        a, block, many = a[one], block[one], many[one].astype(np.uint8)
        shard, cut = _cut((a >> np.uint64(32)) % np.uint64(shards))
        of = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())  # noqa: E731, B905
        return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), of(a), of(block), of(many)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n, rows = [], 0, 0
        for b in slices(batches, "text"):
            _, _, _, first, h = _read(b.column(0))
            a, _, _, text = runs(h, first, window, anchor)
            if len(a):
                held.append((a, b.column(1).to_numpy()[text].astype(np.int32), text + rows))
                n += len(a)
            rows += b.num_rows
            if n >= HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of shards: to each block, its anchors that other documents have."""
    forget()
    a, block, many = [], [], []
    for b in batches:
        a += [np.frombuffer(x.as_py(), np.uint64) for x in b.column(1)]
        block += [np.frombuffer(x.as_py(), np.int32) for x in b.column(2)]
        many += [np.frombuffer(x.as_py(), np.uint8) for x in b.column(3)]
    if not a:
        return
    a, block, many = np.concatenate(a), np.concatenate(block), np.concatenate(many)
    order = np.argsort(a, kind="stable")
    a, block, many = a[order], block[order], many[order]
    key = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1
    keep = (np.bincount(key)[key] > 1) | (np.bincount(key, many)[key] > 0)
    a, block = a[keep], block[keep]
    order = np.lexsort((a, block))
    a, block = a[order], block[order]
    one = np.concatenate([[True], (a[1:] != a[:-1]) | (block[1:] != block[:-1])])[: len(a)]
    blocks, cut = _cut(block[one])
    a = a[one]
    for i in range(0, len(blocks), 1000):
        part = range(i, min(i + 1000, len(blocks)))
        yield pa.RecordBatch.from_arrays([pa.array([int(blocks[k]) for k in part], pa.int32()), pa.array([a[cut[k] : cut[k + 1]].tobytes() for k in part], pa.binary())], ["block", "keys"])


PIECES = pa.schema([("route", pa.int32()), ("block", pa.int32()), ("texts", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary()), ("masks", pa.binary())])


def _pieces(window: int, anchor: int, shards: int):
    """Of a block: its runs under shared anchors, to their shards, and windows that a smaller document of the block has."""

    def run(key: tuple, told: pa.Table, docs: pa.Table) -> pa.Table:
        forget()
        if not told.num_rows or not docs.num_rows:
            return PIECES.empty_table()
        shared = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in told.column("keys")]))
        doc, row = docs.column("__sd_doc").to_numpy(), docs.column("__sd_row").to_numpy()
        known = np.flatnonzero(docs.column("__sd_known").to_numpy(zero_copy_only=False))
        docs = docs.take(pa.array(known))
        doc, row = doc[known], row[known]
        data, starts, ends, first, h = _read(docs.column("text"))
        a, begin, end, text = runs(h, first, window, anchor)
        at = np.searchsorted(shared, a)
        mine = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == a) if len(shared) else np.zeros(0, np.int64)
        if not len(mine):
            return PIECES.empty_table()
        length = ends - starts + 1
        place = np.cumsum(length) - length  # of each word in the words of all texts joined by one space
        place = np.append(place, place[-1] + length[-1])
        gap = np.ones(int(place[-1]), bool)
        gap[place[1:] - 1] = False
        joined = np.full(int(place[-1]), 32, np.uint8)
        edges = np.zeros(len(data) + 1, np.int8)
        edges[starts] += 1
        np.subtract.at(edges, ends, 1)
        joined[gap] = data[np.cumsum(edges[:-1]) > 0]
        flat = joined.tobytes()
        lo, hi = place[begin[mine]], place[end[mine] + window - 1] - 1
        route = ((a[mine] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((doc[text[mine]], route))
        seen: dict[bytes, int] = {}
        sent, local = [], []
        for i in order.tolist():
            piece = flat[lo[i] : hi[i]]
            owner = seen.setdefault(piece, int(doc[text[mine[i]]]))
            (sent if owner == doc[text[mine[i]]] else local).append((i, piece))
        out: dict[str, list] = {f.name: [] for f in PIECES}

        def add(where: int, items: list, texts: bytes | None) -> None:
            i = mine[[x[0] for x in items]]
            n = end[i] - begin[i]
            for name, value in (("route", where), ("block", int(key[0].as_py())), ("texts", texts), ("docs", doc[text[i]].astype(np.int64).tobytes()), ("rows", row[text[i]].astype(np.int64).tobytes()),
                                ("starts", (begin[i] - first[text[i]]).astype(np.int64).tobytes()), ("masks", ((1 << n) - 1).astype(np.uint16).tobytes())):
                out[name].append(value)

        for where, items in groupby(sent, key=lambda x: int(route[x[0]])):
            part = list(items)
            add(where, part, b"\n".join(x[1] for x in part))
        if local:
            add(int(key[0].as_py()) % shards, local, None)
        made = pa.table(out, PIECES)
        give_back()
        return made

    return run


FOUND = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("masks", pa.binary())])


def _owned(pieces: list[bytes], docs: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Masks of the windows of each piece that a document smaller than its own has, by an FM-index of the distinct pieces."""
    of: dict[bytes, int] = {}
    which = np.array([of.setdefault(p, len(of)) for p in pieces])
    least = np.full(len(of), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    flat = np.frombuffer(b"\n".join(of), np.uint8)
    sizes = np.array([len(p) + 1 for p in of])
    at = np.append(np.cumsum(sizes) - sizes, len(flat))
    starts, ends, first = words(flat, at)
    _, symbol = np.unique(word_hashes(flat, starts, ends), return_inverse=True)
    symbol = symbol + 1
    piece = np.repeat(np.arange(len(of)), np.diff(first))
    text = np.zeros(len(symbol) + len(of), np.int64)
    text[np.arange(len(symbol)) + piece] = symbol
    index = FMIndex(text, int(symbol.max()) + 1)
    length, row = index.matching_statistics(symbol, first, window)
    low = np.zeros(len(symbol), np.int64)
    full = np.flatnonzero(length >= window)
    low[full] = index.widened(row[full], window)[0]
    owner = np.full(index.n + 1, np.iinfo(np.int64).max)
    np.minimum.at(owner, low[full], least[piece[full]])
    out = np.zeros(len(pieces), np.uint16)
    n = np.bitwise_count(masks)
    for k in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > k)
        at_word = first[which[some]] + k
        out[some] |= ((owner[low[at_word]] < docs[some]).astype(np.uint16) << k).astype(np.uint16)
    return out


def _search(window: int, shards: int, blocks: int):
    def found(rows: np.ndarray, starts: np.ndarray, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = masks > 0
        rows, starts, masks = rows[keep], starts[keep], masks[keep]
        block = rows % blocks
        order = np.argsort(block, kind="stable")
        rows, starts, masks = rows[order], starts[order], masks[order]
        ids, cut = _cut(block[order])
        if len(ids):
            of = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())  # noqa: E731, B905
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), of(rows), of(starts), of(masks)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: r["route"]):
            held = []
            for r in group:
                if r["texts"] is None:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in FOUND.names}], FOUND)
                else:
                    held.append(r)
            if held:
                of = lambda name, kind, held=held: np.frombuffer(b"".join(r[name] for r in held), kind)
                pieces = [p for r in held for p in r["texts"].split(b"\n")]
                masks = _owned(pieces, of("docs", np.int64), of("masks", np.uint16), window)
                yield from found(of("rows", np.int64), of("starts", np.int64), masks)
                give_back()

    return run


def _removed(window: int, names: list[str], schema: pa.Schema):
    def run(key: tuple, told: pa.Table, docs: pa.Table) -> pa.Table:
        forget()
        cover: dict[int, list[tuple[int, int]]] = {}
        for r in told.to_pylist():
            for row, start, mask in zip(np.frombuffer(r["rows"], np.int64).tolist(), np.frombuffer(r["starts"], np.int64).tolist(), np.frombuffer(r["masks"], np.uint16).tolist()):  # noqa: B905
                cover.setdefault(row, []).append((start, mask))
        n_words, n_removed, kept = [], [], []
        for row, text in zip(docs.column("__sd_row").to_pylist(), docs.column("text").to_pylist()):  # noqa: B905
            own = (text or "").encode().split()
            total = len(own)
            if found := cover.get(row):
                edge = np.zeros(total + 1, np.int32)
                for start, mask in found:
                    for k in range(mask.bit_length()):
                        if mask >> k & 1:
                            edge[start + k] += 1
                            edge[start + k + window] -= 1
                own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            n_words.append(total)
            n_removed.append(total - len(own))
            kept.append(b" ".join(own))
        columns = [docs.column(n) for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        made = pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema)
        give_back()
        return made

    return run


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text."""
    if not 0 < anchor <= window <= DEPTH:
        raise ValueError(f"an anchor has at most a window's words, a window at most {DEPTH}")
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    blocks = scaled(docs, BLOCK_BYTES, LEAST_BLOCKS)
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names = docs.columns
    dealt = docs.withColumns({"__sd_row": F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1), "__sd_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__sd_known": F.col("doc_id").isNotNull()})
    dealt = dealt.withColumn("__sd_block", (F.col("__sd_row") % blocks).cast("int"))
    wide = max(blocks // 4, 1)

    anchors = dealt.filter("__sd_known").select("text", "__sd_block").mapInArrow(_anchors(window, anchor, blocks), "shard int, keys binary, blocks binary, many binary")
    shared = anchors.repartition(wide, "shard").mapInArrow(_shared, "block int, keys binary")
    pieces = shared.groupBy("block").cogroup(dealt.groupBy("__sd_block")).applyInArrow(_pieces(window, anchor, blocks), "route int, block int, texts binary, docs binary, rows binary, starts binary, masks binary")
    found = pieces.repartition(wide, "route").sortWithinPartitions("route").mapInArrow(_search(window, blocks, blocks), "block int, rows binary, starts binary, masks binary")

    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return found.groupBy("block").cogroup(dealt.groupBy("__sd_block")).applyInArrow(_removed(window, names, to_arrow_schema(schema)), schema)
