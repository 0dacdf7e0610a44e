"""Op 10: byte-level BPE encoding and decoding by tree reduction.

Each match of the split pattern is encoded on its own. A match longer than `LEAF` bytes is halved; the halves are
encoded recursively and joined: the last k tokens on the left and the first k on the right are encoded anew from their
bytes, and k doubles on a side until the token pair at that seam is stable. A sequence is the BPE encoding of its bytes
if and only if each adjacent pair is the encoding of the pair's own bytes; pairs away from the seams were so before, so
checking the two seams proves the join. Decoding is a homomorphism: a node's bytes are its children's, one after another.

Nulls encode as empty texts (no ids, empty bytes). Empty texts have no ids. Very long matches cost n log^2 n. Repeated
rows and extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import MEMOS, give_back, slices

LEAF = 8
#: Entries of each memo in a worker (matches, short byte strings, token pairs).
MEMO = 250_000
#: Bytes of text whose ids a worker holds at once (a longer text is on its own), and rows that it decodes at once.
SLICE, DECODED = 1 << 20, 256
#: White space as Unicode's White_Space property lists it (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file's lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def compiled(pattern: str) -> regex.Pattern:
    """The split pattern, with White_Space for \\s (the regex module's \\s also has the separators U+001C to U+001F)."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split = compiled(pattern).findall
        self._stable: dict[tuple[int, int], bool] = {}
        self._short: dict[bytes, list[int]] = {}

    def _encode_short(self, text: bytes) -> list[int]:
        """_merge, remembered for short texts; callers don't change what it returns."""
        if len(text) > 2 * LEAF:
            return self._merge(text)
        if (known := self._short.get(text)) is None:
            if len(self._short) >= MEMO:
                self._short.clear()
            known = self._short[text] = self._merge(text)
        return known

    def _merge(self, text: bytes) -> list[int]:
        """BPE by its definition: merge the leftmost pair of lowest rank until none is left."""
        ranks, n = self.ranks, len(text)
        if (whole := ranks.get(text)) is not None:
            return [whole]
        if n <= 4 * LEAF:
            parts = [text[i : i + 1] for i in range(n)]
            scores = [ranks.get(text[i : i + 2], 1 << 60) for i in range(n - 1)]
            while scores and (low := min(scores)) < 1 << 60:
                i = scores.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i < len(scores):
                    scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
                if i:
                    scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            return [ranks[p] for p in parts]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(text[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(text[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[text[i : end[i]]])
            i = end[i]
        return out

    def _pair_is_stable(self, a: int, b: int) -> bool:
        if (known := self._stable.get((a, b))) is None:
            if len(self._stable) >= MEMO:
                self._stable.clear()
            known = self._stable[a, b] = self._encode_short(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self._pair_is_stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._encode_short(self.decode(left[len(left) - i :]) + self.decode(right[:j]))
            left_ok = i == len(left) or self._pair_is_stable(left[-i - 1], window[0])
            right_ok = j == len(right) or self._pair_is_stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if left_ok else 2), j * (1 if right_ok else 2)

    def encode_match(self, text: bytes) -> list[int]:
        if len(text) <= LEAF:
            return self._encode_short(text)
        half = 1 << ((len(text) - 1).bit_length() - 1)
        return self.join(self.encode_match(text[:half]), self.encode_match(text[half:]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class _Leaves(dict):
    """Matches to (ids as text, '5 17 3'; the bytes that those ids decode to). Two generations: a full one becomes the old one."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, match: str) -> tuple[str, bytes]:
        if (out := self.old.get(match)) is None:
            ids = self.codec.encode_match(match.encode())
            out = " ".join(map(str, ids)), self.codec.decode(ids)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[match] = out
        return out


def _ids(text: str) -> np.ndarray:
    """'5 17 3' as numbers."""
    return np.fromstring(text, np.int32, sep=" ") if text else np.zeros(0, np.int32)


@lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> tuple[Codec, _Leaves]:
    codec = Codec(load_ranks(ranks), pattern)
    return codec, _Leaves(codec)


MEMOS.append(_codec.cache_clear)


class Tokenizer:
    """Encode and decode columns of DataFrames by the ranks in a file that the driver reads (under 1 MB, sent with each task)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """`docs` with a column `ids` array<int> (in place of one of that name)."""
        return self._run(docs, text, ids, None)

    def round_trip(self, docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
        """`docs` with `ids` and the bytes that these ids decode to: encode() and decode() in one Python worker for each task."""
        return self._run(docs, text, ids, out)

    def _run(self, docs: DataFrame, text: str, ids: str, out: str | None) -> DataFrame:
        ranks, pattern = self.ranks, self.pattern
        small_batches(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, leaves = _codec(ranks, pattern)
            for batch in slices(batches, text, SLICE):
                column = batch.column(batch.schema.get_field_index(text)).to_pylist()
                found = [_ids(" ".join([leaves[m][0] for m in codec.split(t or "")])) for t in column]
                ends = np.cumsum([0, *map(len, found)])
                made = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))}
                if out is not None:
                    made[out] = pa.array([codec.decode(x.tolist()) for x in found], pa.binary())
                kept = {f.name: c for f, c in zip(batch.schema, batch.columns, strict=True) if f.name not in made}
                yield pa.RecordBatch.from_pydict(kept | made)

        schema = docs.drop(ids, *([out] if out else [])).withColumn(ids, F.lit(None).cast("array<int>"))
        return docs.mapInArrow(run, (schema.withColumn(out, F.lit(None).cast("binary")) if out else schema).schema)

    def decode(self, rows: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """`rows` with a binary column `out`: the bytes of `ids` (null: empty)."""
        ranks, pattern = self.ranks, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, _ = _codec(ranks, pattern)
            for whole in batches:
                for at in range(0, whole.num_rows, DECODED):
                    batch = whole.slice(at, DECODED)
                    column = batch.column(batch.schema.get_field_index(ids))
                    made = {out: pa.array([codec.decode(x.as_py() or []) for x in column], pa.binary())}
                    yield pa.RecordBatch.from_pydict({f.name: c for f, c in zip(batch.schema, batch.columns, strict=True) if f.name != out} | made)

        schema = rows.drop(out).withColumn(out, F.lit(None).cast("binary")).schema
        return rows.mapInArrow(run, schema)

    def digests(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: texts are encoded, and the ids decoded, match by match."""
        ranks, pattern = self.ranks, self.pattern
        small_batches(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, memo = _codec(ranks, pattern)
            for batch in batches:
                n, ids_sha, bytes_sha = [], [], []
                for t in batch.column(1).to_pylist():
                    leaves = list(map(memo.__getitem__, codec.split(t or "")))
                    ids = " ".join([x[0] for x in leaves])
                    n.append(ids.count(" ") + bool(ids))
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(b"".join([x[1] for x in leaves])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                give_back()

        return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
