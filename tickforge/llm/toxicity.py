"""Op 3: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are runs without white space and ASCII punctuation, A-Z lower-cased. A word's input is a hashed word vector and the
mean of hashed vectors of its byte n-grams (3 to 5, with marks for both ends). Forward and backward GRUs read windows of
`WINDOW` words, `STRIDE` apart, so neighbours overlap by half and any `WINDOW - STRIDE + 1` neighbouring words stand whole in
one; attention pools a window's states; a text's score is that of its highest window. Training is multi-instance: each round takes the highest window of
every text under the present weights (and a random one of clean texts), as labels are of whole texts.

Labels are read only where crc32(doc_id as text) mod 3 is not 1. The fit uses a bounded sample of each class: the `rows` labelled
rows of the lowest hash and, of these in that order, whole texts as long as they fit in `chars` characters together. Scoring
covers all rows and whole texts.

Null and empty texts, and texts without words, score 0.0. A null doc_id is not held out. Null labels are left out; a
doc_id with several labels has the highest; a label's text is any one of its doc_id's rows. Without labels of both classes
every score is 0.0. An empty table gives an empty table. Long texts are read in slices of windows. Repeated rows get repeated scores; only doc_id and text are
read of `docs`, and other columns pass through `score` but for those of the results' names. No column but the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import APART, LOWER, forget, give_back, mix, slices, strings, word_hashes, words

WINDOW, STRIDE = 32, 16
#: Bounds of the sample that a network is fitted to, of each class: labelled rows, and characters of their texts.
ROWS, CHARS = 1500, 16_000_000
#: Windows that a forward pass reads at once, bytes of text whose windows are listed and whose words are hashed at once, and words whose n-grams are.
BATCH, SLICE, PIECE, PART = 4096, 2 << 20, 1 << 20, 1 << 13
THRESHOLD = 0.7
_WORDS, _GRAMS, _DW, _DC, _H, _A = 1 << 15, 1 << 16, 8, 12, 8, 8
_D = _DW + _DC


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the n-gram buckets of each word, one word after the other."""
    n = ends - starts + 2
    first = np.cumsum(n) - n
    total = int(n.sum())
    pos = np.arange(total) - np.repeat(first, n)
    src = np.clip(np.repeat(starts, n) + pos - 1, 0, max(len(data) - 1, 0))
    chars = data[src].astype(np.uint64) + np.uint64(2)
    chars[first] = 0
    chars[first + n - 1] = 1
    left = np.repeat(n, n) - pos
    out = np.zeros((total, 3), np.int64) - 1
    h = np.zeros(total, np.uint64)
    for k in range(min(5, total)):
        h[: total - k] = h[: total - k] * np.uint64(0x100000001B3) + chars[k:]
        if k >= 2:
            ok = left > k
            out[ok, k - 2] = (mix(h[ok] + np.uint64(k << 60)) % np.uint64(_GRAMS)).astype(np.int64)
    flat = out.ravel()
    keep = flat >= 0
    at = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([first, [total]]) * 3]
    return flat[keep], at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all windows of texts with so many words; texts without words have none."""
    k = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), k)
    j = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    return text, np.minimum(j * STRIDE, np.maximum(counts[text] - WINDOW, 0))


class Network:
    """Weights and both passes. Texts come as distinct words (buckets and n-grams) and windows of indices to them, -1 past the end."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.w = {"word": f(_WORDS, _DW, scale=0.05), "gram": f(_GRAMS, _DC, scale=0.3)}
        for d in "fb":
            self.w |= {f"W{d}": f(_D, 3 * _H, scale=0.3), f"U{d}": f(_H, 3 * _H, scale=0.3), f"b{d}": np.zeros(3 * _H, np.float32)}
        self.w |= {"Wa": f(2 * _H, _A, scale=0.3), "ba": np.zeros(_A, np.float32), "va": f(_A, scale=0.3), "wo": f(2 * _H, scale=0.3), "bo": np.full(1, -1.0, np.float32)}

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        chars = np.zeros((len(bucket), _DC), np.float32)
        if len(grams):
            has = np.flatnonzero(n)
            chars[has] = np.add.reduceat(self.w["gram"][grams], at[:-1][has], axis=0) / n[has, None]
        return np.concatenate([self.w["word"][bucket], chars], axis=1)

    def _read(self, x: np.ndarray, index: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """States at each place: (windows, places, _H). x is the words' input projected for direction d, with a last row for the end."""
        n, steps = index.shape
        U, h = self.w[f"U{d}"], np.zeros((n, _H), np.float32)
        out = np.empty((n, steps, _H), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, u = x[index[:, t]], h @ U
            zr = _sigmoid(g[:, : 2 * _H] + u[:, : 2 * _H])
            z, r, un = zr[:, :_H], zr[:, _H:], u[:, 2 * _H :]
            c = np.tanh(g[:, 2 * _H :] + r * un)
            on = (index[:, t] >= 0)[:, None]
            new = np.where(on, c + z * (h - c), h)
            if tape is not None:
                tape.append((t, h, z, r, un, c, on))
            h = new
            out[:, t] = h
        return out

    def forward(self, inputs: np.ndarray, index: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        states = []
        for d in "fb":
            x = np.vstack([inputs @ self.w[f"W{d}"] + self.w[f"b{d}"], np.zeros((1, 3 * _H), np.float32)])
            states.append(self._read(x, index, d, None if tape is None else tape.setdefault(d, [])))
        s = np.concatenate(states, axis=2)
        a = np.tanh(s @ self.w["Wa"] + self.w["ba"])
        e = np.where(index >= 0, a @ self.w["va"], np.float32(-1e9))
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", p, s)
        if tape is not None:
            tape |= {"s": s, "a": a, "p": p, "pooled": pooled}
        return pooled @ self.w["wo"] + self.w["bo"][0]

    def gradients(self, inputs: np.ndarray, index: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted mean cross entropy by weight, and by the words' inputs."""
        tape: dict = {}
        dl = ((_sigmoid(self.forward(inputs, index, tape)) - labels) * weight / weight.sum()).astype(np.float32)
        s, a, p, g = tape["s"], tape["a"], tape["p"], {}
        g["wo"], g["bo"] = tape["pooled"].T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * self.w["wo"]
        dp = np.einsum("nth,nh->nt", s, dpool)
        ds = p[:, :, None] * dpool[:, None]
        de = p * (dp - (p * dp).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", de, a)
        da = de[:, :, None] * self.w["va"] * (1 - a * a)
        g["Wa"], g["ba"] = np.einsum("nth,nta->ha", s, da), da.sum(axis=(0, 1))
        ds += da @ self.w["Wa"].T
        dx = np.zeros_like(inputs)
        for d, own in (("f", ds[:, :, :_H]), ("b", ds[:, :, _H:])):
            U, dh = self.w[f"U{d}"], np.zeros((len(index), _H), np.float32)
            dU, proj = np.zeros_like(U), np.zeros((len(inputs) + 1, 3 * _H), np.float32)
            for t, h, z, r, un, c, on in reversed(tape[d]):
                dh = dh + own[:, t]
                dn = np.where(on, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dg = np.concatenate([dn * (h - c) * z * (1 - z), dc * un * r * (1 - r), dc], axis=1)
                du = np.concatenate([dg[:, : 2 * _H], dc * r], axis=1)
                dU += h.T @ du
                dh = np.where(on, dn * z, dh) + du @ U.T
                np.add.at(proj, index[:, t], dg)
            proj = proj[:-1]
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU, inputs.T @ proj, proj.sum(axis=0)
            dx += proj @ self.w[f"W{d}"].T
        return g, dx


class Texts:
    """Texts as distinct words and windows."""

    def __init__(self, column: pa.Array):
        data, at = strings(column)
        data = LOWER[data]
        found, counts, i = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)], [np.zeros(0, np.int64)], 0
        while i < len(at) - 1:  # in pieces of whole texts, each reduced to its distinct words
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            starts, ends, first = words(data[at[i] : at[j]], at[i : j + 1] - at[i], APART)
            h, where, word = np.unique(word_hashes(data[at[i] : at[j]], starts, ends), return_index=True, return_inverse=True)
            found.append((h, starts[where] + at[i], ends[where] + at[i], word.astype(np.int32)))
            counts.append(np.diff(first))
            i = j
        each, starts, ends, inner = zip(*found, strict=True)
        h, where, place = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        parts = np.split(place.astype(np.int32), np.cumsum([len(x) for x in each])[:-1])
        self.word = np.concatenate([part[x] for part, x in zip(parts, inner, strict=True)])
        self.bucket = (h % np.uint64(_WORDS)).astype(np.int64)
        self.data, self.starts, self.ends = data, np.concatenate(starts)[where], np.concatenate(ends)[where]
        self.counts = np.concatenate(counts)
        first = np.concatenate([[0], np.cumsum(self.counts)])
        self.text, begin = spans(self.counts)
        self.begin, self.stop = begin + first[self.text], first[self.text + 1]

    def index(self, which: np.ndarray) -> np.ndarray:
        """Words of these windows, -1 past the end of a text."""
        place = self.begin[which, None] + np.arange(WINDOW)
        return np.where(place < self.stop[which, None], self.word[np.minimum(place, len(self.word) - 1)], -1)

    def inputs(self, net: Network) -> np.ndarray:
        out = np.empty((len(self.bucket), _D), np.float32)
        for i in range(0, len(out), PART):
            part = slice(i, i + PART)
            out[part] = net.inputs(self.bucket[part], *self.grams(part))
        return out

    def grams(self, part: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _grams(self.data, self.starts[part], self.ends[part])

    def logits(self, net: Network) -> np.ndarray:
        inputs, out = self.inputs(net), np.empty(len(self.begin), np.float32)
        for i in range(0, len(out), BATCH):
            which = np.arange(i, min(i + BATCH, len(out)))
            out[which] = net.forward(inputs, self.index(which))
        return out


def _distinct(text: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct text * size + value, of values in the order of their texts; in pieces of whole texts."""
    out, i = [np.zeros(0, np.int64)], 0
    while i < len(text):
        j = int(np.searchsorted(text, text[min(i + PIECE, len(text)) - 1], "right"))
        out.append(np.unique(text[i:j] * np.int64(size) + values[i:j]))
        i = j
    return np.concatenate(out)


def _log_odds(buckets: np.ndarray, text: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Of each bucket, how much more often texts of label 1 have it than others, shrunk where few texts do."""
    seen = _distinct(text, buckets, size)
    one = labels[seen // size] == 1
    n1, n0 = (np.bincount(seen[x] % size, minlength=size) for x in (one, ~one))
    odds = np.log((n1 + 0.3) / (labels.sum() + 0.6)) - np.log((n0 + 0.3) / ((1 - labels).sum() + 0.6))
    return odds * (n1 + n0) / (n1 + n0 + 3)


def _start(net: Network, t: Texts, labels: np.ndarray) -> np.ndarray:
    """Put log odds in the first place of the word and n-gram vectors; a first guess of each window, by its highest word."""
    text = np.repeat(np.arange(len(labels)), t.counts)
    net.w["word"][:, 0] = 0.5 * _log_odds(t.bucket[t.word], text, labels, _WORDS)
    pairs = _distinct(text, t.word, len(t.bucket))
    in_text, of_word = pairs // len(t.bucket), pairs % len(t.bucket)
    seen = np.zeros((2, _GRAMS))
    for label in (0, 1):
        mine = labels[in_text] == label
        times = np.bincount(of_word[mine], minlength=len(t.bucket))  # texts of this label that have the word
        for i in range(0, len(t.bucket), PART):
            part = slice(i, i + PART)
            grams, at = t.grams(part)
            seen[label] += np.bincount(grams, np.repeat(times[part], np.diff(at)), _GRAMS)
    n0, n1 = seen
    odds = np.log((n1 + 0.3) / (labels.sum() + 0.6)) - np.log((n0 + 0.3) / ((1 - labels).sum() + 0.6))
    net.w["gram"][:, 0] = odds * (n0 + n1) / (n0 + n1 + 3)
    x = t.inputs(net)
    guess = np.append(x[:, 0] + x[:, _DW], -np.inf)
    return np.concatenate([guess[t.index(np.arange(i, min(i + BATCH, len(t.begin))))].max(axis=1) for i in range(0, len(t.begin), BATCH)])


def fit(texts: list[str], labels: np.ndarray, steps: int = 200, seed: int = 3) -> Network:
    """A network for texts with labels 0 and 1."""
    net, r, t = Network(seed), np.random.default_rng(seed), Texts(pa.array(texts, pa.string()))
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    logits, step, seen = _start(net, t, labels), 0, 0
    while step < steps and len(logits):
        if step and step - seen >= steps // 5:
            logits, seen = t.logits(net), step
        order = r.permutation(len(t.begin))
        random = order[np.unique(t.text[order], return_index=True)[1]]
        by = np.lexsort((-logits, t.text))
        top = by[np.unique(t.text[by], return_index=True)[1]]
        chosen = r.permutation(np.concatenate([top, random[labels[t.text[random]] == 0]]))
        y = labels[t.text[chosen]].astype(np.float32)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
        for i in range(0, len(chosen), 128):
            which, step = chosen[i : i + 128], step + 1
            index = t.index(which)
            used, flat = np.unique(index, return_inverse=True)
            flat = flat.reshape(index.shape) - (used[0] == -1)
            used = used[used >= 0]
            grams, at = t.grams(used)
            n = np.diff(at)
            g, dx = net.gradients(net.inputs(t.bucket[used], grams, at), flat, y[i : i + 128], weight[i : i + 128])
            g["word"], g["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(g["word"], t.bucket[used], dx[:, :_DW])
            each = np.repeat(dx[:, _DW:] / np.maximum(n, 1)[:, None], n, axis=0)
            for k in range(_DC):
                g["gram"][:, k] = np.bincount(grams, each[:, k], _GRAMS)
            for k, v in net.w.items():
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] * g[k] - b)
                v -= (0.001 if k in ("word", "gram") else 0.02) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, place, label, text) of at most `rows` labelled texts of each class, none held out; place is their order. The driver sees their ids only."""
    known = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 != 1")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("__tx_label"))
    taken = [known.filter(F.col("__tx_label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect() for c in (0, 1)]
    ids = docs.sparkSession.createDataFrame([(x[0], i, x[1]) for part in taken for i, x in enumerate(part)] or [(None, 0, 0)], "doc_id long, __tx_place int, __tx_label int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # ids has at most 2 * rows rows
    return found.groupBy("doc_id").agg(F.first("__tx_place").alias("place"), F.first("__tx_label").alias("label"), F.min("text").alias("text"))


def _fitted(chars: int):
    """The weights of a network for sorted rows (doc_id, place, label, text); none if they aren't of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        texts, labels, left = [], [], {0: chars, 1: chars}
        for b in batches:
            for label, text in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py() or ""
                if len(text) <= left[label]:
                    left[label] -= len(text)
                    texts.append(text)
                    labels.append(label)
        if len(set(labels)) == 2:
            net = fit(texts, np.array(labels, np.int64))
            texts.clear()
            give_back()
            yield pa.RecordBatch.from_pydict({"name": pa.array(list(net.w)), "weights": pa.array([v.tobytes() for v in net.w.values()], pa.binary())})

    return run


def trained(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Network | None:
    """A network fitted by one task to the bounded sample; the driver receives its weights (4 MB). None without both classes."""
    dealt = sample(docs, labels, rows).repartition(1).sortWithinPartitions("label", "place")
    found = dealt.mapInArrow(_fitted(chars), "name string, weights binary").collect()
    if not found:
        return None
    net = Network()
    net.w |= {r["name"]: np.frombuffer(r["weights"], np.float32).reshape(net.w[r["name"]].shape) for r in found}
    return net


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """`docs` with held_out, score and predicted."""
    small_batches(docs.sparkSession)
    net = trained(docs, labels, rows, chars)
    docs = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, "text", SLICE):
            out = np.zeros(b.num_rows)
            if net is not None:
                t = Texts(b.column(b.schema.get_field_index("text")))
                best = np.full(b.num_rows, -np.inf)
                np.maximum.at(best, t.text, t.logits(net).astype(np.float64))
                out = np.where(np.isfinite(best), _sigmoid(best), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "score"])

    scored = docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
