"""Op 4: URL filters by a Bloom filter cascade.

Rules (host, path, action) become keys host + path. A url's keys are those of its host's suffixes that have as many labels as
some rule's host, each with the prefixes of its path that are as long as some rule's path; a rule fits the url if its key is one
of them. The key universe is all distinct keys of the table, written once. Level 1 of a cascade encodes the listed keys; level 2
the keys of the universe that pass level 1 and are not listed; level 3 the listed keys that pass level 2; and so on until a level
passes no key that it should not. A key of the universe is listed if and only if the number of levels it passes before failing
one is odd, so membership is exact, and a url is judged without a join. There is one cascade for each action; the longest listed
key decides, of equally long ones that of the longer host, and where none is listed the verdict is `allow`: the url is not in the lists.

Sizes follow the counts: with r listed keys of u in the universe, level 1 lets sqrt(1/2) r / u of the others pass, any later
level half. Only keys that pass level 1 are compared with the list, by an anti join, and looked at by later levels. Listed keys
are a parameter. False positives are counted and their bits combined where they are; the driver receives a filter in segments of
`SEGMENT` words, whose size is checked against MOST_BYTES (if more, level 1 is made larger until it fits).

Null urls and urls without `://` have an empty host and path, no keys, and verdict allow. Empty hosts have the empty suffix
only. Keys repeated over hot hosts are combined before the shuffle. Very long hosts and paths add no keys. Repeated rows give
repeated results; columns other than page_id and url are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches
from .text import mix, strings, word_hashes

#: Of one filter: what the driver holds and sends; words of 64 bits of it that one row has.
MOST_BYTES, SEGMENT = 64 << 20, 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashes(keys: pa.Array) -> np.ndarray:
    data, at = strings(keys)
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    out[full] = word_hashes(data, at[full], at[full + 1])
    return out


class Bloom:
    """A filter for n keys that lets a share `rate` of others pass."""

    def __init__(self, n: int, rate: float, level: int):
        self.m = 64 * math.ceil(max(n, 1) * math.log2(1 / rate) / math.log(2) / 64)
        self.k = max(1, round(math.log2(1 / rate)))
        self.seed = np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
        self.words = np.zeros(self.m // 64, np.uint64)

    def places(self, h: np.ndarray) -> np.ndarray:
        a = mix(h ^ self.seed)
        b = mix(a + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
        return (a[:, None] + np.arange(self.k, dtype=np.uint64) * b[:, None]) % np.uint64(self.m)

    def add(self, h: np.ndarray) -> None:
        p = self.places(h).ravel()
        np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        p = self.places(h)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    """Levels of filters; `passes` says how many levels in a row a key passes."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def passed(self, h: np.ndarray) -> np.ndarray:
        n, on = np.zeros(len(h), np.int64), np.ones(len(h), bool)
        for f in self.levels:
            on[on] = f.has(h[on])
            n += on
        return n

    def __contains__(self, key: str) -> bool:
        return bool(self.member(_hashes(pa.array([key])))[0])

    def member(self, h: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        n = self.passed(h)
        return np.where(n == len(self.levels), len(self.levels) % 2 == 1, n % 2 == 1)


def build(listed: list[str], universe: DataFrame, n_universe: int, key: str = "key", rate: float | None = None) -> Cascade:
    """A cascade for the listed keys over the distinct keys of `universe`, which is read once; `rate` is level 1's, by the counts if None."""
    spark, names = universe.sparkSession, sorted(set(listed))
    own = _hashes(pa.array(names, pa.string()))
    rate = min(0.5, math.sqrt(0.5) * max(len(own), 1) / max(n_universe, 1)) if rate is None else rate
    keys = universe.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())
    known = spark.createDataFrame([(k,) for k in names], "key string")
    while True:
        out, wrong_own = Cascade(), own
        rest = keys
        while True:
            level = Bloom(len(wrong_own), 0.5 if out.levels else rate, len(out.levels) + 1)
            level.add(wrong_own)
            out.levels.append(level)
            rest = _passing(rest, out)
            rest = materialize(rest if len(out.levels) > 1 else rest.join(known, "key", "left_anti"), "passing")
            n = rest.count()
            if not n:
                return out
            level = Bloom(n, 0.5, len(out.levels) + 1)
            if level.m // 8 > MOST_BYTES:
                break
            for segment, bits in _bits(rest, level).collect():  # at most m / 64 / SEGMENT rows
                level.words[segment * SEGMENT : (segment + 1) * SEGMENT] |= np.frombuffer(bits, np.uint64)[: len(level.words) - segment * SEGMENT]
            out.levels.append(level)
            wrong_own = own[out.passed(own) == len(out.levels)]
            if not len(wrong_own):
                return out
        rate /= 4


def _passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """The keys that pass all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(cascade.passed(_hashes(b.column(0))) == len(cascade.levels)))

    return keys.select("key").mapInArrow(run, "key string")


def _bits(keys: DataFrame, level: Bloom) -> DataFrame:
    """(segment, bits) of a filter of these keys: tasks combine their bits, then segments are combined."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = level.places(_hashes(b.column(0))).ravel()
            at, which = np.unique(p >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array((at // SEGMENT).astype(np.int64)), pa.array((at % SEGMENT).astype(np.int64)), pa.array(bits.view(np.int64))], ["segment", "word", "bits"])

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT, np.uint64)
        out[t.column("word").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
        return pa.table({"segment": [key[0].as_py()], "bits": pa.array([out.tobytes()], pa.binary())})

    each = keys.select("key").mapInArrow(words, "segment long, word long, bits long").groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    return each.groupBy("segment").applyInArrow(whole, "segment long, bits binary")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    some = F.coalesce(at, F.lit(0)) > 0
    return F.when(some, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(some, path).otherwise("")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict of each page under rules (host, path, 'allow' or 'block')."""
    if len({h + p for h, p, _ in rules}) != len(rules):
        raise ValueError("two rules have the same host and path")
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    small_batches(pages.sparkSession)
    lengths, sizes = sorted({len(p) for _, p, _ in rules}), sorted({h.count(".") + 1 for h, _, _ in rules}, reverse=True)
    suffixes = F.array_compact(F.array(*(F.when(F.size("labels") >= c, F.substring_index("host", ".", -c)) for c in sizes)))
    prefixes = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    rows = rows.withColumn("labels", F.split("host", r"\."))
    rows = rows.select("page_id", "host", "path", F.when((F.col("host") != "") | (F.col("path") != ""), keys).otherwise(F.array().cast("array<string>")).alias("keys"))
    universe = materialize(rows.select(F.explode("keys").alias("key")).distinct(), "keys")
    n_universe, actions = universe.count(), sorted({a for _, _, a in rules})
    cascades = [build([h + p for h, p, a in rules if a == action], universe, n_universe) for action in actions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(at[0], at[-1] - at[0])
            at = at - at[0]
            h = _hashes(flat)
            which = np.full(len(h), -1)
            for i, c in enumerate(cascades):
                which[c.member(h)] = i
            rule, verdict = [None] * b.num_rows, ["allow"] * b.num_rows
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            length: dict[int, int] = {}
            for j in np.flatnonzero(which >= 0):
                r, key = int(row[j]), flat[int(j)].as_py()
                if len(key) > length.get(r, -1):
                    length[r], rule[r], verdict[r] = len(key), key, actions[which[j]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
