"""Op 7: mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is target weight * documents / documents of the source. Every document draws its count
from a Poisson distribution of that mean by inverting it at a uniform number that is a hash of the seed and doc_id, so the
draw needs no state and is the same in every run. A mean above `MEAN_MOST` is cut to equal parts of at most that mean, and the
count is the sum of a draw of each part, by hashes of the seed, doc_id and the part: a Poisson count of the whole mean, however
large. Documents are exploded by their counts, and copies are dealt to partitions and sorted there by a hash of seed, doc_id and
copy: a global shuffle.

Weights are a parameter (source to weight, any scale); sources that it doesn't name share `other` each; without weights each
source has the weight of its count to the power `alpha`. A null source is a source. Rows with a null doc_id draw by "null";
repeated rows draw the same count each. Empty and very long texts are rows as any other. No column but doc_id and source is
read; other columns pass through. An empty table gives no rows. A source's documents need not be together in one task: counts
are combined before the shuffle, and the few rates are broadcast only if there are at most `MOST_SOURCES`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of sources: rates that are broadcast have at most this many rows (under 40 MB).
MOST_SOURCES = 50_000
#: Places of each source's table of cumulative probabilities, and the largest mean of one draw (2e-15 of its mass is past the table).
PLACES, MEAN_MOST = 64, 20.0
#: Copies of a document that one array lists.
RUN = 1 << 16


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) with 52 bits: the first 13 digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 0.0, alpha: float = 0.5, size: float = 1.0) -> DataFrame:
    """(__mx_source, __mx_rate, __mx_parts, __mx_cdf) of each source, the table being of one part's mean; the mean size of the mix is `size` times that of the input."""
    counts = docs.groupBy(F.col("source").alias("__mx_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        weight = F.coalesce(*(F.when(F.col("__mx_source") == k, F.lit(float(v))) for k, v in weights.items()), F.lit(float(other)))
    counts = counts.withColumn("w", weight)
    total = counts.agg(F.sum("n").alias("docs"), F.sum("w").alias("weights"))
    rate = F.col("w") / F.col("weights") * F.col("docs") / F.col("n") * F.lit(float(size))
    out = counts.crossJoin(F.broadcast(total)).select("__mx_source", F.coalesce(F.when(F.col("weights") > 0, rate), F.lit(0.0)).alias("__mx_rate"))  # total is one row
    out = out.withColumn("__mx_parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("__mx_rate") / F.lit(MEAN_MOST))))
    mean = F.col("__mx_rate") / F.col("__mx_parts")
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(PLACES)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
        lambda s: s["c"],
    )
    return out.withColumn("__mx_cdf", cdf)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 0.0, alpha: float = 0.5, size: float = 1.0, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """The columns of `docs`, and `copy` (from 0), `n_copies` and `place` (the order of the mix, in [0, 1)); a column of one of these names is replaced."""
    made = rates(docs, weights, other, alpha, size)
    made = F.broadcast(made) if made.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else made
    joined = docs.drop("copy", "n_copies", "place").join(made, F.col("source").eqNullSafe(F.col("__mx_source")))
    below = lambda u: F.size(F.filter("__mx_cdf", lambda c: c <= u)).cast("long")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__mx_parts") - 1), lambda i: uniform(seed, "doc_id", i))
    many = F.aggregate(parts, F.lit(0).cast("long"), lambda s, u: s + below(u))
    drawn = joined.withColumn("__mx_u", uniform(seed, "doc_id")).withColumn("n_copies", F.when(F.col("__mx_parts") == 1, below(F.col("__mx_u"))).otherwise(many))
    drawn = drawn.drop("__mx_source", "__mx_rate", "__mx_parts", "__mx_cdf", "__mx_u").filter("n_copies > 0")
    runs = drawn.withColumn("__mx_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_copies - 1) div {RUN}"))))
    first = F.col("__mx_run") * RUN
    copies = runs.withColumn("copy", F.explode(F.sequence(first, F.least(first + RUN, F.col("n_copies")) - 1))).drop("__mx_run")
    placed = copies.withColumn("place", uniform(seed + 1, "doc_id", "copy"))
    dealt = placed.repartition(partitions, "place") if partitions else placed.repartition("place")
    return dealt.sortWithinPartitions("place")
