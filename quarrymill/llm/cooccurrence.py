"""Items that appear together in baskets, and how much more often than chance.

Pair counts are exact. Chance is a bipartite configuration model: a basket of a given size and an
item of a given frequency meet with probability ``x*y / (1 + x*y)``, the factors fitted so that
item frequencies and basket sizes are kept on average. The number of baskets two items share is
then Poisson-binomial; its upper tail comes from the saddlepoint approximation over the classes
of equal basket size, and a false-discovery rate over all pairs of items from the tails.

Items are numbered once, when they are counted; names are joined back to the pairs that remain.
Pairs that cannot reach the asked count or lift are dropped before any pair is made: a pair's count
is at most its rarer item's, and its lift at most baskets / the more frequent item's count, so the
limit on single items loses no pair. A basket of many items is cut into blocks, and pairs of blocks
are shuffled, so that no task holds a wide basket's pairs. Null and blank items are ignored, an item
counts once per basket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.tables import bounded_broadcast, staged

#: The table of items is broadcast up to this many bytes, joined by shuffle beyond.
BROADCAST_BYTES = 48 << 20
#: Baskets with more items than this are cut into blocks of about this many.
WIDE_BASKET = 200
#: Matrices of the null model have at most this many cells at a time.
CELLS = 2_000_000
#: Item counts above this are grouped in steps of 0.1 % when the null model is fitted.
EXACT_COUNTS = 2_000


def normal_item(c: Column) -> Column:
    """``lower(trim(item))``; null if blank."""
    low = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(F.length(low) > 0, low)


class ConfigurationNull:
    """Factors of the bipartite configuration model by class of item count and basket size."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 500, close: float = 1e-9):
        self.sizes, self.baskets = sizes.astype(float), baskets.astype(float)
        total = max(1.0, float((counts * weights).sum()))
        x, y = counts / np.sqrt(total), self.sizes / np.sqrt(total)
        at = [slice(i, i + self.step) for i in range(0, len(counts), self.step)]
        for self.rounds in range(1, rounds + 1):
            x = np.concatenate([counts[k] / np.maximum((self.baskets * y / (1 + np.outer(x[k], y))).sum(1), 1e-300) for k in at])
            new = self.sizes / np.maximum(sum(((weights[k] * x[k])[:, None] / (1 + np.outer(x[k], y))).sum(0) for k in at), 1e-300)
            change, y = float(np.abs(new / y - 1).max()), new
            if change < close:
                break
        self.log_counts, self.log_x, self.y = np.log(counts.astype(float)), np.log(x), y

    @property
    def step(self) -> int:
        """Rows of a matrix with a column per basket size."""
        return max(1, CELLS // max(1, len(self.sizes)))

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Of an item of each count, in a basket of each size: the item's factor is solved for its
        own count, whatever class it was fitted in."""
        log_x = np.interp(np.log(counts), self.log_counts, self.log_x)
        for _ in range(4):
            p = np.outer(np.exp(log_x), self.y)
            p /= 1 + p
            got = (self.baskets * p).sum(1)
            log_x += np.clip((counts - got) / np.maximum((self.baskets * p * (1 - p)).sum(1), 1e-300), -1, 1)
        p = np.outer(np.exp(log_x), self.y)
        return p / (1 + p)

    def expected_and_tail(self, n_a: np.ndarray, n_b: np.ndarray, n_ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected shared baskets, and -log10 of the probability of at least ``n_ab``."""
        q = np.clip(self.probabilities(n_a) * self.probabilities(n_b), 1e-300, 1 - 1e-12)
        m, k = self.baskets, n_ab - 0.5  # continuity correction
        mean = (m * q).sum(1)
        t = np.log(np.maximum(k, 1e-9) / mean)
        for _ in range(30):
            e = q * np.exp(np.clip(t, -60, 60))[:, None]
            p = e / (1 - q + e)
            slope, curve = (m * p).sum(1), np.maximum((m * p * (1 - p)).sum(1), 1e-300)
            t = t - np.clip((slope - k) / curve, -2, 2)
        e = q * np.exp(np.clip(t, -60, 60))[:, None]
        p = e / (1 - q + e)
        curve = np.maximum((m * p * (1 - p)).sum(1), 1e-300)
        gap = np.maximum(t * k - (m * np.log1p(q * np.expm1(np.clip(t, -60, 60))[:, None])).sum(1), 0)
        # upper tail for t > 0 in logs; else the plain normal approximation of a tail near one
        lam = np.abs(2 * np.sinh(np.clip(t, -60, 60) / 2)) * np.sqrt(curve)
        log_tail = -gap - np.log(np.maximum(lam, 1e-9) + 1.2) - 0.5 * np.log(2 * np.pi) + 0.2
        return mean, np.where(t > 0, np.maximum(0, -log_tail / np.log(10)), 0.0)


def _fit(items: DataFrame, by_size: pd.DataFrame) -> ConfigurationNull | None:
    """Fit over classes: distinct basket sizes, and item counts (binned beyond EXACT_COUNTS)."""
    n = F.col("n").cast("double")
    binned = F.when(n <= EXACT_COUNTS, n).otherwise(F.exp(F.floor(F.log(n) * 1000) / 1000))
    by_count = items.groupBy(binned.alias("c")).agg(F.avg("n").alias("n"), F.count(F.lit(1)).alias("w")).orderBy("n").toPandas()
    if by_count.empty or by_size.empty:
        return None
    return ConfigurationNull(by_count["n"].to_numpy(float), by_count["w"].to_numpy(float), by_size["s"].to_numpy(float), by_size["m"].to_numpy(float))


def _pairs(kept: DataFrame, widest: int) -> DataFrame:
    """``(a, b)``, a < b, once per basket, of the ``(basket, id)`` rows of ``kept``."""
    inner = lambda df: df.select("ids", F.posexplode("ids").alias("i", "a")).filter(F.col("i") + 1 < F.size("ids")).select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    if widest <= WIDE_BASKET:
        return inner(kept.groupBy("basket").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    wide = staged(kept.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE_BASKET).select("basket", F.ceil(F.col("n") / WIDE_BASKET).cast("int").alias("blocks")), "wide")
    cut = kept.join(wide, "basket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = cut.groupBy("basket", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    blocks = staged(blocks, "blocks")
    several = blocks.filter("blocks > 1")
    left = several.select("basket", F.col("ids").alias("ids_i"), F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("j")).filter("i < j")
    right = several.select("basket", F.col("ids").alias("ids_j"), F.col("k").alias("j"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).filter("i < j")
    across = left.join(right, ["basket", "i", "j"]).select("ids_j", F.explode("ids_i").alias("x")).select("x", F.explode("ids_j").alias("y"))
    return inner(blocks).unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def pairs_together(tokens: DataFrame, basket: list[str], item: str, min_count: int = 20, min_lift: float = 0.0) -> DataFrame:
    """``item_a < item_b`` (code points), ``n_ab, n_a, n_b, n_baskets, lift, expected,
    neg_log10_p, q_value`` for all pairs that share at least ``min_count`` baskets and reach
    ``min_lift``. Baskets with a null key column count like others; no rows give no pairs."""
    spark = tokens.sparkSession
    # a basket is a struct of its keys, in which nulls are equal
    member = tokens.select(F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(basket)]).alias("basket"), normal_item(F.col(item)).alias("item")).filter(F.col("item").isNotNull())
    member = staged(member.distinct(), "members")
    items = staged(member.groupBy("item").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("id"), "item", "n"), "items")
    n_items, n_bytes = (x or 0 for x in items.agg(F.count(F.lit(1)), F.sum(F.octet_length("item") + 48)).collect()[0])
    by_size = member.groupBy("basket").agg(F.count(F.lit(1)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).orderBy("s").toPandas()
    n_baskets, widest = int(by_size["m"].sum()), int(by_size["s"].max() if len(by_size) else 0)
    null = _fit(items, by_size)

    able = items.filter((F.col("n") >= min_count) & (F.col("n") * F.lit(float(min_lift)) <= n_baskets))
    kept = member.join(bounded_broadcast(able.select("item", "id"), n_bytes, BROADCAST_BYTES), "item").select("basket", "id")
    counted = _pairs(kept, widest).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= min_count)

    side = lambda p: bounded_broadcast(items.select(F.col("id").alias(p), F.col("n").alias(f"n_{p}")), n_items * 40, BROADCAST_BYTES)
    counted = counted.join(side("a"), "a").join(side("b"), "b")
    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b").cast("double"))
    counted = counted.withColumn("lift", lift).filter(F.col("n_ab") * F.lit(n_baskets).cast("decimal(20,0)") >= F.lit(min_lift).cast("decimal(10,4)") * F.col("n_a") * F.col("n_b"))

    def surprise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), null.step):
                c = b.iloc[at : at + null.step].copy()
                # equal counts have equal tails, whichever item comes first
                counts = np.column_stack([np.minimum(c["n_a"], c["n_b"]), np.maximum(c["n_a"], c["n_b"]), c["n_ab"]])
                kinds, of = np.unique(counts, axis=0, return_inverse=True)
                expected, tail = null.expected_and_tail(*kinds.astype(float).T)
                c["expected"], c["neg_log10_p"] = expected[of.ravel()], tail[of.ravel()]
                yield c

    schema = "a long, b long, n_ab long, n_a long, n_b long, lift double, expected double, neg_log10_p double"
    columns = [c.split()[0] for c in schema.split(", ")]
    scored = staged(counted.select(*columns[:6]).mapInPandas(surprise, schema) if null else spark.createDataFrame([], schema), "pairs")

    # q-values: tails in bins of a twentieth of a power of ten, at most a few thousand of them
    tested = max(1.0, n_items * (n_items - 1) / 2)
    bin_ = F.floor(F.least(F.col("neg_log10_p"), F.lit(400.0)) * 20).cast("int")
    bins = scored.groupBy(bin_.alias("bin")).count().toPandas().sort_values("bin", ascending=False)
    q = np.minimum.accumulate((np.minimum(1.0, tested * 10.0 ** (-bins["bin"].to_numpy(float) / 20) / np.maximum(1, bins["count"].cumsum())))[::-1])[::-1] if len(bins) else []
    q_table = spark.createDataFrame(pd.DataFrame({"bin": bins["bin"].astype("int32"), "q_value": np.asarray(q, dtype=float)}), "bin int, q_value double") if len(bins) else spark.createDataFrame([], "bin int, q_value double")
    scored = scored.withColumn("bin", bin_).join(F.broadcast(q_table), "bin")

    name = lambda p: bounded_broadcast(items.select(F.col("id").alias(p), F.col("item").alias(f"item_{p}")), n_bytes, BROADCAST_BYTES)
    out = scored.join(name("a"), "a").join(name("b"), "b")
    flip = F.col("item_a") > F.col("item_b")
    pick = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
    return out.select(
        pick("item_b", "item_a").alias("item_a"), pick("item_a", "item_b").alias("item_b"), "n_ab", pick("n_b", "n_a").alias("n_a"), pick("n_a", "n_b").alias("n_b"),
        F.lit(n_baskets).cast("long").alias("n_baskets"), "lift", "expected", "neg_log10_p", "q_value",
    )
