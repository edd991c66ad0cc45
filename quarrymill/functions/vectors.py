"""Vector columns: cosine similarity, nearest neighbours, analogies, training."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.tables import bounded_broadcast

#: Vectors of a block, on either side.
BLOCK = 4096
#: Queries are broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows without a vector are left out: ``(id, v)``."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())


def _pack(b: pd.DataFrame, block: int) -> pd.DataFrame:
    """Ids and vectors of one block as bytes."""
    return pd.DataFrame({"block": [block], "ids": [b["id"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(b["v"].to_numpy()).astype(np.float64).tobytes()]})


def _unit(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    m = np.frombuffer(vectors, np.float64).reshape(len(own), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return own, m / np.maximum(norm, 1e-300), norm[:, 0]


def _compared(vectors: DataFrame, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], id_col: str, vector_col: str, block: int) -> DataFrame:
    """What ``choose(query ids, own ids, similarities)`` takes of every block of queries against
    every block of rows; no rows are of a vector with itself or without length.

    Both sides are packed into blocks; each block of rows meets all blocks of queries. While the
    queries are bounded they are broadcast, so that the rows are read once and not shuffled; beyond,
    blocks of rows are shuffled once per block of queries. Nothing passes through the driver."""
    asked = _packed(queries, id_col, vector_col)
    n, size = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).collect()[0]
    blocks = -(-n // block) if n else 1
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = numbered.groupBy("block").applyInPandas(lambda key, b: _pack(b, int(key[0])), "block int, ids binary, vectors binary")
    packed = bounded_broadcast(packed.select("block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), n * (size or 0) * 8, BROADCAST_BYTES)

    def pack_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                yield _pack(b.iloc[at : at + BLOCK], 0)

    rows = _packed(vectors, id_col, vector_col).mapInPandas(pack_rows, "block int, ids binary, vectors binary")
    met = rows.select("ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(packed, "block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, q_vectors, ids, vectors in zip(b["q_ids"], b["q_vectors"], b["ids"], b["vectors"], strict=True):
                (asking, q, _), (own, m, norm) = _unit(q_ids, q_vectors), _unit(ids, vectors)
                sims = q @ m.T
                sims[:, norm == 0] = -np.inf
                sims[asking[:, None] == own[None, :]] = -np.inf
                yield choose(asking, own, np.round(sims, 6))

    return met.mapInPandas(compare, "query_id long, neighbour_id long, similarity double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(query_id, neighbour_id, similarity, rank)``: the ``k`` most similar rows of every query.

    Every block of rows keeps its best ``k``, a window picks the best of these. Ties go to the
    smaller id; a query is not its own neighbour; null vectors are left out.
    """

    def best(ids: np.ndarray, own: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        # all that reach the k-th greatest, then in order
        least = np.partition(sims, -k, axis=1)[:, -k] if k < sims.shape[1] else np.full(len(sims), -np.inf)
        i, j = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
        order = np.lexsort((own[j], -sims[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pd.DataFrame({"query_id": ids[i], "neighbour_id": own[j], "similarity": sims[i, j]})

    found = _compared(vectors, queries, best, id_col, vector_col, block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar(vectors: DataFrame, queries: DataFrame, percent: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(query_id, neighbour_id, similarity)``: every row whose similarity with a query, times
    100, exceeds ``percent``; compared like ``nearest``."""

    def above(ids: np.ndarray, own: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(np.isfinite(sims) & (sims * 100 > percent))
        return pd.DataFrame({"query_id": ids[i], "neighbour_id": own[j], "similarity": sims[i, j]})

    return _compared(vectors, queries, above, id_col, vector_col, block)


def analogy(vectors: DataFrame, plus: list[int], minus: list[int], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows nearest to the sum of the ``plus`` vectors without the ``minus`` vectors."""
    sign = F.when(F.col(id_col).isin(plus), F.lit(1.0)).otherwise(F.lit(-1.0))
    chosen = vectors.filter(F.col(id_col).isin(plus + minus)).select(sign.alias("s"), F.posexplode(vector_col).alias("i", "x"))
    target = chosen.groupBy("i").agg(F.sum(F.col("s") * F.col("x").cast("double")).alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("target"))
    rest = vectors.filter(~F.col(id_col).isin(plus + minus))
    scored = rest.join(F.broadcast(target)).select(id_col, F.round(cosine(F.col(vector_col), F.col("target")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def string_similarity(a: Column, b: Column) -> Column:
    """Share of characters that need no edit."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def train_word_vectors(sentences: DataFrame, tokens_col: str = "tokens", size: int = 100, min_count: int = 5, window: int = 5, seed: int = 42, iterations: int = 1, partitions: int = 4) -> Word2VecModel:
    """Skip-gram vectors with the usual defaults; one row per sentence."""
    return Word2Vec(vectorSize=size, minCount=min_count, windowSize=window, seed=seed, maxIter=iterations, numPartitions=partitions, inputCol=tokens_col, outputCol="vector").fit(sentences)


def word_vectors(model: Word2VecModel) -> DataFrame:
    """``(word, vector array<double>)``."""
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
