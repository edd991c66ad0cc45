"""Co-occurrence graphs and TextRank per document.

Edges go from a term to each different term that follows it within a window, in sentences of at
least the window's size. Ranks of ordinary documents are computed by groups, sparse; documents with
more edges than one task should hold go through a loop of joins that gives the same numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.tables import staged

DAMPING = 0.85
#: Edges of a document up to which one task ranks it.
GROUP_EDGES = 2_000_000
#: Edges of a bucket of documents, about.
BUCKET_EDGES = 250_000


def edges(corpus: DataFrame, window: int = 5, min_terms: int = 0) -> DataFrame:
    """``(doc_id, src, dst, weight, ord)``; ``ord`` is where the edge is met first."""
    sents = corpus.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    sents = sents.select("doc_id", "sent_id", F.transform("t", lambda x: x["term"]).alias("t")).filter((F.size("t") >= window) & (F.size("t") >= min_terms))
    near = sents.select("doc_id", "sent_id", "t", F.posexplode("t").alias("i", "src"))
    near = near.select("doc_id", "sent_id", "i", "src", F.posexplode(F.slice("t", F.col("i") + 2, window - 1)).alias("d", "dst")).filter(F.col("src") != F.col("dst"))
    j = F.col("i") + F.col("d") + 1
    order = F.struct(F.col("sent_id"), F.greatest(F.lit(0), j - window + 1).alias("w"), F.col("i"), j.alias("j"))
    return near.groupBy("doc_id", "src", "dst").agg(F.min(order).alias("ord")).select("doc_id", "src", "dst", F.lit(1.0).alias("weight"), "ord")


def degrees(graph: DataFrame) -> DataFrame:
    """``(doc_id, src, degree)``."""
    return graph.groupBy("doc_id", "src").agg(F.sum("weight").alias("degree"))


def linked_terms(graph: DataFrame, max_links: int = 10) -> DataFrame:
    """``(doc_id, term, links_in, links_out)``: neighbours in the order they were met, at most
    ``max_links`` + 1 each way."""
    ends = F.array(F.struct(F.col("dst").alias("term"), F.lit(True).alias("into"), F.col("src").alias("other")), F.struct(F.col("src").alias("term"), F.lit(False).alias("into"), F.col("dst").alias("other")))
    met = graph.select("doc_id", "ord", F.explode(ends).alias("e")).select("doc_id", "e.term", "e.into", F.struct("ord", "e.other").alias("m"))
    links = lambda into, name: F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("into") == into, F.col("m")))), 1, max_links + 1), lambda x: x["other"]).alias(name)
    return met.groupBy("doc_id", "term").agg(links(True, "links_in"), links(False, "links_out"))


def _rank_many(pdf: pd.DataFrame, iterations: int, normalise: bool, direction: str) -> pd.DataFrame:
    """Ranks of all documents of a bucket at once: a vertex is a document with a term."""
    codes, words = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
    doc, docs = pd.factorize(pdf["doc_id"])
    vertices, at = np.unique(np.concatenate([doc, doc]).astype(np.int64) * len(words) + codes, return_inverse=True)
    s, d, n = at[: len(pdf)], at[len(pdf) :], len(vertices)
    home = vertices // len(words)
    degree = np.bincount(s, pdf["weight"].to_numpy(float), minlength=n)
    value = np.ones(n)
    into, out_of = (s, d) if direction == "out" else (d, s)
    share = 1.0 / (degree[s] if normalise or direction == "in" else np.ones(len(s)))
    for _ in range(iterations):
        value = (1 - DAMPING) + DAMPING * np.bincount(into, share * value[out_of], minlength=n)
        if normalise:
            value = value / np.sqrt(np.bincount(home, value * value))[home]
    return pd.DataFrame({"doc_id": docs[home], "term": np.asarray(words)[vertices % len(words)], "score": value})


def rank_by_groups(graph: DataFrame, iterations: int = 10, normalise: bool = True, direction: str = "out", buckets: int = 8) -> DataFrame:
    """Ranks of documents that fit into a task, many of them together in each of the buckets."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    doc_type = graph.schema["doc_id"].dataType.simpleString()
    return graph.select("doc_id", "src", "dst", "weight").groupBy(bucket.alias("bucket")).applyInPandas(lambda p: _rank_many(p, iterations, normalise, direction), f"doc_id {doc_type}, term string, score double")


def rank_by_joins(graph: DataFrame, iterations: int = 10, normalise: bool = True, direction: str = "out") -> DataFrame:
    """The same ranks for graphs of any size: a join and an aggregate per iteration."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    share = F.lit(1.0) / F.col("degree") if normalise or direction == "in" else F.lit(1.0)
    links = staged(graph.join(degrees(graph), ["doc_id", "src"]).select("doc_id", F.col(own).alias("own"), F.col(other).alias("other"), share.alias("share")), "links")
    terms = staged(graph.select("doc_id", F.explode(F.array("src", "dst")).alias("term")).distinct(), "terms")
    values = terms.withColumn("score", F.lit(1.0))
    for _ in range(iterations):
        got = links.join(values.withColumnRenamed("term", "other"), ["doc_id", "other"]).groupBy("doc_id", F.col("own").alias("term")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        values = terms.join(got, ["doc_id", "term"], "left").select("doc_id", "term", (F.lit(1 - DAMPING) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"))
        if normalise:
            norms = values.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
            values = values.join(norms, "doc_id").select("doc_id", "term", (F.col("score") / F.col("norm")).alias("score"))
        values = staged(values, "ranks")
    return values


def textrank(corpus: DataFrame, window: int = 5, iterations: int = 10, normalise: bool = True, tags: tuple[str, ...] | None = None, direction: str = "out", group_edges: int = GROUP_EDGES) -> DataFrame:
    """``(doc_id, term, score)``. ``direction='out'`` sums over followers divided by the own
    degree, ``'in'`` over predecessors divided by theirs. ``normalise`` divides by degrees and
    keeps each document's scores at length one."""
    if tags is not None:
        corpus = corpus.filter(F.col("pos_tag").isin(*tags))
    graph = staged(edges(corpus, window).drop("ord"), "edges")
    sizes = graph.groupBy("doc_id").count()
    total, most = (x or 0 for x in sizes.agg(F.sum("count"), F.max("count")).collect()[0])
    buckets = max(1, total // BUCKET_EDGES + 1)
    if most <= group_edges:
        return rank_by_groups(graph, iterations, normalise, direction, buckets)
    large = staged(sizes.filter(F.col("count") > group_edges).select("doc_id"), "large")
    small = graph.join(large, "doc_id", "left_anti")
    return rank_by_groups(small, iterations, normalise, direction, buckets).unionByName(rank_by_joins(graph.join(large, "doc_id", "left_semi"), iterations, normalise, direction))
