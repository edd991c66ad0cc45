"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import addresses, bpe, catalog_match, cooccurrence, packing, personal, scans, sentences
from quarrymill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_BASKETS = """
    WITH t AS (SELECT DISTINCT doc_id, sent_id, lower(trim(term)) AS item FROM tagged_tokens WHERE trim(term) <> ''),
         n AS (SELECT item, count(*) AS n FROM t GROUP BY 1),
         total AS (SELECT count(*) AS n_baskets FROM (SELECT DISTINCT doc_id, sent_id FROM t)),
         p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM t a JOIN t b USING (doc_id, sent_id) WHERE a.item < b.item GROUP BY 1, 2)
"""


@query(_BASKETS + """
    SELECT item_a, item_b FROM p JOIN n a ON a.item = item_a JOIN n b ON b.item = item_b, total
    WHERE n_ab >= 20 AND n_ab * n_baskets >= 6 * a.n * b.n
""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms sharing at least 20 sentences with a lift of at least 6."""
    return cooccurrence.pairs_together(table(spark, sf_dir, "tagged_tokens"), ["doc_id", "sent_id"], "term", 20, 6.0).select("item_a", "item_b")


@query(_BASKETS + """
    SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, n_baskets, round(n_ab * n_baskets / (a.n * b.n), 6) AS lift
    FROM p JOIN n a ON a.item = item_a JOIN n b ON b.item = item_b, total WHERE n_ab >= 5
""")
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts and lift of all pairs that share at least five sentences."""
    pairs = cooccurrence.pairs_together(table(spark, sf_dir, "tagged_tokens"), ["doc_id", "sent_id"], "term", 5)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


@query(_BASKETS + """
    SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, n_baskets, round(n_ab * n_baskets / (a.n * b.n), 6) AS lift
    FROM p JOIN n a ON a.item = item_a JOIN n b ON b.item = item_b, total
""")
def p3_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts and lift of all pairs that share a sentence."""
    pairs = cooccurrence.pairs_together(table(spark, sf_dir, "tagged_tokens"), ["doc_id", "sent_id"], "term", 1)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


@query()
def p3_surprising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose count under the configuration null is a discovery at a rate of one in a thousand."""
    pairs = cooccurrence.pairs_together(table(spark, sf_dir, "tagged_tokens"), ["doc_id", "sent_id"], "term", 1)
    return pairs.filter(F.col("q_value") <= 0.001)


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


@query()
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return packing.pack(bpe.token_counts(table(spark, sf_dir, "documents")), 2048)


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog term every keyword means, or -1."""
    return catalog_match.match_catalog(table(spark, sf_dir, "keywords"), table(spark, sf_dir, "terms"))


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of address records of the same place."""
    return addresses.same_place(table(spark, sf_dir, "addresses"))


@query()
def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place every address record denotes."""
    return addresses.places(table(spark, sf_dir, "addresses"))


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents that are no scans."""
    documents = table(spark, sf_dir, "documents").filter(F.col("origin") != "scan")
    return sentences.split_sentences(documents).select("doc_id", "start_pos", "end_pos").distinct()


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scans that are furniture, end in a cut word, or hold misread words."""
    return scans.line_findings(table(spark, sf_dir, "documents"))


@query()
def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans as continuous paragraphs."""
    return scans.repaired_text(table(spark, sf_dir, "documents"))


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email addresses, phone and identity numbers, street addresses and names in all documents."""
    return personal.find_personal(table(spark, sf_dir, "documents"))


@query()
def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with typed placeholders."""
    return personal.redact(table(spark, sf_dir, "documents"))
