"""Cleaning of texts line by line.

All operators take and give rows ``(doc_id, line_no, line)``; texts of at most two lines pass
unchanged. Counting copies is one window by document and line, joining cut lines a running count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T

BYPASS = 2


def to_lines(documents: DataFrame) -> DataFrame:
    """Lines of every text without empty ones at its end; null texts have none."""
    return documents.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(T.java_split(F.col("text"), "\n")).alias("line_no", "line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of lines joined in order."""
    gathered = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return gathered.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _keep(lines: DataFrame, condition: Column) -> DataFrame:
    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return lines.withColumn("_n", count).filter((F.col("_n") <= BYPASS) | condition).drop("_n")


def metrics(lines: DataFrame, min_length: int = 2) -> DataFrame:
    """``(doc_id, line_no, chars, dots, digits, blanks, terms, percent)``: counts of each line and its
    table-of-contents percentage; terms are counted once."""
    line = F.col("line")
    counted = lines.select(
        "doc_id", "line_no", F.length(line).cast("long").alias("chars"), T.count_matches(line, r"\.").alias("dots"), T.count_matches(line, r"\p{Nd}").alias("digits"), T.count_matches(line, " ").alias("blanks"),
        T.term_count(line, min_length).alias("terms"))
    return counted.withColumn("percent", T.contents_share(F.col("dots"), F.col("digits"), F.col("blanks"), F.col("terms")))


def drop_unimportant(lines: DataFrame, keepwords: list[str] | None = None, min_terms: int = 5, min_length: int = 2, keepword_xor: bool = True) -> DataFrame:
    """Drop blank lines, lines of digits, and lines that are short or else hold a keep-word, but
    not both. ``keepword_xor=False`` drops short lines without a keep-word only."""
    trimmed = lines.withColumn("line", T.java_trim(F.col("line")))
    short, word = T.term_count(F.col("line"), min_length) < min_terms, T.contains_keepword(F.col("line"), keepwords or [])
    unimportant = (short != word) if keepword_xor else (short & ~word)
    return _keep(trimmed, ~((F.col("line") == "") | T.only_digits(F.col("line")) | unimportant))


def drop_contents(lines: DataFrame, max_percent: int = 80, min_length: int = 2) -> DataFrame:
    """Drop lines that look like a table of contents."""
    return _keep(lines, T.contents_percent(F.col("line"), min_length) <= max_percent)


def drop_repeated(lines: DataFrame, keepwords: list[str] | None = None) -> DataFrame:
    """Drop all copies of lines that occur more than once in a text, unless they hold a keep-word."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "line"))
    counted = lines.withColumn("_copies", copies)
    return _keep(counted, (F.col("_copies") == 1) | T.contains_keepword(F.col("line"), keepwords or [])).drop("_copies")


def join_hyphenated(lines: DataFrame) -> DataFrame:
    """Join lines that end in a hyphen with the next line that does not, hyphens removed; what
    ends in a hyphen at the end of the text is dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    cut = T.ends_with_hyphen(F.col("line"))
    marked = lines.withColumn("_n", count).withColumn("_cut", cut & (F.col("_n") > BYPASS))
    closed = F.coalesce(F.sum(F.when(F.col("_cut"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = F.when(F.col("_cut"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    grouped = marked.withColumn("_group", closed).withColumn("_piece", piece).groupBy("doc_id", "_group").agg(
        F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "_piece"))).alias("p"), F.max(F.when(~F.col("_cut"), 1).otherwise(0)).alias("_ends"))
    return grouped.filter("_ends = 1").select("doc_id", "line_no", F.array_join(F.transform("p", lambda x: x["_piece"]), "").alias("line"))


def clean_documents(documents: DataFrame, keepwords: list[str] | None = None, min_terms: int = 5, min_length: int = 2, max_percent: int = 80) -> DataFrame:
    """``(doc_id, sentences)``: the whole-text pipeline, then the sentence splitter."""
    lines = drop_unimportant(to_lines(documents), keepwords, min_terms, min_length)
    lines = join_hyphenated(drop_repeated(drop_contents(lines, max_percent, min_length), keepwords))
    texts = from_lines(lines)
    return texts.select("doc_id", T.split_sentences(F.replace("text", F.lit("\r\n"), F.lit(" "))).alias("sentences"))


def similar_lines(lines: DataFrame, first: int = 10) -> DataFrame:
    """``(doc_id, line_no, similarity)``: how far each of the first lines is contained in others. Every
    line is taken apart once; the first lines of a text go to its lines as one array."""
    parts = [F.size("w").alias("n"), "w", F.array_join("w", " ").alias("told")]
    taken = lines.select("doc_id", "line_no", F.split(F.lower("line"), r"\s+").alias("w")).select("doc_id", "line_no", *parts)
    head = taken.filter(F.col("line_no") < first).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "n", "w", "told")).alias("head"))
    pairs = taken.withColumnRenamed("line_no", "other").join(head, "doc_id").select("doc_id", "other", "n", "w", "told", F.explode("head").alias("a")).filter(F.col("a.line_no") != F.col("other"))
    shorter = F.col("a.n") <= F.col("n")
    pairs = pairs.select("doc_id", "a.line_no", F.when(shorter, F.col("a.w")).otherwise(F.col("w")).alias("w"), F.when(shorter, F.col("told")).otherwise(F.col("a.told")).alias("told"), F.greatest("a.n", "n").alias("n"))
    share = F.ceil(F.size(F.filter("w", lambda x: F.contains(F.col("told"), x))) * F.lit(100.0) / F.col("n")).cast("int")
    return pairs.groupBy("doc_id", "line_no").agg(F.max(share).alias("similarity"))
