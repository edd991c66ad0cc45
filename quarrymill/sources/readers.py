"""Sources: files, catalogs, dumps, word lists, articles, settings and the work queue."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Input schemas.
TERMS = "type string, term string, morphem string, isCore boolean, ontologies array<string>"
LAND_USE = "type string, name string, categorie string, code int"
ARTICLES = "id int, revid int, url string, title string, text string"
CATALOG = "type string, term string, morphem string, isCore boolean, ontologies array<string>, name string, categorie string, code int"
BATCH = 350


def files(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the files of a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


#: Contents longer than this are not read, and so many are read at a time by a task.
LARGEST, AT_A_TIME = 256 << 20, 8


def fetch(uris: DataFrame, uri_col: str = "uri", timeout: float = 30.0, largest: int = LARGEST) -> DataFrame:
    """Adds ``content``: bytes behind each URI, null where it can't be read (also null URIs) or is
    longer than ``largest``. Paths must be of a folder that all executors share; for many files of
    one folder use ``files``."""

    def one(uri: str | None) -> bytes | None:
        try:
            local = urlparse(uri).scheme in ("", "file")
            with open(urlparse(uri).path, "rb") if local else urlopen(uri, timeout=timeout) as source:
                got = source.read(largest + 1)
            return got if len(got) <= largest else None
        except Exception:  # any failure marks the document as unreadable
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            for b in batches:
                for at in range(0, len(b), AT_A_TIME):
                    part = b.iloc[at : at + AT_A_TIME]
                    yield part.assign(content=list(pool.map(one, part[uri_col])))

    return uris.mapInPandas(read, uris.schema.simpleString()[7:-1] + ",content:binary")


def html_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and tags out, common entities resolved, white space joined."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def html_title(html: Column) -> Column:
    """Title of HTML, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def _with_own(meta: Column, name: Column, title: Column) -> Column:
    """Metadata with file name and title, which stand before equal keys."""
    rest = F.map_filter(meta, lambda k, _: ~k.isin("name", "title"))
    return F.map_concat(F.create_map(F.lit("name"), name, F.lit("title"), title), rest)


def parse(content: DataFrame, parser: Callable[[bytes, str], tuple[str, dict[str, str]]] | None = None) -> DataFrame:
    """Adds ``text`` and ``meta`` to ``(path, content)``. Without a parser, HTML and plain text in
    UTF-8 are read inside the JVM; a parser is called by batches and its failures give null."""
    name = F.element_at(F.split("path", "/"), -1)
    if parser is None:
        decoded = F.decode("content", "UTF-8")
        is_html = F.lower("path").rlike(r"\.x?html?$") | decoded.rlike(r"(?is)^\s*<(!doctype html|html)")
        title = F.coalesce(F.when(is_html, html_title(decoded)), name)
        return content.withColumn("text", F.when(is_html, html_text(decoded)).otherwise(decoded)).withColumn("meta", _with_own(html_metadata(F.when(is_html, decoded).otherwise(F.lit(""))), name, title))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw, path in zip(b["content"], b["path"], strict=True):
                try:
                    out.append(parser(raw, path))
                except Exception:  # a broken document must not stop the others
                    out.append((None, {}))
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in out], "meta": [m for _, m in out]})

    return content.select("path", "content").mapInPandas(call, "path string, text string, meta map<string,string>")


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms and land-use classes of a JSON array, told apart by ``type``; unknown fields ignored."""
    rows = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    terms = rows.filter(F.col("type") == "Term").select("term", "morphem", F.col("isCore").alias("iscore"), "ontologies")
    return terms, rows.filter(F.col("type") == "ALKIS").select("name", "categorie", "code")


def articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLES).option("multiLine", True).json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Different words of a file with one per line (either line end), comments left out."""
    word = F.trim(F.regexp_replace("value", "\r", ""))
    return spark.read.text(path).select(word.alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def gazetteer_dump(spark: SparkSession, path: str) -> DataFrame:
    """Columns 0, 1, 3, 4, 5 and 7 of a 19-column tab-separated dump, synonyms as array."""
    schema = ", ".join(f"c{i} string" for i in range(19))
    raw = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)
    return raw.select(
        F.col("c0").try_cast("long").alias("id"), F.col("c1").alias("name"), F.array_distinct(F.filter(F.split(F.coalesce("c3", F.lit("")), ","), lambda s: s != "")).alias("synonyms"),
        F.col("c4").try_cast("double").alias("latitude"), F.col("c5").try_cast("double").alias("longitude"), F.col("c7").alias("feature_code"))


def zip_entry(content: DataFrame, entry: str) -> DataFrame:
    """``content`` of archives ``(…, content)`` replaced by that of the named entry; null where the
    archive is broken or lacks it."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for raw in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        got.append(z.read(entry))
                except Exception:  # a broken archive is like a missing one
                    got.append(None)
            yield b.assign(content=got)

    return content.mapInPandas(unpack, content.schema)


def gazetteer_archive(spark: SparkSession, uri: str, entry: str, folder: str) -> DataFrame:
    """The dump inside a zip archive behind a URI: fetched, unpacked into ``folder``, which all
    executors share, and read like a dump. An unreadable archive or a missing entry is an error."""
    got = zip_entry(fetch(spark.createDataFrame([(uri,)], "uri string")), entry).select(F.decode("content", "UTF-8").alias("value")).filter(F.col("value").isNotNull())
    got.write.mode("overwrite").text(folder)
    if not any(True for _ in spark.read.text(folder).limit(1).toLocalIterator()):
        raise ValueError(f"no entry {entry} behind {uri}")
    return gazetteer_dump(spark, folder)


def html_metadata(html: Column) -> Column:
    """Map of the named meta elements of HTML, names in lower case; of equal names the first."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    attribute = lambda tag, a: F.regexp_extract(tag, rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    named = F.filter(F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "(?:name|property)")).alias("k"), attribute(t, "content").alias("v"))), lambda e: e["k"] != "")
    first = F.filter(named, lambda e, i: F.array_position(F.transform(named, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def work_queue(documents: DataFrame, done: DataFrame, batch: int = BATCH) -> DataFrame:
    """Ids of the first documents by id that are not done yet; the batch size is the feature."""
    return documents.select("doc_id").join(done.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(batch)


def distinct_names(table: DataFrame, name_col: str) -> DataFrame:
    return table.filter(F.col(name_col).isNotNull()).select(name_col).distinct().orderBy(name_col)
