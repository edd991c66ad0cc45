"""Results as a property graph: nodes ``(label, key, props)``, edges ``(src_label, src_key, type,
dst_label, dst_key, weight, text_passages)``, each with its reverse where there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.tables import exists

CONTAINS, AFFECT, BELONGS = "contains", "affect", "belongsTo"
EDGE = "src_label string, src_key string, type string, dst_label string, dst_key string, weight double, text_passages array<string>"


def clean_keys(props: Column) -> Column:
    """Property names without hyphens, colons and blanks."""
    return F.transform_keys(props, lambda k, _: F.regexp_replace(k, "[-: ]", ""))


def nodes(df: DataFrame, label: str, key: Column, **props: Column) -> DataFrame:
    """One node per key; of several rows the smallest properties stay."""
    present = [x for name, c in props.items() for x in (F.lit(name), c.cast("string"))]
    rows = df.select(F.lit(label).alias("label"), key.cast("string").alias("key"), F.array(*present).cast("array<string>").alias("p")).filter(F.col("key").isNotNull())
    first = rows.groupBy("label", "key").agg(F.min("p").alias("p"))
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("p") / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.get(F.col("p"), i * 2).alias("k"), F.get(F.col("p"), i * 2 + 1).alias("v"))), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    return first.select("label", "key", clean_keys(F.map_from_entries(pairs)).alias("props"))


def edges(df: DataFrame, src: tuple[str, Column], dst: tuple[str, Column], kind: str, back: str | None = None, weight: Column | None = None, passages: Column | None = None) -> DataFrame:
    """Edges of a kind, each once, and with ``back`` the reverse ones."""
    w, p = (weight if weight is not None else F.lit(None)).cast("double").alias("weight"), (passages if passages is not None else F.lit(None)).cast("array<string>").alias("text_passages")
    forward = df.select(F.lit(src[0]).alias("src_label"), src[1].cast("string").alias("src_key"), F.lit(kind).alias("type"), F.lit(dst[0]).alias("dst_label"), dst[1].cast("string").alias("dst_key"), w, p)
    forward = forward.filter(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull()).groupBy("src_label", "src_key", "type", "dst_label", "dst_key").agg(F.min("weight").alias("weight"), F.min("text_passages").alias("text_passages"))
    if back is None:
        return forward
    reverse = forward.select(F.col("dst_label").alias("src_label"), F.col("dst_key").alias("src_key"), F.lit(back).alias("type"), F.col("src_label").alias("dst_label"), F.col("src_key").alias("dst_key"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("array<string>").alias("text_passages"))
    return forward.unionByName(reverse)


def missing_edges(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("src_label", "src_key", "type", "dst_label", "dst_key"), ["src_label", "src_key", "type", "dst_label", "dst_key"], "left_anti")


def keyword_graph(documents: DataFrame, keywords: DataFrame, catalog: DataFrame, passages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents, their keywords, catalog terms and ontologies."""
    found = keywords if passages is None else keywords.join(passages.select("doc_id", F.col("word").alias("term"), "passages"), ["doc_id", "term"], "left")
    entries = catalog.join(keywords.select("term").distinct(), "term", "left_semi")
    onto = entries.select("term", F.explode("ontologies").alias("ontology"))
    mapped = keywords.select("doc_id", "term").join(entries.select("term"), "term")
    all_nodes = [
        nodes(documents, "Document", F.col("doc_id"), name=F.col("name"), author=F.coalesce("author", F.lit("unknown")), uri=F.col("uri")), nodes(keywords, "Keyword", F.col("term"), name=F.col("term")),
        nodes(entries, "Term", F.col("term"), name=F.col("term"), morphem=F.col("morphem"), iscore=F.col("iscore")), nodes(onto, "Ontology", F.col("ontology"), name=F.col("ontology")),
    ]
    doc, key, term, ontology = ("Document", F.col("doc_id")), ("Keyword", F.col("term")), ("Term", F.col("term")), ("Ontology", F.col("ontology"))
    all_edges = [
        edges(found, doc, key, CONTAINS, AFFECT, F.col("score"), F.col("passages") if passages is not None else None), edges(mapped, term, doc, AFFECT, CONTAINS), edges(mapped, key, term, BELONGS),
        edges(mapped.join(onto, "term"), doc, ontology, BELONGS, AFFECT),
    ]
    return reduce(DataFrame.unionByName, all_nodes), reduce(DataFrame.unionByName, all_edges)


def address_key() -> Column:
    """Natural key of an address: its feature id, else street with number and suffix."""
    part = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.coalesce(part("feature_id"), F.concat_ws(" ", part("strnam"), F.concat_ws("", part("hausnr"), part("hausnrz"))))


def location_key() -> Column:
    """Natural key of a location: its name at its place, to a millionth of a degree."""
    return F.concat_ws("|", F.col("name"), *[F.when(F.col(c).isNotNull(), F.lower(F.format_string("%.6f", F.col(c)))) for c in ("latitude", "longitude")])


def place_graph(addresses: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of addresses ``(doc_id, feature_id, strnam, hausnr, hausnrz, bez_name)`` and
    locations ``(doc_id, name, latitude, longitude, feature_code)`` found in documents, both with
    ``passages`` where there are some. Places without a name have no node."""
    a = addresses.filter(F.col("strnam").isNotNull()).withColumn("key", address_key())
    b = locations.filter(F.col("name").isNotNull()).withColumn("key", location_key())
    all_nodes = nodes(a, "Address", F.col("key"), name=F.col("strnam"), hausnr=F.col("hausnr"), hausnrz=F.col("hausnrz"), bez_name=F.col("bez_name"), feature_id=F.col("feature_id")).unionByName(
        nodes(b, "Location", F.col("key"), name=F.col("name"), latitude=F.col("latitude"), longitude=F.col("longitude"), feature_code=F.col("feature_code")))
    told = lambda df: "passages" if "passages" in df.columns else None
    return all_nodes, place_edges(a, "Address", "key", told(a)).unionByName(place_edges(b, "Location", "key", told(b)))


def land_use_graph(documents_classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of land-use classes ``(doc_id, term, name, categorie, code)`` that keywords
    of documents belong to."""
    found = documents_classes.filter(F.col("name").isNotNull())
    doc, entry = ("Document", F.col("doc_id")), ("ALKIS", F.col("name"))
    made = nodes(found, "ALKIS", F.col("name"), name=F.col("name"), categorie=F.col("categorie"), code=F.col("code"))
    return made, edges(found, entry, doc, AFFECT, CONTAINS).unionByName(edges(found, ("Keyword", F.col("term")), entry, BELONGS))


def append_graph(spark: SparkSession, new_nodes: DataFrame, new_edges: DataFrame, path: str) -> None:
    """Append the nodes and edges that are not stored yet."""
    for name, df, keys in (("graph_nodes", new_nodes, ["label", "key"]), ("graph_edges", new_edges, ["src_label", "src_key", "type", "dst_label", "dst_key"])):
        target = f"{path}/{name}"
        stored = df.join(spark.read.parquet(target).select(*keys), keys, "left_anti") if exists(spark, target) else df
        stored.dropDuplicates(keys).write.mode("append").parquet(target)


def place_edges(places: DataFrame, label: str, key: str, passages: str | None = None) -> DataFrame:
    """Document - place edges for ``Address`` or ``Location`` findings."""
    return edges(places, ("Document", F.col("doc_id")), (label, F.col(key)), CONTAINS, AFFECT, passages=F.col(passages) if passages else None)
