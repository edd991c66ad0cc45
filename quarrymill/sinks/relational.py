"""Results as relational tables: entities with stable ids, mapping tables, document states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.entities import address_passages
from quarrymill.tables import exists

#: Columns of the tables, all written as parquet.
TABLES = {
    "keywords": "id long, name string", "alkis": "id long, name string, categorie string, code int", "terms": "id long, name string, iscore boolean, morphem string",
    "documents": "id long, name string, author string, uri string, is_analysed boolean, analysed_on timestamp", "ontologies": "id long, name string",
    "addresses": "id long, feature_id string, strnam string, hausnr string, hausnrz string, bez_name string, plz string",
    "locations": "id long, name string, feature_code string, latitude double, longitude double, synonyms array<string>",
    "documents_keywords": "document_id long, keyword_id long, weight double, text_passages array<string>", "terms_ontologies": "term_id long, ontology_id long",
} | {f"documents_{many}": f"document_id long, {one}_id long, text_passages array<string>" for many, one in (("alkis", "alkis"), ("terms", "term"), ("locations", "location"), ("ontologies", "ontology"), ("addresses", "address"))}


def create_tables(spark: SparkSession, names: list[str] | None = None) -> None:
    """Create the tables that are not there yet."""
    for name in names or list(TABLES):
        spark.sql(f"CREATE TABLE IF NOT EXISTS nlp_{name} ({TABLES[name]}) USING parquet")


def surrogate(*keys: str):  # noqa: ANN201
    """Id of a natural key, the same on every run; case is ignored."""
    return F.xxhash64(*[F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys])


def get_or_create(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``(key, id)`` of every key: the existing id where the key is known, case ignored."""
    known = existing.select(F.lower(key).alias("_k"), F.col("id").alias("_id")).groupBy("_k").agg(F.min("_id").alias("_id"))
    keys = new.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_k", F.lower(key))
    return keys.join(known, "_k", "left").select(key, F.coalesce("_id", surrogate(key)).alias("id"))


def insert_missing(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``, each key once: what has to be appended."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def update_passages(mapping: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    """The mapping with new text passages where there are some."""
    fresh = passages.select(*keys, F.col("text_passages").alias("_new"))
    return mapping.join(fresh, keys, "left").withColumn("text_passages", F.coalesce("_new", "text_passages")).drop("_new")


def document_rows(meta: DataFrame) -> DataFrame:
    """Document rows from ``(name, author, uri)``; a missing author is ``unknown``, a missing URI
    an error."""
    uri = F.when(F.col("uri").isNull(), F.raise_error(F.lit("a document needs a URI"))).otherwise(F.col("uri"))
    return meta.select(surrogate("name", "uri").alias("id"), "name", F.coalesce("author", F.lit("unknown")).alias("author"), uri.alias("uri"), F.lit(False).alias("is_analysed"), F.lit(None).cast("timestamp").alias("analysed_on"))


def mark_analysed(documents: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    flagged = documents.join(done.select(id_col).distinct().withColumn("_done", F.lit(True)), id_col, "left")
    now = F.coalesce("_done", F.lit(False))
    return flagged.withColumn("analysed_on", F.when(now, F.current_timestamp()).otherwise(F.col("analysed_on"))).withColumn("is_analysed", F.coalesce("is_analysed", F.lit(False)) | now).drop("_done")


def delete_documents(documents: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    return documents.join(gone.select(id_col), id_col, "left_anti")


def update_authors(documents: DataFrame, authors: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents with the author of ``(id, author)`` where that names one."""
    named = authors.filter(F.col("author").isNotNull()).groupBy(id_col).agg(F.max("author").alias("_author"))
    return documents.join(named, id_col, "left").withColumn("author", F.coalesce("_author", "author")).drop("_author").select(*documents.columns)


def delete_where(table: DataFrame, condition: str | None = None) -> DataFrame:
    """Rows for which the condition does not hold; null counts as not. Without a condition none stay."""
    return table.limit(0) if condition is None else table.filter(~F.coalesce(F.expr(condition), F.lit(False)))


def split_synonyms(locations: DataFrame) -> DataFrame:
    """Stored comma-separated synonyms as a set, empty ones left out; null gives the empty set."""
    return locations.withColumn("synonyms", F.array_distinct(F.filter(F.split(F.coalesce("synonyms", F.lit("")), ","), lambda s: s != "")))


def joined_synonyms(locations: DataFrame) -> DataFrame:
    """Synonym sets as the comma-separated text that is stored."""
    return locations.withColumn("synonyms", F.array_join("synonyms", ","))


def lookup(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The stored entities of the given ids, each once."""
    return table.join(ids.select(id_col).distinct(), id_col, "left_semi").dropDuplicates([id_col])


def insert_entities(kind: str, entries: DataFrame) -> dict[str, DataFrame]:
    """Tables for entities that are stored without a document: ``terms`` with their ontologies and
    the mapping, ``alkis``, ``locations``, ``keywords``. Addresses come from the register only."""
    if kind == "terms":
        coded = entries.filter(F.col("term").isNotNull()).withColumn("id", surrogate("term"))
        ontologies = coded.select(F.col("id").alias("term_id"), F.explode("ontologies").alias("name")).filter(F.col("name").isNotNull())
        return {
            "terms": coded.select("id", F.col("term").alias("name"), "iscore", "morphem").dropDuplicates(["id"]), "ontologies": ontologies.select(surrogate("name").alias("id"), "name").dropDuplicates(["id"]),
            "terms_ontologies": ontologies.select("term_id", surrogate("name").alias("ontology_id")).distinct(),
        }
    if kind == "alkis":
        return {kind: entries.filter(F.col("name").isNotNull()).select(surrogate("name").alias("id"), "name", "categorie", "code").dropDuplicates(["id"])}
    if kind == "locations":
        return {kind: entries.filter(F.col("id").isNotNull()).select("id", "name", "feature_code", "latitude", "longitude", "synonyms").dropDuplicates(["id"])}
    if kind == "keywords":
        return {kind: entries.filter(F.col("name").isNotNull()).select(surrogate("name").alias("id"), "name").dropDuplicates(["id"])}
    raise ValueError(f"entities of kind {kind} are not inserted")


def persist_locations(found: DataFrame, places: DataFrame, passages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables for validated locations ``(doc_id, prefix, id)``: the gazetteer rows met and their
    mapping to documents, with the passages of what was found in the text."""
    mapped = found.select("doc_id", F.col("prefix").alias("word"), "id").distinct()
    told = mapped.withColumn("passages", F.lit(None).cast("array<string>")) if passages is None else mapped.join(passages.select("doc_id", "word", "passages"), ["doc_id", "word"], "left")
    mapping = told.groupBy(F.col("doc_id").alias("document_id"), F.col("id").alias("location_id")).agg(F.min("passages").alias("text_passages"))
    rows = places.join(found.select("id").distinct(), "id", "left_semi")
    return insert_entities("locations", rows) | {"documents_locations": mapping}


def persist_addresses(found: DataFrame, register: DataFrame, passages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables for validated addresses ``(doc_id, name, number, suffix, feature_id)``: the register
    rows met and their mapping to documents, with the passages of their display forms."""
    met = found.select("doc_id", "name", "number", "suffix", "feature_id").distinct()
    told = met.withColumn("passages", F.lit(None).cast("array<string>")) if passages is None else address_passages(met, passages)
    mapping = told.groupBy(F.col("doc_id").alias("document_id"), surrogate("feature_id").alias("address_id")).agg(F.min("passages").alias("text_passages"))
    rows = register.join(found.select("feature_id").distinct(), "feature_id", "left_semi").select(surrogate("feature_id").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("feature_id", "strnam", "hausnr", "hausnrz", "bez_name", "plz")])
    return {"addresses": rows.dropDuplicates(["id"]), "documents_addresses": mapping}


def persist_keywords(keywords: DataFrame, catalog: DataFrame, passages: DataFrame) -> dict[str, DataFrame]:
    """Tables for ``(doc_id, term, score)``: keywords, catalog terms with their ontologies, and the
    mappings, all from one lineage."""
    found = keywords.join(passages.select("doc_id", F.col("word").alias("term"), "passages"), ["doc_id", "term"], "left")
    entries = catalog.join(keywords.select("term").distinct(), "term", "left_semi").withColumn("id", surrogate("term"))
    ontologies = entries.select(F.col("id").alias("term_id"), F.explode("ontologies").alias("name")).filter(F.col("name").isNotNull())
    mapped = keywords.join(entries.select("term", F.col("id").alias("term_id")), "term").select(F.col("doc_id").alias("document_id"), "term_id").distinct()
    return {
        "keywords": keywords.select(surrogate("term").alias("id"), F.col("term").alias("name")).dropDuplicates(["id"]),
        "documents_keywords": found.select(F.col("doc_id").alias("document_id"), surrogate("term").alias("keyword_id"), F.col("score").alias("weight"), F.col("passages").alias("text_passages")),
        "terms": entries.select("id", F.col("term").alias("name"), "iscore", "morphem").dropDuplicates(["id"]), "documents_terms": mapped,
        "ontologies": ontologies.select(surrogate("name").alias("id"), "name").dropDuplicates(["id"]), "terms_ontologies": ontologies.select("term_id", surrogate("name").alias("ontology_id")).distinct(),
    }


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/nlp_{name}")


#: What makes a row of a table the same; of other tables the id.
KEYS = {"terms_ontologies": ["term_id", "ontology_id"]} | {f"documents_{many}": ["document_id", f"{one}_id"] for many, one in (("keywords", "keyword"), ("alkis", "alkis"), ("terms", "term"), ("locations", "location"), ("ontologies", "ontology"), ("addresses", "address"))}


def append_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Append to every table what its stored rows do not hold yet, by key: what earlier batches
    wrote stays, and a batch that is repeated adds nothing."""
    for name, df in tables.items():
        target, keys = f"{path}/nlp_{name}", KEYS.get(name, ["id"])
        new = insert_missing(df, spark.read.parquet(target), keys) if exists(spark, target) else df.dropDuplicates(keys)
        new.write.mode("append").parquet(target)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)
