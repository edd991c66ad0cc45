"""Queries of the reference's operators over whole tables, with SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.functions import vectors as V
from quarrymill.operators import catalog as C
from quarrymill.operators import entities as E
from quarrymill.operators import lines, textrank, tfidf
from quarrymill.operators import tokens as tok
from quarrymill.operators.proximity import great_circle_m, usable_point
from quarrymill.plans.core_queries import query
from quarrymill.sinks import graph, relational
from quarrymill.sources import readers
from quarrymill.tables import staged, table

# SQL building blocks -------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tok.STOPWORDS)
_TOKEN = r"[\p{L}\p{N}_]+(?:[-–/][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}]"
_UNWRAP = "replace(replace(replace(text, '-' || chr(10), ''), chr(10), ' '), '- ', '')"
_SENTENCES = rf"""
    cut AS (SELECT doc_id, string_split(regexp_replace({_UNWRAP}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
    sentences AS (SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_id FROM cut)
"""
_LINES = r"""
    cut AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
    trimmed AS (SELECT doc_id, CASE WHEN len(list_filter(s, lambda x: x <> '')) = 0 AND len(s) > 1 THEN []
        ELSE s[1:greatest(CASE WHEN len(s) = 1 THEN 1 ELSE 0 END, coalesce(list_max(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] <> '' THEN i ELSE 0 END)), 0))] END AS s FROM cut),
    lines AS (SELECT doc_id, unnest(s) AS line, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS line_no FROM trimmed)
"""
_TRIM = r"regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_TERMS = rf"len(list_filter(regexp_split_to_array({_TRIM}, '\s'), lambda p: regexp_matches(p, '^[a-zA-ZäÄüÜöÖß()/-–]*$') AND length(p) > 2))"
_COUNTS = rf"""
    counts AS (SELECT doc_id, line_no, line, len(regexp_extract_all(line, '\.')) AS dots, len(regexp_extract_all(line, '\p{{Nd}}')) AS digits, len(regexp_extract_all(line, ' ')) AS blanks, {_TERMS} AS terms FROM lines),
    metrics AS (SELECT *, CASE WHEN dots + digits + blanks + terms = 0 THEN 0 ELSE CAST(ceil(((dots + digits + blanks)::DOUBLE / (dots + digits + blanks + terms)::DOUBLE)::FLOAT * 100::FLOAT) AS INTEGER) END AS percent FROM counts)
"""
_CORPUS = """
    corpus AS (SELECT doc_id, sent_id, pos, min(struct_pack(term := trim(term), tag := coalesce(pos_tag, ''))) AS t FROM tagged_tokens WHERE length(trim(term)) > 0 GROUP BY 1, 2, 3),
    tokens AS (SELECT doc_id, sent_id, pos, t.term AS term, t.tag AS pos_tag FROM corpus)
"""
_TF = f"""{_CORPUS},
    sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_id) AS size FROM tokens),
    per_sentence AS (SELECT doc_id, sent_id, term, count(*) / first(size) AS tf, min(struct_pack(pos := pos, tag := pos_tag)) AS f FROM sized GROUP BY 1, 2, 3),
    tf AS (SELECT doc_id, term, arg_max(tf, sent_id) AS tf, count(*) AS df, arg_min(f.tag, sent_id) AS pos_tag FROM per_sentence GROUP BY 1, 2),
    n AS (SELECT doc_id, count(DISTINCT sent_id) AS n FROM tokens GROUP BY 1)
"""
_EDGES = f"""{_CORPUS},
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id, sent_id) AS size FROM tokens),
    pairs AS (SELECT a.doc_id, a.sent_id, a.term AS src, b.term AS dst, a.i AS i, b.i AS j FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.i > a.i AND b.i - a.i <= 4
              WHERE a.size >= 5 AND a.term <> b.term),
    edges AS (SELECT doc_id, src, dst, 1.0::DOUBLE AS weight, min(struct_pack(s := sent_id, w := greatest(0, j - 4), i := i, j := j)) AS ord FROM pairs GROUP BY 1, 2, 3)
"""


def _ranks(iterations: int) -> str:
    """TextRank with every iteration as its own common table expression."""
    steps = ["""
    degree AS (SELECT doc_id, src, sum(weight) AS degree FROM edges GROUP BY 1, 2),
    vertex AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, src AS term FROM edges UNION ALL SELECT doc_id, dst FROM edges)),
    r0 AS (SELECT doc_id, term, 1.0::DOUBLE AS score FROM vertex)"""]
    for n in range(1, iterations + 1):
        steps.append(f"""
    g{n} AS (SELECT e.doc_id, e.src AS term, sum(r.score / d.degree) AS got FROM edges e JOIN degree d ON d.doc_id = e.doc_id AND d.src = e.src JOIN r{n - 1} r ON r.doc_id = e.doc_id AND r.term = e.dst GROUP BY 1, 2),
    u{n} AS (SELECT v.doc_id, v.term, 0.15 + 0.85 * coalesce(g.got, 0) AS score FROM vertex v LEFT JOIN g{n} g ON g.doc_id = v.doc_id AND g.term = v.term),
    r{n} AS MATERIALIZED (SELECT doc_id, term, score / sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS score FROM u{n})""")
    return ",".join(steps)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _tagged(spark: SparkSession, d: str, by_document: bool = False) -> DataFrame:
    return tok.corpus(table(spark, d, "tagged_tokens"), by_document)


# text layer ----------------------------------------------------------------------------------


@query(f"WITH {_SENTENCES} SELECT doc_id, sent_id, sentence FROM sentences")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return tok.sentences(_documents(spark, d))


@query(rf"WITH {_SENTENCES}, t AS (SELECT doc_id, sent_id, regexp_extract_all(sentence, '{_TOKEN}') AS t FROM sentences) SELECT doc_id, sent_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM t")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return tok.tokens(tok.sentences(_documents(spark, d)))


_CLEANED = rf"""
    parts AS (SELECT doc_id, sent_id, sentence AS line, regexp_extract_all(sentence, '{_TOKEN}') AS t FROM sentences),
    cleaned AS (SELECT doc_id, sent_id AS line_no, line, list_filter(list_transform(t, lambda x: regexp_replace(regexp_replace(x, '[^\x{{2013}}\-\wäÄöÖüÜß,./]', '', 'g'), '^([^-]*)-(\p{{Ll}}[^-]*)-*$', '\1\2')), lambda x: length(x) >= 2) AS terms FROM parts)
"""


@query(rf"WITH {_SENTENCES}, {_CLEANED}, kept AS (SELECT doc_id, line_no AS sent_id, terms FROM cleaned WHERE len(terms) > 0) SELECT doc_id, sent_id, unnest(terms) AS term, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS pos FROM kept")
def token_clean(spark: SparkSession, d: str) -> DataFrame:
    s = tok.sentences(_documents(spark, d))
    return s.select("doc_id", "sent_id", F.posexplode(T.clean_tokens(T.tokenize(F.col("sentence")))).alias("pos", "term"))


@query(rf"WITH {_SENTENCES}, {_CLEANED}, lines AS (SELECT doc_id, line_no, line FROM cleaned), {_COUNTS} SELECT c.doc_id, c.line_no AS sent_id, CASE WHEN len(c.terms) <= 5 OR m.percent >= 80 THEN [] ELSE c.terms END AS terms FROM cleaned c JOIN metrics m ON m.doc_id = c.doc_id AND m.line_no = c.line_no")
def clean_sentences(spark: SparkSession, d: str) -> DataFrame:
    return tok.clean_sentences(tok.sentences(_documents(spark, d)))


@query(f"WITH {_LINES}, {_COUNTS} SELECT doc_id, line_no, length(line) AS chars, CAST(dots AS INTEGER) AS dots, CAST(digits AS INTEGER) AS digits, CAST(blanks AS INTEGER) AS blanks, CAST(terms AS INTEGER) AS terms, percent FROM metrics")
def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    return lines.metrics(lines.to_lines(_documents(spark, d)))


_KEEPWORDS = ["Umweltbericht", "Anlage"]
_HAS_KEEPWORD = "(contains(lower({0}), 'umweltbericht') OR contains(lower({0}), 'anlage'))"


@query(rf"""WITH {_LINES}, short AS (SELECT doc_id, line_no, {_TRIM} AS line, {_TERMS} < 5 AS short, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
    SELECT doc_id, line_no, line FROM short WHERE n <= 2 OR NOT (line = '' OR regexp_matches(line, '^\p{{Nd}}*$') OR short <> {_HAS_KEEPWORD.format('line')})""")
def lines_unimportant_removed(spark: SparkSession, d: str) -> DataFrame:
    return lines.drop_unimportant(lines.to_lines(_documents(spark, d)), _KEEPWORDS)


@query(f"WITH {_LINES}, {_COUNTS} SELECT doc_id, line_no, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM metrics) WHERE n <= 2 OR percent <= 80")
def lines_toc_removed(spark: SparkSession, d: str) -> DataFrame:
    return lines.drop_contents(lines.to_lines(_documents(spark, d)))


@query(f"WITH {_LINES} SELECT doc_id, line_no, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, line) AS copies FROM lines) WHERE n <= 2 OR copies = 1 OR {_HAS_KEEPWORD.format('line')}")
def lines_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.drop_repeated(lines.to_lines(_documents(spark, d)), _KEEPWORDS)


@query(f"""WITH {_LINES}, marked AS (SELECT *, count(*) OVER (PARTITION BY doc_id) > 2 AND (ends_with(line, '-') OR ends_with(line, '–') OR ends_with(line, chr(173))) AS cut FROM lines),
    grouped AS (SELECT *, coalesce(sum(CASE WHEN cut THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marked)
    SELECT doc_id, min(line_no) AS line_no, string_agg(CASE WHEN cut THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY line_no) AS line FROM grouped GROUP BY doc_id, g HAVING bool_or(NOT cut)""")
def hyphen_join(spark: SparkSession, d: str) -> DataFrame:
    return lines.join_hyphenated(lines.to_lines(_documents(spark, d)))


_TAGGED = rf"""{_SENTENCES}, t AS (SELECT doc_id, sent_id, regexp_extract_all(sentence, '{_TOKEN}') AS t FROM sentences),
    u AS (SELECT doc_id, sent_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM t),
    tagged AS (SELECT *, CASE WHEN regexp_matches(term, '^\p{{Nd}}+$') THEN 'CARD' WHEN NOT regexp_matches(term, '[\p{{L}}\p{{N}}]') THEN '$.' WHEN lower(term) IN ({_STOP}) THEN 'FUNC' WHEN regexp_matches(term, '^\p{{Lu}}') THEN 'NN' ELSE 'OTHER' END AS pos_tag FROM u)"""


@query(f"WITH {_TAGGED} SELECT doc_id, sent_id, pos, term, pos_tag FROM tagged WHERE pos_tag = 'NN'")
def pos_filter(spark: SparkSession, d: str) -> DataFrame:
    return tok.keep_tags(tok.tag(tok.tokens(tok.sentences(_documents(spark, d)))))


@query(f"WITH {_TAGGED} SELECT doc_id, sent_id, pos, term FROM u WHERE lower(term) NOT IN ({_STOP})")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return tok.drop_stopwords(tok.tokens(tok.sentences(_documents(spark, d))))


@query()
def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("term").distinct().withColumn("stem", tok.stem("term"))


@query(rf"""WITH {_CORPUS}, g AS (SELECT doc_id, sent_id, list(term ORDER BY pos) AS t FROM tokens GROUP BY 1, 2)
    SELECT doc_id, sent_id, trim(array_to_string(list_transform(t, lambda x, i: CASE WHEN i = 1 OR length(x) = 1 THEN x ELSE ' ' || x END), '')) AS sentence FROM g""")
def sentence_join(spark: SparkSession, d: str) -> DataFrame:
    from quarrymill.plans.pipeline import joined_sentences

    return joined_sentences(_tagged(spark, d))


@query(rf"""WITH {_CORPUS}, g AS (SELECT doc_id, sent_id, list(term ORDER BY pos) AS t FROM tokens GROUP BY 1, 2), p AS (SELECT a.doc_id, a.sent_id, a.t AS l, b.t AS r FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.sent_id = a.sent_id + 1),
    c AS (SELECT *, len(list_intersect(list_distinct(l), list_distinct(r))) AS common, CASE WHEN len(l) > 1 THEN log10(len(l)) ELSE 0 END + CASE WHEN len(r) > 1 THEN log10(len(r)) ELSE 0 END AS logs FROM p)
    SELECT doc_id, sent_id, round(CASE WHEN common = 0 OR logs = 0 THEN 0 ELSE common / logs END, 6) AS similarity FROM c""")
def sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    g = _tagged(spark, d).groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("l"))
    after = g.select("doc_id", (F.col("sent_id") - 1).alias("sent_id"), F.col("l").alias("r"))
    return g.join(after, ["doc_id", "sent_id"]).select("doc_id", "sent_id", F.round(T.sentence_similarity(F.col("l"), F.col("r")), 6).alias("similarity"))


# keywords ------------------------------------------------------------------------------------


@query(f"WITH {_CORPUS} SELECT doc_id, term, count(*) AS cnt, arg_min(pos_tag, struct_pack(s := sent_id, p := pos, t := pos_tag)) AS pos_tag, count(DISTINCT sent_id) AS n_sentences FROM tokens GROUP BY 1, 2")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_statistics(_tagged(spark, d))


def _score(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "term", F.round("score", 6).alias("score"))


@query(f"WITH {_TF} SELECT doc_id, term, round(tf * log10(n / df), 6) AS score FROM tf JOIN n USING (doc_id) WHERE pos_tag = 'NN'")
def tfidf_none(spark: SparkSession, d: str) -> DataFrame:
    return _score(tfidf.tfidf(_tagged(spark, d)))


@query(f"WITH {_TF} SELECT doc_id, term, round(log10(1 + tf) * log10(n / df), 6) AS score FROM tf JOIN n USING (doc_id) WHERE pos_tag = 'NN'")
def tfidf_log(spark: SparkSession, d: str) -> DataFrame:
    return _score(tfidf.tfidf(_tagged(spark, d), "log"))


@query(f"WITH {_TF} SELECT doc_id, term, score FROM (SELECT doc_id, term, pos_tag, round((0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id)) * log10(n / df), 6) AS score FROM tf JOIN n USING (doc_id)) WHERE pos_tag = 'NN'")
def tfidf_double(spark: SparkSession, d: str) -> DataFrame:
    return _score(tfidf.tfidf(_tagged(spark, d), "double"))


@query(f"WITH {_TF}, s AS (SELECT doc_id, term, round(tf * log10(n / df), 6) AS score FROM tf JOIN n USING (doc_id) WHERE pos_tag = 'NN') SELECT doc_id, term, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 10")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_terms(_score(tfidf.tfidf(_tagged(spark, d))), 10)


@query(f"WITH {_EDGES} SELECT doc_id, src, dst, weight FROM edges")
def cooc_edges(spark: SparkSession, d: str) -> DataFrame:
    return textrank.edges(_tagged(spark, d)).drop("ord")


@query(f"WITH {_EDGES} SELECT doc_id, src, sum(weight) AS degree FROM edges GROUP BY 1, 2")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return textrank.degrees(textrank.edges(_tagged(spark, d)))


@query(f"""WITH {_EDGES}, o AS (SELECT doc_id, src AS term, list(dst ORDER BY ord)[1:4] AS links_out FROM edges GROUP BY 1, 2), i AS (SELECT doc_id, dst AS term, list(src ORDER BY ord)[1:4] AS links_in FROM edges GROUP BY 1, 2)
    SELECT coalesce(o.doc_id, i.doc_id) AS doc_id, coalesce(o.term, i.term) AS term, coalesce(links_in, []) AS links_in, coalesce(links_out, []) AS links_out FROM o FULL JOIN i ON o.doc_id = i.doc_id AND o.term = i.term""")
def linked_terms(spark: SparkSession, d: str) -> DataFrame:
    return textrank.linked_terms(textrank.edges(_tagged(spark, d, True)), 3)


@query(f"WITH {_EDGES}, {_ranks(1)} SELECT doc_id, term, round(score, 6) AS score FROM r1")
def textrank_1iter(spark: SparkSession, d: str) -> DataFrame:
    return _score(textrank.textrank(_tagged(spark, d), iterations=1))


@query(f"WITH {_EDGES}, {_ranks(10)} SELECT doc_id, term, round(score, 6) AS score FROM r10")
def textrank_10iter(spark: SparkSession, d: str) -> DataFrame:
    return _score(textrank.textrank(_tagged(spark, d)))


@query(f"""WITH {_EDGES}, {_ranks(10)},
    sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_id) AS sent_size FROM tokens),
    per_sentence AS (SELECT doc_id, sent_id, term, count(*) / first(sent_size) AS tf FROM sized GROUP BY 1, 2, 3),
    tf AS (SELECT doc_id, term, arg_max(tf, sent_id) AS tf, count(*) AS df FROM per_sentence GROUP BY 1, 2), n AS (SELECT doc_id, count(DISTINCT sent_id) AS n FROM tokens GROUP BY 1),
    both_results AS (SELECT doc_id, term, tf * log10(n / df) AS score, 0 AS p FROM tf JOIN n USING (doc_id) UNION ALL SELECT doc_id, term, score, 1 FROM r10)
    SELECT doc_id, term, round(arg_max(score, p), 6) AS score FROM both_results GROUP BY 1, 2""")
def keyword_merge(spark: SparkSession, d: str) -> DataFrame:
    corpus = _tagged(spark, d, True)
    return _score(C.merge_keywords([tfidf.tfidf(corpus, tags=None), textrank.textrank(corpus)]))


# catalogs ------------------------------------------------------------------------------------


def _entered(spark: SparkSession, d: str) -> DataFrame:
    """Keywords as entered for documents: (doc_id, term, score)."""
    k = table(spark, d, "keywords").filter(F.col("doc_id").isNotNull() & F.col("keyword").isNotNull())
    return k.groupBy("doc_id", F.col("keyword").alias("term")).agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("score"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").withColumnRenamed("term", "name")


_ENTERED = "entered AS (SELECT doc_id, keyword AS term, max(coalesce(weight, 0)) AS score FROM keywords WHERE doc_id IS NOT NULL AND keyword IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_ENTERED} SELECT doc_id, term, score FROM entered WHERE term IN (SELECT term FROM terms)")
def catalog_semi(spark: SparkSession, d: str) -> DataFrame:
    return C.known_terms(_entered(spark, d), _terms(spark, d))


@query(f"WITH {_ENTERED} SELECT e.doc_id, e.term, e.score, t.term_id, t.morphem, t.iscore FROM entered e LEFT JOIN terms t ON t.term = e.term")
def catalog_left(spark: SparkSession, d: str) -> DataFrame:
    return C.with_entries(_entered(spark, d), _terms(spark, d)).select("doc_id", "term", "score", "term_id", "morphem", "iscore")


@query(f"WITH {_ENTERED} SELECT doc_id, term, min(score) AS score FROM entered WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2")
def catalog_exact(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_by_catalog(_entered(spark, d), _terms(spark, d))


@query("SELECT name, max(categorie) AS categorie, max(code) AS code FROM (SELECT name, arg_max(struct_pack(c := categorie, o := code), struct_pack(c := categorie, o := code)) AS e FROM alkis GROUP BY name) x, LATERAL (SELECT e.c AS categorie, e.o AS code) y GROUP BY name")
def catalog_load(spark: SparkSession, d: str) -> DataFrame:
    return C.load_catalog(table(spark, d, "alkis"), "name")


@query(rf"""WITH {_SENTENCES}, w AS (SELECT DISTINCT doc_id, keyword AS word FROM keywords WHERE doc_id IS NOT NULL AND length(keyword) > 0)
    SELECT doc_id, word, list_sort(list(DISTINCT sentence)) AS passages FROM w JOIN sentences USING (doc_id) WHERE contains(sentence, word) GROUP BY 1, 2""")
def text_passages(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "keywords").filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("keyword").alias("word"))
    return C.text_passages(words, tok.sentences(_documents(spark, d)))


# vectors -------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(f"SELECT query_id, neighbour_id, similarity, CAST(r AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {_COS} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE r <= 10")
def nearest_words(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.nearest(e, e.filter(F.col("vec_id") % 100 == 0))


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND {_COS} * 100 > 25")
def catalog_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.similar(e, e.filter(F.col("vec_id") % 100 == 0), 25)


@query("""WITH t AS (SELECT i, sum(CASE WHEN vec_id IN (0, 1) THEN x ELSE -x END) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IN (0, 1, 2)) GROUP BY i), v AS (SELECT list(x ORDER BY i) AS v FROM t)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, v WHERE vec_id NOT IN (0, 1, 2) ORDER BY similarity DESC, vec_id LIMIT 10""")
def analogy(spark: SparkSession, d: str) -> DataFrame:
    return V.analogy(table(spark, d, "embeddings"), [0, 1], [2])


@query()
def word2vec_train(spark: SparkSession, d: str) -> DataFrame:
    g = _tagged(spark, d).groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))
    return V.word_vectors(V.train_word_vectors(g))


# entities ------------------------------------------------------------------------------------

_ADDRESS = r"(?:[A-Z][ a-zäüöß-]+)+(?:\. | |\.|)\d{1,3}[a-zA-Z\-/]{0,2}\d{0,3}[a-zA-Z]?"
_FOUND = rf"""found AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(m, 'str\.', 'straße'), 'Str\.', 'Straße') AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ADDRESS}')) AS m FROM documents WHERE text IS NOT NULL))"""


@query(f"WITH {_FOUND} SELECT doc_id, entity FROM found")
def address_extract(spark: SparkSession, d: str) -> DataFrame:
    return E.pattern_entities(_documents(spark, d))


@query(rf"""WITH {_FOUND}, able AS (SELECT * FROM found WHERE regexp_matches(entity, '\p{{Nd}}') AND NOT regexp_matches(entity, '\p{{Nd}}{{4}}'))
    SELECT doc_id, entity, trim(regexp_extract(entity, '^((?s:.*)\p{{L}}{{2}})((?s:.*))$', 1)) AS name, trim(CASE WHEN regexp_matches(entity, '\p{{L}}{{2}}') THEN regexp_extract(entity, '^((?s:.*)\p{{L}}{{2}})((?s:.*))$', 2) ELSE entity END) AS number FROM able""")
def address_split(spark: SparkSession, d: str) -> DataFrame:
    found = E.pattern_entities(_documents(spark, d)).filter(F.col("entity").rlike(r"\p{Nd}") & ~F.col("entity").rlike(r"\p{Nd}{4}"))
    return found.select("doc_id", "entity", T.name_part(F.col("entity")).alias("name"), T.number_part(F.col("entity")).alias("number"))


@query()
def address_expand(spark: SparkSession, d: str) -> DataFrame:
    return E.address_candidates(E.pattern_entities(_documents(spark, d)))


@query()
def address_validate(spark: SparkSession, d: str) -> DataFrame:
    return E.validate_addresses(staged(E.pattern_entities(_documents(spark, d)), "found"), table(spark, d, "addresses").filter(F.col("strnam").isNotNull()))


def _named_rows(spark: SparkSession, d: str) -> DataFrame:
    """Names that documents' keywords give, as entities; some are repeated."""
    k = table(spark, d, "keywords").filter(F.col("doc_id").isNotNull() & F.col("keyword").isNotNull())
    p = table(spark, d, "locations").filter(F.col("name").isNotNull())
    return k.select("doc_id", F.col("keyword").alias("entity")).unionByName(p.select(F.col("id").cast("long").alias("doc_id"), F.concat(F.col("name"), F.lit(" Mitte")).alias("entity")))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Names that documents' keywords give, as entities."""
    return _named_rows(spark, d).distinct()


_NAMED = "named AS (SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, keyword AS entity FROM keywords WHERE doc_id IS NOT NULL AND keyword IS NOT NULL UNION ALL SELECT id AS doc_id, name || ' Mitte' AS entity FROM locations WHERE name IS NOT NULL))"
_PREFIX = r"""words AS (SELECT doc_id, entity, list_filter(string_split(entity, ' '), lambda w: NOT regexp_matches(w, '\p{Nd}')) AS w FROM named),
    prefixes AS (SELECT DISTINCT doc_id, array_to_string(w[1:n], ' ') AS prefix FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS n FROM words WHERE len(w) > 0)),
    able AS (SELECT * FROM prefixes WHERE length(prefix) > 5)"""


@query(f"WITH {_NAMED}, {_PREFIX} SELECT DISTINCT doc_id, prefix, id FROM able JOIN locations l ON lower(l.name) = lower(prefix)")
def location_prefix(spark: SparkSession, d: str) -> DataFrame:
    return E.validate_locations(_named(spark, d), E.gazetteer(table(spark, d, "locations")))


@query(rf"""WITH {_NAMED}, p AS (SELECT DISTINCT ON (id) id, name, latitude, longitude FROM locations),
    near AS (SELECT * FROM p WHERE latitude BETWEEN 52.530644 - 12500 / 111000.0 AND 52.530644 + 12500 / 111000.0 AND 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(52.530644 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(52.530644)) * pow(sin(radians(13.383068 - longitude) / 2), 2)))) <= 12500),
    w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split(entity, ' ')) AS word FROM named) WHERE NOT regexp_matches(word, '\p{{Nd}}') AND length(word) > 5)
    SELECT DISTINCT doc_id, word, id FROM w JOIN near ON lower(name) = lower(word)""")
def location_distance(spark: SparkSession, d: str) -> DataFrame:
    return E.locations_near(_named(spark, d), E.gazetteer(table(spark, d, "locations")), in_synonyms=False)


@query("""SELECT DISTINCT id, round(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(52.530644 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(52.530644)) * pow(sin(radians(13.383068 - longitude) / 2), 2)))), 3) AS distance_m FROM locations
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)""")
def location_distances(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "locations").filter(usable_point(F.col("latitude"), F.col("longitude")))
    return p.select("id", F.round(great_circle_m(F.col("latitude"), F.col("longitude"), F.lit(E.ORIGIN[0]), F.lit(E.ORIGIN[1])), 3).alias("distance_m")).distinct()


# sinks, sources ------------------------------------------------------------------------------


@query(f"""WITH {_ENTERED}, t AS (SELECT term, ontologies, morphem, iscore FROM terms WHERE term IN (SELECT term FROM entered)), o AS (SELECT term, unnest(ontologies) AS ontology FROM t)
    SELECT 'Document' AS label, CAST(doc_id AS VARCHAR) AS key FROM documents UNION ALL SELECT DISTINCT 'Keyword', term FROM entered UNION ALL SELECT 'Term', term FROM t UNION ALL SELECT DISTINCT 'Ontology', ontology FROM o WHERE ontology IS NOT NULL""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.keyword_graph(_documents(spark, d), _entered(spark, d), table(spark, d, "terms"))[0].select("label", "key")


@query(f"""WITH {_ENTERED}, m AS (SELECT doc_id, e.term FROM entered e JOIN terms t ON t.term = e.term), o AS (SELECT DISTINCT m.doc_id, unnest(t.ontologies) AS ontology FROM m JOIN terms t ON t.term = m.term),
    e AS (SELECT 'Document' AS src_label, CAST(doc_id AS VARCHAR) AS src_key, 'contains' AS type, 'Keyword' AS dst_label, term AS dst_key, score AS weight FROM entered UNION ALL SELECT 'Keyword', term, 'affect', 'Document', CAST(doc_id AS VARCHAR), NULL FROM entered
        UNION ALL SELECT 'Term', term, 'affect', 'Document', CAST(doc_id AS VARCHAR), NULL FROM m UNION ALL SELECT 'Document', CAST(doc_id AS VARCHAR), 'contains', 'Term', term, NULL FROM m UNION ALL SELECT DISTINCT 'Keyword', term, 'belongsTo', 'Term', term, NULL FROM m
        UNION ALL SELECT DISTINCT 'Document', CAST(doc_id AS VARCHAR), 'belongsTo', 'Ontology', ontology, NULL FROM o WHERE ontology IS NOT NULL UNION ALL SELECT DISTINCT 'Ontology', ontology, 'affect', 'Document', CAST(doc_id AS VARCHAR), NULL FROM o WHERE ontology IS NOT NULL)
    SELECT * FROM e""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.keyword_graph(_documents(spark, d), _entered(spark, d), table(spark, d, "terms"))[1].drop("text_passages")


@query(f"WITH {_ENTERED}, new AS (SELECT doc_id, e.term, t.term_id FROM entered e JOIN terms t ON t.term = e.term) SELECT doc_id, term_id FROM new WHERE NOT (doc_id % 2 = 0 AND term_id % 2 = 0)")
def mapping_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = C.with_entries(_entered(spark, d), _terms(spark, d)).filter(F.col("term_id").isNotNull()).select("doc_id", "term_id")
    existing = new.filter((F.col("doc_id") % 2 == 0) & (F.col("term_id") % 2 == 0))  # what an earlier run had stored
    return relational.insert_missing(new, existing, ["doc_id", "term_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM keywords WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 350")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    return readers.work_queue(_documents(spark, d), table(spark, d, "keywords").filter(F.col("doc_id").isNotNull()))


@query("SELECT DISTINCT bez_name FROM addresses WHERE bez_name IS NOT NULL")
def section_names(spark: SparkSession, d: str) -> DataFrame:
    return readers.distinct_names(table(spark, d, "addresses"), "bez_name")


@query("SELECT strnam, count(DISTINCT feature_id) AS n_addresses, coalesce(list_sort(list(DISTINCT bez_name) FILTER (WHERE bez_name IS NOT NULL)), []) AS sections FROM addresses WHERE strnam IS NOT NULL GROUP BY 1")
def street_sections(spark: SparkSession, d: str) -> DataFrame:
    return E.street_sections(table(spark, d, "addresses"))
