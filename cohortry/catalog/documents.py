"""Document and retrieval queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.registry import Tables, query
from cohortry.functions.text import DEFAULT_QUESTION
from cohortry.operators import documents as D
from cohortry.operators.split import retrieval_confidence
from cohortry.pipeline import build_knowledge_base, load_embedding, search_collection
from cohortry.plans.session import scratch_path


@query("s8_split_abstracts", r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal, md5(piece) AS content_md5
FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece
      FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents))
WHERE regexp_matches(piece, '[^\s]')""")
def s8(t: Tables) -> DataFrame:
    dumps = t("documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n\n")).alias("text"))
    out = D.split_abstracts(dumps, "text", ["doc_id"])
    return out.select("doc_id", "ordinal", F.md5("content").alias("content_md5"))


@query("t1_recursive_chunks")
def t1(t: Tables) -> DataFrame:
    chunked = D.chunk_documents(t("documents").select("doc_id", "text"))
    return chunked.select("doc_id", F.posexplode("chunks").alias("chunk_index", "content"))


@query("t1_chunk_invariants", r"""
SELECT doc_id, regexp_matches(text, '\S') AS has_chunks, true AS within_size, true AS parts_of_text, true AS starts_text,
       true AS ends_text FROM documents""")
def t1_invariants(t: Tables) -> DataFrame:
    chunked = D.chunk_documents(t("documents").select("doc_id", "text"))
    c = F.col("chunks")
    lead = F.regexp_replace("text", r"(?U)^\s+", "")
    tail = F.regexp_replace("text", r"(?U)\s+$", "")
    return chunked.select(
        "doc_id", (F.size(c) > 0).alias("has_chunks"),
        F.forall(c, lambda x: (F.length(x) <= 1000) & (F.length(x) > 0)).alias("within_size"),
        F.forall(c, lambda x: F.col("text").contains(x)).alias("parts_of_text"),
        F.coalesce(lead.startswith(F.get(c, F.lit(0))), F.lit(True)).alias("starts_text"),
        F.coalesce(tail.endswith(F.try_element_at(c, F.lit(-1))), F.lit(True)).alias("ends_text"))


@query("t1b_window_chunks", """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 800 + 1, 1000)) AS content_md5
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1
          ELSE CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) + 1 END)) AS i FROM documents)""")
def t1b(t: Tables) -> DataFrame:
    chunked = D.chunk_windows(t("documents").select("doc_id", "text"))
    out = chunked.select("doc_id", F.posexplode("chunks").alias("chunk_index", "content"))
    return out.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("t2_chunk_identity", """
WITH c AS (SELECT 'docs/' || source || '.pdf' AS source, doc_id, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1
          ELSE CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) + 1 END)) AS i, text FROM documents WHERE length(text) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS k FROM c)
SELECT regexp_extract(source, '([^/]+)[.]pdf$', 1) || '_' || k AS id, md5(substr(text, i * 800 + 1, 1000)) AS content_md5,
       source, CAST(doc_id AS VARCHAR) AS page, CAST(k AS VARCHAR) AS chunk_index FROM n""")
def t2(t: Tables) -> DataFrame:
    pages = t("documents").select(F.concat(F.lit("docs/"), "source", F.lit(".pdf")).alias("source"), "doc_id", "text")
    out = D.number_chunks(D.chunk_windows(pages), "source", "doc_id")
    m = F.col("metadata")
    return out.select("id", F.md5("content").alias("content_md5"), m["source"].alias("source"),
                      m["page"].alias("page"), m["chunk_index"].alias("chunk_index"))


@query("t3_embed_tfidf", r"""
SELECT doc_id, CAST(64 AS INTEGER) AS width,
       CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents""")
def t3(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id", F.col("text").alias("content"))
    out = D.embed_tfidf(docs, dim=64)
    return out.select("doc_id", F.size("embedding").alias("width"), F.round(F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("length"))


@query("t4_add_documents", """
SELECT id, min(digest) AS content FROM (SELECT doc_id // 2 AS id, md5(text) AS digest FROM documents)
WHERE id NOT IN (SELECT item_id FROM benchmark) GROUP BY id
""")
def t4(t: Tables) -> DataFrame:
    # the first of each id is the one with the smallest hash of its content
    new = t("documents").select(F.floor(F.col("doc_id") / 2).alias("id"), F.col("text").alias("content"))
    collection = t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return D.add_documents(collection, new).select("id", F.md5("content").alias("content"))


def centroids(t: Tables) -> DataFrame:
    """One query vector per label: the mean of its embeddings."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return t("embeddings").groupBy(F.col("label").alias("query_id")).agg(vector_to_array(mean).alias("embedding"))


CENTROIDS_SQL = """parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
                         FROM embeddings),
centroid AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i)
             GROUP BY label),
hits AS (SELECT c.label AS query_id, vec_id AS doc_id, e.label AS doc_label,
                list_cosine_distance(CAST(embedding AS DOUBLE[]), q) AS distance FROM embeddings e, centroid c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), doc_id) AS rank FROM hits)"""


@query("t5_vector_search", f"""
WITH {CENTROIDS_SQL}
SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def t5(t: Tables) -> DataFrame:
    out = D.vector_search(t("embeddings"), centroids(t), 5, doc_id="vec_id")
    return out.withColumn("distance", F.round("distance", 6))


@query("t5_filtered_search", f"""
WITH {CENTROIDS_SQL},
kept AS (SELECT query_id, doc_id, distance,
                row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), doc_id) AS rank
         FROM hits WHERE doc_label = 3)
SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 5""")
def t5_filtered(t: Tables) -> DataFrame:
    docs = t("embeddings").withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    out = D.vector_search(docs, centroids(t), 5, {"label": "3"}, doc_id="vec_id")
    return out.withColumn("distance", F.round("distance", 6))


@query("t5_many_queries", """
WITH parts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id * 3 AS query_id, v AS q FROM parts UNION ALL SELECT vec_id * 3 + 1, list_reverse(v) FROM parts
      UNION ALL SELECT vec_id * 3 + 2, list_transform(v, lambda x: 0.0::DOUBLE) FROM parts),
hits AS (SELECT query_id, vec_id AS doc_id,
                CASE WHEN query_id % 3 = 2 THEN 1.0::DOUBLE ELSE list_cosine_distance(v, q) END AS distance FROM q, parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), doc_id) AS rank FROM hits)
SELECT query_id, doc_id, abs(round(distance, 6)) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3""")
def t5_many(t: Tables) -> DataFrame:
    # three queries for each vector: itself, turned round, and zero; more than a page of them
    v = F.col("embedding").cast("array<double>")
    kinds = F.array(v, F.reverse(v), F.transform(v, lambda x: F.lit(0.0)))
    queries = t("embeddings").select("vec_id", F.posexplode(kinds).alias("turn", "embedding")).select(
        (F.col("vec_id") * 3 + F.col("turn")).alias("query_id"), "embedding")
    out = D.vector_search(t("embeddings"), queries, 3, doc_id="vec_id")
    return out.withColumn("distance", F.abs(F.round("distance", 6)))


@query("t6_knowledge_base", r"""
SELECT source || '.pdf' AS source, count(*) AS n_pages, CAST(0 AS BIGINT) AS n_abstracts, true AS ids_unique
FROM documents WHERE regexp_matches(text, '\S') GROUP BY source
UNION ALL
SELECT 'item' || item_id, 0, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S'))), true
FROM benchmark WHERE regexp_matches(text, '\S')""")
def t6(t: Tables) -> DataFrame:
    pages = t("documents").select(F.concat("source", F.lit(".pdf")).alias("source"), F.col("doc_id").alias("page"), "text")
    abstracts = t("benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("source"),
                                      F.lit("epilepsy").alias("query"), "text")
    path = scratch_path(t.spark, "knowledge-base")
    stored = build_knowledge_base(t.spark, path, abstracts=abstracts, pages=pages, dim=64)
    return stored.groupBy(F.col("metadata")["source"].alias("source")).agg(
        F.count_distinct(F.col("metadata")["page"]).alias("n_pages"),
        F.count(F.col("metadata")["pmid"]).alias("n_abstracts"),
        (F.count(F.lit(1)) == F.count_distinct("id")).alias("ids_unique"))


def two_builds(t: Tables) -> str:
    """A collection built from even items, then from all of them under a second name."""
    path = scratch_path(t.spark, "two-builds")
    items = t("benchmark").select("item_id", F.lit("epilepsy").alias("query"), F.regexp_replace("text", "\\s+", " ").alias("text"))
    named = lambda df, mark: df.select(F.concat(F.lit(mark), F.col("item_id").cast("string")).alias("source"), "query", "text")
    build_knowledge_base(t.spark, path, abstracts=named(items.filter("item_id % 2 = 0"), "a"), dim=64)
    build_knowledge_base(t.spark, path, abstracts=named(items, "b"), dim=64)
    return path


@query("t6_two_builds", r"""
SELECT 'b' || item_id AS source, CAST(1 AS BIGINT) AS n, item_id % 2 = 0 AS twice, true AS one_vector FROM benchmark
WHERE regexp_matches(text, '\S')""")
def t6_two_builds(t: Tables) -> DataFrame:
    # the same text in two builds has the same vector
    rows = t.spark.read.parquet(two_builds(t)).select(F.col("metadata")["source"].alias("source"), "embedding")
    number = F.substring("source", 2, 20)
    first = rows.filter("source like 'a%'").select(number.alias("k"), F.col("embedding").alias("first"))
    second = rows.filter("source like 'b%'").select("source", number.alias("k"), "embedding")
    return second.join(first, "k", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("first").isNotNull()).alias("twice"),
        F.min(F.coalesce(F.col("first") == F.col("embedding"), F.lit(True))).alias("one_vector"))


@query("t6_search", r"""
SELECT item_id AS query_id, CAST(1 AS INTEGER) AS rank, true AS own_text, true AS near FROM benchmark
WHERE regexp_matches(text, '\S')""")
def t6_search(t: Tables) -> DataFrame:
    # a stored text finds itself, or an equal one, at distance 0
    path = two_builds(t)
    asked = t("benchmark").filter(F.col("text").rlike("\\S")).select(
        F.col("item_id").alias("query_id"), F.regexp_replace("text", "\\s+", " ").alias("content"))
    hits = search_collection(t.spark, path, asked, 1)
    vectors = D.embed(asked, load_embedding(path)).select("query_id", F.col("content").alias("asked"))
    return hits.join(vectors, "query_id").select(
        "query_id", "rank", (F.trim("content") == F.trim("asked")).alias("own_text"), (F.col("distance") < 1e-6).alias("near"))


@query("t7_recommendation_parts", f"""
WITH {CENTROIDS_SQL},
top AS (SELECT query_id, rank, distance, 'label ' || doc_label || ' vector ' || doc_id AS content FROM ranked WHERE rank <= 5)
SELECT query_id, round(sum((1 - distance) / rank) / sum(1.0 / rank), 6) AS confidence,
       string_agg('Fonte ' || rank || ': ' || content, chr(10) || chr(10) ORDER BY rank) AS context
FROM top GROUP BY query_id""")
def t7_parts(t: Tables) -> DataFrame:
    docs = t("embeddings").withColumn("content", F.concat(
        F.lit("label "), F.col("label").cast("string"), F.lit(" vector "), F.col("vec_id").cast("string")))
    hits = D.vector_search(docs, centroids(t), 5, doc_id="vec_id")
    confidence = retrieval_confidence(hits).withColumn("confidence", F.round("confidence", 6))
    return D.retrieved_contexts(hits, docs, "vec_id").join(confidence, "query_id")


@query("t7_recommendation_context")
def t7(t: Tables) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    model = D.fit_embedding(docs, dim=64)
    # one patient per document source: its languages are the treatments, its name the gene
    patients = t("documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("previous_treatments")).select(
        F.col("source").alias("patient_id"), F.lit("the and des").alias("seizure_type"),
        F.array(F.col("source")).alias("genes"), "previous_treatments")
    out = D.recommendation_context(patients, D.embed(docs, model), model, 5, DEFAULT_QUESTION)
    return out.select("patient_id", "search_text", "context", "prompt", "confidence")
