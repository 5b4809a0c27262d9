"""Documents: splitting, chunk identity, embedding, collections and vector search."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import col
from cohortry.functions.text import (
    DEFAULT_QUESTION, PROMPT_DEFAULTS, context_text, fill_template, joined_or_default, recursive_chunks,
    search_text, window_chunks,
)
from cohortry.operators.aggregate import top_k_per_group
from cohortry.operators.join import unseen
from cohortry.operators.split import retrieval_confidence
from cohortry.operators.validate import dedup_first
from cohortry.plans.session import cut_lineage, scratch_path, spread
from cohortry.plans.skew import small_side, within

QUERY_PAGE = 4_000
DOCS_AT_ONCE = 2_048  # of a task, compared with a page of queries
HITS_BOUND = 100_000
PAGE_BLOCK = 1_024
DIGITS = 10  # distances are rounded so that equal vectors tie exactly


def split_abstracts(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per non-blank piece of a dump cut at blank lines, numbered from 0.

    Blank pieces are removed inside the array, so the numbering needs no shuffle.
    """
    pieces = F.filter(F.split(F.col(text), "\n\n", -1), lambda p: p.rlike(r"(?U)\S"))
    return df.select(*keys, F.posexplode(pieces).alias("ordinal", "content"))


def chunk_documents(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Add ``chunks``: the recursive splitter over Arrow batches; one array per input row."""
    return df.withColumn("chunks", recursive_chunks(text, size, overlap))


def chunk_windows(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Add ``chunks``: fixed windows, expressions only."""
    return df.withColumn("chunks", window_chunks(text, size, overlap))


def number_chunks(df: DataFrame, source: str, page: str | None = None, kind: str | None = None) -> DataFrame:
    """One row per chunk: (id, content, metadata), the index running over the pages of a source.

    ``df`` has one row per source (and page) with ``chunks``. Page offsets are
    summed over blocks of pages first, so a source with very many pages is not
    sorted by one task. With pages ``df`` is read twice: store it first if its
    chunks are costly.
    """
    stem = F.regexp_replace(F.regexp_extract(F.col(source), r"([^/]+)$", 1), r"\.[^.]+$", "")
    if page is None:
        placed = df.withColumn("__offset", F.lit(0).cast("bigint"))
    else:
        sized = df.withColumns({
            "__n": F.size("chunks").cast("bigint"),
            "__block": F.floor(F.col(page) / F.lit(PAGE_BLOCK)),
        })
        blocks = sized.groupBy(F.col(source).alias("__s"), F.col("__block").alias("__b")).agg(F.sum("__n").alias("__t"))
        earlier = Window.partitionBy("__s").orderBy("__b")
        blocks = blocks.withColumn("__before", F.sum("__t").over(earlier) - F.col("__t"))
        inside = Window.partitionBy(source, "__block").orderBy(page)
        placed = (
            sized.join(blocks, (F.col(source) == F.col("__s")) & (F.col("__block") == F.col("__b")))
            .withColumn("__offset", F.col("__before") + F.sum("__n").over(inside) - F.col("__n"))
        )
    kept = [source] + ([page] if page else [])
    rows = placed.select(*kept, "__offset", F.posexplode("chunks").alias("__pos", "content"))
    index = F.col("__offset") + F.col("__pos")
    entries = [F.lit("source"), F.col(source).cast("string"), F.lit("chunk_index"), index.cast("string")]
    if page:
        entries += [F.lit("page"), F.col(page).cast("string")]
    if kind:
        entries += [F.lit("type"), F.lit(kind)]
    return rows.select(
        F.concat(stem, F.lit("_"), index.cast("string")).alias("id"),
        "content",
        F.create_map(*entries).alias("metadata"),
    )


def fit_embedding(df: DataFrame, text: str = "content", dim: int = 256, min_docs: int = 0) -> PipelineModel:
    """Hashed TF-IDF with unit length; fitted with one pass over the documents."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim),
        IDF(inputCol="__tf", outputCol="__idf", minDocFreq=min_docs),
        Normalizer(inputCol="__idf", outputCol="__unit", p=2.0),
    ]).fit(df.select(F.coalesce(F.col(text), F.lit("")).alias(text)))


def embed(df: DataFrame, model: PipelineModel, text: str = "content", name: str = "embedding") -> DataFrame:
    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    out = model.transform(filled).withColumn(name, vector_to_array("__unit", dtype="float32"))
    return out.drop("__words", "__tf", "__idf", "__unit")


def embed_tfidf(df: DataFrame, text: str = "content", dim: int = 256) -> DataFrame:
    return embed(df, fit_embedding(df, text, dim), text)


def add_documents(collection: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows to append: ids not yet in the collection, the first of each id."""
    first = dedup_first(new, key, [F.md5(F.col("content")) if "content" in new.columns else F.col(key)])
    return unseen(first, collection, key)


def vector_search(docs: DataFrame, queries: DataFrame, k: int = 5, metadata: Mapping[str, str] | None = None,
                  doc_id: str = "id", embedding: str = "embedding", query_id: str = "query_id",
                  query_embedding: str = "embedding") -> DataFrame:
    """(query, rank, doc, distance): the k smallest cosine distances of every query.

    Exact. One pass over the documents per page of queries: each Arrow batch is
    multiplied with the query matrix, only what is as near as a query's k-th so far is looked at, and a task sends on
    its k best per query, so only those candidates are shuffled. Queries are read a page at a time, and the
    pages together are the whole query table.

    A zero vector, on either side, is at distance 1 from everything; null
    vectors take no part. Of rows with one query id the one with the smallest
    vector counts.
    """
    if metadata:
        for name, value in metadata.items():
            docs = docs.filter(F.try_element_at("metadata", F.lit(name)) == F.lit(value))
    wanted = (
        queries.select(F.col(query_id).alias("query_id"), F.col(query_embedding).alias("vector"))
        .filter(F.col("vector").isNotNull()).groupBy("query_id").agg(F.min("vector").alias("vector"))
    )
    if within(wanted.select("query_id"), QUERY_PAGE):
        return _page_hits(docs, wanted, k, doc_id, embedding)

    # many queries: one job per page, each adding its hits to a stored table
    spark = docs.sparkSession
    wanted = cut_lineage(wanted)
    vectors = cut_lineage(wanted.groupBy("vector").agg(F.min("query_id").alias("query_id")))  # equal ones are searched once
    n = vectors.count() // (QUERY_PAGE // 2) + 1
    slot = F.pmod(F.xxhash64("query_id"), F.lit(n))
    # every page reads the documents: they are dealt over the cores once
    dealt = cut_lineage(spread(docs.select(doc_id, embedding).filter(F.col(embedding).isNotNull())), "vectors")
    path = scratch_path(spark, "hits")
    for i in range(n):
        _page_hits(dealt, vectors.filter(slot == i), k, doc_id, embedding).write.mode("append").parquet(path)
    found = spark.read.parquet(path).withColumnRenamed("query_id", "__first")
    same = vectors.withColumnRenamed("query_id", "__same").join(wanted, "vector").select("__same", "query_id")
    return found.join(same, F.col("__first").eqNullSafe(F.col("__same"))).select("query_id", *[c for c in found.columns if c != "__first"])


def _page_hits(docs: DataFrame, page: DataFrame, k: int, doc_id: str, embedding: str) -> DataFrame:
    rows = page.collect()
    query_type = page.schema["query_id"].dataType
    if rows:
        found = _nearest_candidates(docs, rows, k, doc_id, embedding, query_type)
    else:
        kinds = query_type.simpleString(), docs.schema[doc_id].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], "query_id {}, doc_id {}, distance double".format(*kinds))
    return top_k_per_group(found, ["query_id"], "distance", k, ["doc_id"], descending=False)


def _nearest_candidates(docs: DataFrame, rows: Sequence, k: int, doc_id: str, embedding: str, query_type) -> DataFrame:
    """Per task, the k nearest documents for each query of the page."""
    names = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms == 0.0, 1.0, norms)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple] = [(np.empty(0), None)] * len(names)
        last = np.full(len(names), np.inf)  # distance of each query's k-th so far
        for batch in batches:
            for start in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.iloc[start:start + DOCS_AT_ONCE]
                vectors = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                cosine = (vectors / np.where(lengths == 0.0, 1.0, lengths)) @ matrix.T
                ids = part["doc_id"].to_numpy()
                # a little more than what rounding may bring to the k-th distance
                near_enough = ~(cosine < 1.0 - last - 10.0 ** -DIGITS)
                for q in np.flatnonzero(near_enough.any(axis=0)):
                    close = np.flatnonzero(near_enough[:, q])
                    near, known = np.round(1.0 - cosine[close, q], DIGITS), ids[close]
                    if len(near) > k:  # all rows up to the k-th distance, ties included
                        first = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1])
                        near, known = near[first], known[first]
                    if best[q][1] is not None:
                        near = np.concatenate([best[q][0], near])
                        known = np.concatenate([best[q][1], known])
                    first = np.lexsort((known, near))[:k]
                    best[q] = (near[first], known[first])
                    if len(first) == k:
                        last[q] = near[first[-1]]
        found = [(name, near, known) for name, (near, known) in zip(names, best) if known is not None]
        if found:
            yield pd.DataFrame({"query_id": [name for name, near, _ in found for _ in near],
                                "doc_id": np.concatenate([known for *_, known in found]),
                                "distance": np.concatenate([near for _, near, _ in found])})

    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(embedding).alias("embedding"))
        .filter(F.col("embedding").isNotNull())
        .mapInPandas(nearest, f"query_id {query_type.simpleString()}, doc_id {id_type}, distance double")
    )


def retrieved_contexts(hits: DataFrame, docs: DataFrame, doc_id: str = "id", content: str = "content") -> DataFrame:
    """(query, context): numbered contents in rank order; at most k per query.

    The hits are few: as a small local table they are sent to the documents,
    whose texts then stay where they are.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content"))
    found = texts.join(small_side(hits.select("query_id", "rank", "doc_id"), HITS_BOUND), "doc_id")
    ordered = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("hits"))
    return ordered.select("query_id", context_text(F.transform("hits", lambda h: h["content"])).alias("context"))


def build_prompts(patients: DataFrame, context: str | Column = "context", question: str = DEFAULT_QUESTION,
                  genes: str = "genes", treatments: str = "previous_treatments") -> DataFrame:
    """Add ``prompt``; missing values take the stated defaults."""

    def optional(name: str) -> Column:
        return F.col(name) if name in patients.columns else F.lit(None).cast("string")

    def listed(name: str, default: str) -> Column:
        if name not in patients.columns:
            return F.lit(default)
        return joined_or_default(name, default)

    return patients.withColumn("prompt", fill_template({
        "context": F.coalesce(col(context), F.lit("")),
        "seizure_type": optional("seizure_type"),
        "seizure_frequency": optional("seizure_frequency"),
        "genotype": listed(genes, PROMPT_DEFAULTS["genotype"]),
        "previous_treatments": listed(treatments, PROMPT_DEFAULTS["previous_treatments"]),
        "treatment_response": optional("treatment_response"),
        "question": F.lit(question),
    }))


def patient_genes(patients: DataFrame, variants: str = "genetic_variants") -> DataFrame:
    """Add ``genes``: the gene of every nested variant, in order."""
    return patients.withColumn("genes", F.transform(F.col(variants), lambda v: v["gene"]))


def recommendation_context(patients: DataFrame, docs: DataFrame, model: PipelineModel, k: int = 5,
                           question: str = DEFAULT_QUESTION, patient_id: str = "patient_id") -> DataFrame:
    """Per patient: search text, retrieved context, prompt and confidence.

    ``docs`` has (id, content, embedding); ``model`` embeds the search text the same way.
    """
    named = patient_genes(patients) if "genetic_variants" in patients.columns else patients
    genes = F.col("genes") if "genes" in named.columns else None
    treatments = F.col("previous_treatments") if "previous_treatments" in named.columns else None
    asked = named.withColumn("search_text", search_text("seizure_type", genes, treatments))
    queries = embed(
        asked.select(F.col(patient_id).alias("query_id"), F.col("search_text").alias("content")), model
    ).select("query_id", "embedding")
    hits = cut_lineage(vector_search(docs, queries, k))  # read twice below
    confidence = retrieval_confidence(hits)
    contexts = retrieved_contexts(hits, docs)
    out = (
        asked.join(contexts.withColumnRenamed("query_id", patient_id), patient_id, "left")
        .join(confidence.withColumnRenamed("query_id", patient_id), patient_id, "left")
        .fillna(0.0, subset=["confidence"])
    )
    return build_prompts(out, "context", question)
