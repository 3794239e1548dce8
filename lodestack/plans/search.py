"""Search: a table of requests in, ranked passages and documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import enough_words, fetch_size
from ..operators import ivf
from ..operators.embed import embed
from ..operators.lookup import RangedStore
from ..operators.ranking import lexical, rank_documents, rerank
from ..operators.topk import exact_topk, ranked
from ..session import written

DEFAULTS = {"k": 10, "return_fulltext": False, "rerank": True, "initial_k": 25, "min_words": None}
MOST = {"k": 100, "initial_k": 1000}


def with_defaults(requests: DataFrame) -> DataFrame:
    """query_id and query, and each setting that is missing or null at its default."""
    kinds = {"k": "int", "initial_k": "int", "min_words": "int", "return_fulltext": "boolean", "rerank": "boolean"}
    for name, value in DEFAULTS.items():
        given = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(given, F.lit(value)).cast(kinds[name]))
    return requests


def valid() -> Column:
    return F.col("k").between(1, MOST["k"]) & F.col("initial_k").between(1, MOST["initial_k"])


def accepted(requests: DataFrame) -> DataFrame:
    """Valid requests with base_k and fetch_k. Blank queries stay, and find nothing."""
    base = F.when(F.col("rerank"), F.col("initial_k")).otherwise(F.col("k"))
    return with_defaults(requests).where(valid()).withColumn("base_k", base).withColumn("fetch_k", fetch_size(F.col("base_k"), F.col("min_words")))


def rejected(requests: DataFrame) -> DataFrame:
    return with_defaults(requests).where(~valid())


def with_vectors(requests: DataFrame, **how) -> DataFrame:
    """Adds qvec, the query embedded as passages are; `how` goes to `embed`."""
    vectors = embed(requests.select("query_id", F.col("query").alias("text")), "query_id", output="qvec", **how)
    return requests.drop("qvec").join(vectors, "query_id")


#: Columns of passages that results carry, where the table has them.
PASSAGE_COLUMNS = ("passage_file", "passage_position", "doc_file", "doc_position")


def search_passages(requests: DataFrame, passages: DataFrame | RangedStore, candidates: Callable[[DataFrame, int], DataFrame], scorer: Callable[[DataFrame], DataFrame] | None = lexical) -> DataFrame:
    """Ranked passages of `accepted` requests that carry qvec.

    `candidates` gives query_id, passage_id, score for queries and a number, in the form of exact or index search; it is asked for the
    largest fetch_k, and each query has its own beside it, so that a request for many does not make the others fetch as many. Fetching and the word filter come before the cut to base_k, which comes before re-ranking and the
    cut to k; the word filter stays above the top-k, since below it would change what is fetched.
    """
    asked = requests.where(F.col("query").rlike("\\S"))
    most = asked.agg(F.max("fetch_k")).first()[0] or 1
    settings = asked.select("query_id", "query", "k", "base_k", "fetch_k", "min_words", "rerank")
    extra = ["nprobe"] if "nprobe" in asked.columns else []
    found = candidates(asked.select("query_id", "qvec", "fetch_k", *extra), most).join(settings, "query_id")
    found = found.where(F.col("rank") <= F.col("fetch_k")).drop("rank")
    if isinstance(passages, RangedStore):
        found = written(found, "found")  # it says what to read, and is joined to that
        passages = passages.near(found)
    rows = found.join(passages.select("passage_id", "doc_id", F.col("text").alias("passage_text"), *(c for c in PASSAGE_COLUMNS if c in passages.columns)), "passage_id")
    rows = rows.where(enough_words(F.col("passage_text"), F.col("min_words")))
    rows = ranked(rows, F.col("base_k"))
    plain = rows.where(~F.col("rerank")).withColumn("rerank_score", F.lit(None).cast("double")).where("rank <= k")
    again = rerank(rows.where("rerank"), scorer, F.col("k"))
    return plain.unionByName(again).drop("base_k", "fetch_k", "min_words")


def search_documents(found: DataFrame, docs: DataFrame | RangedStore, ranking="occurrence") -> DataFrame:
    """Ranked documents of found passages; their texts are read after the cut."""
    best = rank_documents(found, ranking)
    if isinstance(docs, RangedStore):
        best = written(best, "documents")
        docs = docs.near(best)
    return best.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")


def responses(requests: DataFrame, found: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per request: query, results (empty where nothing was found) and documents (null unless asked for)."""
    listed = lambda df, *columns: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_list"))
    hits = listed(found, "passage_id", "doc_id", "score", "rerank_score", "passage_text", *(c for c in PASSAGE_COLUMNS if c in found.columns)).withColumnRenamed("_list", "results")
    out = requests.select("query_id", "query", "return_fulltext").join(hits, "query_id", "left")
    empty = F.from_json(F.lit("[]"), hits.schema["results"].dataType)
    out = out.withColumn("results", F.coalesce("results", empty))
    if documents is None:
        return out.drop("return_fulltext")
    docs = listed(documents, "doc_id", "occurrences", "doc_text").withColumnRenamed("_list", "documents")
    none = F.from_json(F.lit("[]"), docs.schema["documents"].dataType)
    out = out.join(docs, "query_id", "left").withColumn("documents", F.when(F.col("return_fulltext"), F.coalesce("documents", none)))
    return out.drop("return_fulltext")


def exact(embeddings: DataFrame, **how) -> Callable[[DataFrame, int], DataFrame]:
    """Candidates by exact search."""
    return lambda queries, k: exact_topk(queries, embeddings, k, **how)


def indexed(postings: DataFrame, q: ivf.Quantiser, nprobe: int = 256, embeddings: DataFrame | None = None, wider: int = 1) -> Callable[[DataFrame, int], DataFrame]:
    """Candidates from the index, over `nprobe` lists or as many as a query's own column nprobe says.

    With `embeddings`, `wider` times as many are fetched by their codes and scored again exactly.
    """

    def candidates(queries: DataFrame, k: int) -> DataFrame:
        if embeddings is not None and "fetch_k" in queries.columns:
            queries = queries.withColumn("fetch_k", F.col("fetch_k") * wider)
        found = ivf.search(queries, postings, q, k * wider if embeddings is not None else k, nprobe)
        return found if embeddings is None else ivf.rescored(found, queries, embeddings, k)

    return candidates


#: Neighbours of a query in a batch job, unless the caller says otherwise.
BATCH_K = 4096


def batch_retrieval(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Per query, parallel lists of passages, ids, scores and domains in rank order."""
    rows = found.join(passages.select("passage_id", "text", "domain"), "passage_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "passage_id", "score", "text", "domain")))
    out = rows.groupBy("query_id").agg(ordered.alias("r"))
    return out.select("query_id", *(F.col(f"r.{c}").alias(f"{c}s") for c in ("passage_id", "score", "text", "domain")))


def keep_order(rows: DataFrame, by: str = "query_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
