"""The registered queries of the search engine, each over whole tables, and the SQL that says the same.

`embeddings` stand for passages: passage_id is vec_id, the document is the one with that id, and every vector whose id
divides by 100 is a query. `documents.source` is the file, `events` the request log.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.vectors import masked_mean
from .operators import ivf, living, lookup, metrics, ranking, verify
from .operators.embed import embed, embed_again, embed_missing
from .operators.ids import dense_ids, line_positions, starts
from .operators.passages import passage_starts, passage_table, passages, per_file
from .operators.topk import exact_topk
from .plans import build as corpus_build
from .plans import search as S
from .session import shared_path, table, written
from .sources import catalog
from .streaming.maintain import grow, grown, maintain

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Whole numbers as long, which is what SQL engines count in."""
            out = f(spark, sf_dir)
            return out.select(*(F.col(c).cast("long") if kind == "int" else F.col(c) for c, kind in out.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.replace("::INT ", "::BIGINT ")
        return run

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding", F.col("label").alias("file_id"))


def _queries(v: DataFrame) -> DataFrame:
    return v.where("passage_id % 100 = 0").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))


def _seeds(v: DataFrame, n: int = 8) -> np.ndarray:
    """The first vectors as centroids."""
    return np.array([r.embedding for r in v.where(F.col("passage_id") < n).orderBy("passage_id").collect()], np.float64)


def _score(c: str = "score"):
    return (F.round(c, 6) + 0.0).alias("score")


# Exact search

_TOPK = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS passage_id, {score} AS s FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, passage_id) AS rank FROM s)
SELECT query_id, passage_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10
"""
_IP = "list_inner_product(v, embedding::DOUBLE[])"


@register(_TOPK.format(score=_IP))
def exact_topk_ip(spark, d):
    v = _vectors(spark, d)
    return exact_topk(_queries(v), v, 10).select("query_id", "passage_id", "rank", _score())


@register(_TOPK.format(score="0.0 - list_distance(v, embedding::DOUBLE[])"))
def exact_topk_neg_l2(spark, d):
    v = _vectors(spark, d)
    return exact_topk(_queries(v), v, 10, "l2").select("query_id", "passage_id", "rank", _score())


@register(_TOPK.format(score=_IP).replace("rank, round(s, 6) AS score FROM r WHERE rank <= 10", "rank FROM r WHERE rank <= 1500"))
def exact_topk_1500(spark, d):
    """More neighbours than Spark's window limit cuts by itself: tasks keep the running best."""
    v = _vectors(spark, d)
    return exact_topk(_queries(v), v, 1500).select("query_id", "passage_id", "rank")


# Passages

_CHUNKS = r"""
WITH w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < {size} THEN 1
             ELSE len(w) // {size} + CASE WHEN len(w) % {size} >= {least} THEN 1 ELSE 0 END END AS n FROM w),
c AS (SELECT doc_id, source, w, n, unnest(range(n)) AS i FROM n),
p AS (SELECT doc_id, source, i AS chunk_index, w[i * {size} + 1 : CASE WHEN i = n - 1 THEN len(w) ELSE (i + 1) * {size} END] AS part FROM c)
"""


def _chunks(spark, d, size, least):
    out = passages(table(spark, d, "documents").select("doc_id", "text"), size, least)
    return out.select("doc_id", "chunk_index", "n_tokens", F.md5("text").alias("text_md5"))


_CHUNK_ROWS = "SELECT doc_id, chunk_index, len(part) AS n_tokens, md5(array_to_string(part, ' ')) AS text_md5 FROM p"


@register(_CHUNKS.format(size=128, least=64) + _CHUNK_ROWS)
def passage_chunks_128_64(spark, d):
    return _chunks(spark, d, 128, 64)


@register(_CHUNKS.format(size=256, least=128) + _CHUNK_ROWS)
def passage_chunks_256_128(spark, d):
    return _chunks(spark, d, 256, 128)


@register(_CHUNKS.format(size=128, least=64) + "SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS passage_id, doc_id, chunk_index FROM p")
def passage_ids_dense(spark, d):
    """From counts alone: a document's passages are numbered from its start on."""
    begun = passage_starts(table(spark, d, "documents").select("doc_id", "text")).where("n > 0")
    rows = begun.select("doc_id", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_index"))
    return rows.select((F.col("start") + F.col("chunk_index")).alias("passage_id"), "doc_id", "chunk_index")


@register("SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id, doc_id, source FROM documents")
def document_ids_dense(spark, d):
    return dense_ids(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], "new_id")


@register(_CHUNKS.format(size=128, least=64) + "SELECT source, count(*) AS n, sum(count(*)) OVER (ORDER BY source)::BIGINT AS upto FROM p GROUP BY source")
def doc_passage_counts(spark, d):
    return per_file(passages(table(spark, d, "documents").select("doc_id", "source", "text")), "source")


@register("SELECT source, count(*) AS n, (sum(count(*)) OVER (ORDER BY source) - count(*))::BIGINT AS start FROM documents GROUP BY source")
def file_starts(spark, d):
    return starts(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source")


@register(r"""SELECT doc_id, m::BIGINT AS min_words, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n_words
FROM documents, (VALUES (0), (50), (200)) t(m)
WHERE m <= 0 OR len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) >= m""")
def min_words_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(50), F.lit(200))).alias("min_words"))
    return docs.where(T.enough_words(F.col("text"), F.col("min_words"))).select("doc_id", "min_words", F.size(T.tokens(F.col("text"))).alias("n_words"))


@register("""WITH r AS (SELECT doc_id, (doc_id % 100 + 1)::INT AS k, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 400)::INT END AS m FROM documents)
SELECT doc_id, CASE WHEN m IS NULL OR m <= 0 THEN k ELSE least(256, k * (1 + least(4, greatest(1, ceil(m / 50)))))::INT END AS fetch_k FROM r""")
def fetch_k_rule(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100 + 1).cast("int").alias("k"), F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 400).cast("int")).alias("m"))
    return docs.select("doc_id", T.fetch_size(F.col("k"), F.col("m")).alias("fetch_k"))


@register(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')[1:16] AS w FROM documents)
SELECT doc_id, array_to_string(list_concat(w, list_transform(range(16 - len(w)), lambda x: '-')), ' ') AS padded, len(w) AS mask_sum FROM w""")
def padded_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    cut, mask = T.padded(F.col("w"), 16, "-")
    return docs.select("doc_id", F.array_join(cut, " ").alias("padded"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@register("SELECT doc_id, substr(text, 1, 100) AS preview FROM documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"


@register(f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents),
n AS (SELECT doc_id, (('0x' || substr(md5('0:' || t), 1, 8))::BIGINT % 64)::INT AS dim, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT doc_id, dim, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT, 5)::DOUBLE AS value FROM n""")
def default_embedding(spark, d):
    rows = embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return rows.select("doc_id", "dim", F.round("value", 5).cast("double").alias("value"))


@register("""SELECT label::BIGINT AS label, i - 1 AS dim, round(avg(x::DOUBLE), 6) AS mean
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY label, i""")
def mean_pool(spark, d):
    rows = table(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    rows = rows.where("mask <> 0").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@register("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, i % 4 AS dim, round(avg(x), 6) AS mean FROM x WHERE (i // 4) % 3 <> 2 GROUP BY 1, 2""")
def mean_pool_rows(spark, d):
    """The whole embedding as token vectors of four dimensions, every third one masked."""
    parts = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 4 - 1).cast("int")), lambda i: F.slice("embedding", (i * 4 + 1).cast("int"), 4).cast("array<double>"))
    masks = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 4 - 1).cast("int")), lambda i: (i % 3 != 2).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", parts.alias("parts"), masks.alias("masks"))
    rows = rows.select("vec_id", F.posexplode(masked_mean(F.col("parts"), F.col("masks"), 4)).alias("dim", "mean"))
    return rows.select("vec_id", "dim", F.round("mean", 6).alias("mean"))


# Search


def _requests(spark, d, **settings) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    rows = _queries(_vectors(spark, d)).join(docs, "query_id", "left").withColumn("query", F.coalesce("query", F.lit("")))
    return S.accepted(rows.withColumns({k: F.lit(v) for k, v in settings.items()}))


def _passages(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text", F.col("source").alias("file_name"))
    return docs.withColumn("doc_id", F.col("passage_id") % 97)


_FOUND = """
WITH q AS (SELECT e.vec_id AS query_id, coalesce(d.text, '') AS query, e.embedding::DOUBLE[] AS v
           FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 100 = 0),
s AS (SELECT query_id, query, vec_id AS passage_id, round(list_inner_product(v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings WHERE regexp_matches(query, '\\S')),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS r FROM s) WHERE r <= {fetch}),
t AS (SELECT f.*, d.text, d.doc_id % 97 AS doc_id FROM f JOIN documents d ON d.doc_id = f.passage_id WHERE {words}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS r0 FROM t) WHERE r0 <= {base}),
""".replace("\\\\", "\\")
_PLAIN = "p AS (SELECT query_id, passage_id, doc_id, score, NULL::DOUBLE AS rerank_score, r0 AS rank FROM b WHERE r0 <= {k})"
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"
_RERANKED = f"""
l AS (SELECT *, {_TOKENS.format('query')} AS qt, {_TOKENS.format('text')} AS pt FROM b),
x AS (SELECT *, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, pt)) / len(qt) ELSE 0.0 END AS rs FROM l),
p AS (SELECT * FROM (SELECT query_id, passage_id, doc_id, score, rs AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, r0) AS rank FROM x) WHERE rank <= {{k}})
"""
_OUT = " SELECT query_id, passage_id, doc_id, rank, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM p"
_ENOUGH = r"len(list_filter(regexp_split_to_array(d.text, '\s+'), lambda x: x <> '')) >= 200"


def _found(spark, d, **settings):
    return S.search_passages(_requests(spark, d, **settings), _passages(spark, d), S.exact(_vectors(spark, d)))


def _shown(found):
    return found.select("query_id", "passage_id", "doc_id", "rank", _score(), F.round("rerank_score", 6).alias("rerank_score"))


@register(_FOUND.format(fetch=10, words="true", base=10) + _PLAIN.format(k=10) + _OUT)
def search_passages(spark, d):
    return _shown(_found(spark, d, rerank=False))


@register(_FOUND.format(fetch=50, words=_ENOUGH, base=10) + _PLAIN.format(k=10) + _OUT)
def search_min_words(spark, d):
    return _shown(_found(spark, d, rerank=False, min_words=200))


@register(_FOUND.format(fetch=25, words="true", base=25) + _RERANKED.format(k=10) + _OUT)
def search_reranked(spark, d):
    return _shown(_found(spark, d))


_DOCS = """, g AS (SELECT query_id, doc_id, count(*) AS occurrences, sum(score) AS total_score, min(rank)::DOUBLE AS first_rank FROM p GROUP BY ALL)
SELECT query_id, doc_id, occurrences, round(total_score, 6) AS total_score, first_rank,
       row_number() OVER (PARTITION BY query_id ORDER BY {order}, first_rank, doc_id) AS rank FROM g"""
_FIFTY = _FOUND.format(fetch=50, words="true", base=50) + _PLAIN.format(k=50)


def _ranked_documents(spark, d, rule):
    out = ranking.rank_documents(_found(spark, d, rerank=False, k=50), rule)
    return out.select("query_id", "doc_id", "occurrences", F.round("total_score", 6).alias("total_score"), "first_rank", "rank")


@register(_FIFTY + _DOCS.format(order="occurrences DESC"))
def rank_docs_occurrence(spark, d):
    return _ranked_documents(spark, d, "occurrence")


@register(_FIFTY + _DOCS.format(order="round(total_score, 9) DESC"))
def rank_docs_score_sum(spark, d):
    return _ranked_documents(spark, d, "score_sum")


@register(_FIFTY + _DOCS.format(order="first_rank"))
def rank_docs_best_passage(spark, d):
    return _ranked_documents(spark, d, "best_passage")


@register(_FIFTY + """, g AS (SELECT query_id, doc_id, count(*) AS occurrences, min(rank) AS first_rank FROM p GROUP BY ALL)
SELECT g.query_id, g.doc_id, occurrences, row_number() OVER (PARTITION BY g.query_id ORDER BY occurrences DESC, first_rank, g.doc_id) AS rank, md5(d.text) AS text_md5
FROM g JOIN documents d ON d.doc_id = g.doc_id""")
def search_with_documents(spark, d):
    found = _found(spark, d, rerank=False, k=50, return_fulltext=True)
    return S.search_documents(found, table(spark, d, "documents")).select("query_id", "doc_id", "occurrences", "rank", F.md5("doc_text").alias("text_md5"))


@register(_FOUND.format(fetch=25, words="true", base=25) + _RERANKED.format(k=10) + """
SELECT q.query_id, q.query, count(p.passage_id) AS n_results, count(DISTINCT p.doc_id) AS n_documents, min(p.passage_id) FILTER (p.rank = 1) AS best
FROM q LEFT JOIN p USING (query_id) GROUP BY ALL""")
def search_responses(spark, d):
    requests = _requests(spark, d, return_fulltext=True)
    found = S.search_passages(requests, _passages(spark, d), S.exact(_vectors(spark, d)))
    docs = S.search_documents(found, table(spark, d, "documents"))
    out = S.responses(requests, found, docs)
    return out.select("query_id", "query", F.size("results").cast("long").alias("n_results"), F.size("documents").cast("long").alias("n_documents"), F.get("results", F.lit(0))["passage_id"].alias("best"))


@register("""SELECT doc_id AS query_id, CASE WHEN k BETWEEN 1 AND 100 AND i BETWEEN 1 AND 1000 THEN 'accepted' ELSE 'rejected' END AS status
FROM (SELECT doc_id, doc_id % 103 AS k, CASE WHEN doc_id % 5 = 0 THEN 25 ELSE doc_id * 7 % 1100 END AS i FROM documents)""")
def request_validation(spark, d):
    i = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") * 7 % 1100).cast("int")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), (F.col("doc_id") % 103).cast("int").alias("k"), i.alias("initial_k"))
    good, bad = S.accepted(rows), S.rejected(rows)
    return good.select("query_id", F.lit("accepted").alias("status")).unionByName(bad.select("query_id", F.lit("rejected").alias("status")))


@register(f"""WITH b AS (SELECT item_id AS query_id, item_id, text AS query, row_number() OVER (ORDER BY item_id) - 1 AS n FROM benchmark),
c AS (SELECT b.query_id, b.query, d.doc_id AS passage_id, d.text, row_number() OVER (PARTITION BY b.query_id ORDER BY d.doc_id) AS r0
      FROM documents d JOIN b ON b.n = d.doc_id % (SELECT count(*) FROM benchmark)),
l AS (SELECT *, {_TOKENS.format('query')} AS qt, {_TOKENS.format("coalesce(text, '')")} AS pt FROM c),
x AS (SELECT *, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, pt)) / len(qt) ELSE 0.0 END AS s FROM l)
SELECT * FROM (SELECT query_id, passage_id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r0) AS rank FROM x) WHERE rank <= 10""")
def rerank_lexical(spark, d):
    items = dense_ids(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), ["query_id"], "n")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("passage_text"), (F.col("doc_id") % items.count()).alias("n"))
    pairs = docs.join(items, "n").withColumn("rank", F.col("passage_id"))  # the order that ties keep
    return ranking.rerank(pairs, ranking.lexical, 10).select("query_id", "passage_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@register("""WITH w AS (SELECT unnest([doc_id, -1 - doc_id, doc_id + 1000000000000]) AS doc_id FROM documents)
SELECT w.doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' ELSE 'found' END AS status, md5(d.text) AS text_md5 FROM w LEFT JOIN documents d USING (doc_id)""")
def get_document(spark, d):
    docs = table(spark, d, "documents")
    x = F.col("doc_id")
    wanted = docs.select(F.explode(F.array(x, -1 - x, x + 1000000000000)).alias("doc_id"))
    return lookup.documents_by_id(wanted, docs).select("doc_id", "status", F.md5("doc_text").alias("text_md5"))


@register("SELECT e.vec_id AS passage_id, d.doc_id, d.source, md5(d.text) AS text_md5 FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def passage_to_document(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("vec_id").alias("doc_id"))
    return lookup.documents_of(rows, table(spark, d, "documents").select("doc_id", "source", "text")).select("passage_id", "doc_id", "source", F.md5("text").alias("text_md5"))


@register("SELECT l.doc_id AS passage_id, l.quality::BIGINT AS position, md5(d.text) AS text_md5 FROM labels l JOIN documents d USING (doc_id)")
def passages_in_order(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("passage_id"), F.col("quality").alias("position"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    return lookup.passages_by_id(ids, rows).select("passage_id", "position", F.md5("text").alias("text_md5"))


@register("SELECT doc_id AS passage_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def lost_passages(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"))
    return lookup.lost_ids(ids, _vectors(spark, d))


def _ranged(spark, rows: DataFrame, key: str) -> lookup.RangedStore:
    return lookup.write_ranged(rows, shared_path(spark, "ranged"), key, 500)


@register(SQL["get_document"])
def get_document_ranged(spark, d):
    """The same from a store in folders of ids, of which only those asked for are read."""
    docs = table(spark, d, "documents")
    x = F.col("doc_id")
    wanted = docs.select(F.explode(F.array(x, -1 - x, x + 1000000000000)).alias("doc_id"))
    return lookup.documents_by_id(wanted, _ranged(spark, docs, "doc_id")).select("doc_id", "status", F.md5("doc_text").alias("text_md5"))


@register(SQL["search_with_documents"])
def search_ranged(spark, d):
    """Search whose passages and documents come from stores in folders of ids."""
    passages, docs = _ranged(spark, _passages(spark, d), "passage_id"), _ranged(spark, table(spark, d, "documents"), "doc_id")
    found = S.search_passages(_requests(spark, d, rerank=False, k=50, return_fulltext=True), passages, S.exact(_vectors(spark, d)))
    return S.search_documents(found, docs).select("query_id", "doc_id", "occurrences", "rank", F.md5("doc_text").alias("text_md5"))


# Index

_LISTS = "c0 AS (SELECT vec_id AS list_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 8)"
_ASSIGN = "(SELECT vec_id, list_id FROM (SELECT e.vec_id, c.list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], c.c) DESC, c.list_id) AS r FROM embeddings e, {c} c) WHERE r = 1)"
_MEANS = """{a} AS {assign},
{m} AS (SELECT list_id, i, avg(x::DOUBLE) AS x FROM (SELECT a.list_id, unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS i FROM embeddings e JOIN {a} a USING (vec_id)) GROUP BY ALL),
{n} AS (SELECT list_id, list(x ORDER BY i) AS c FROM {m} GROUP BY list_id)"""


@register(f"WITH {_LISTS} SELECT vec_id AS passage_id, list_id::INT AS list_id FROM {_ASSIGN.format(c='c0')}")
def coarse_assign(spark, d):
    v = _vectors(spark, d)
    return ivf.assign(v, ivf.Quantiser(_seeds(v)))


@register("WITH " + ",\n".join([_LISTS, _MEANS.format(a="a1", m="m1", n="c1", assign=_ASSIGN.format(c="c0")), _MEANS.format(a="a2", m="m2", n="c2", assign=_ASSIGN.format(c="c1"))]) + "\nSELECT list_id::INT AS list_id, (i - 1)::INT AS dim, round(x, 6) AS value FROM m2")
def kmeans_fixed_init(spark, d):
    v = _vectors(spark, d)
    c = ivf.lloyd(v, _seeds(v), 2)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list_id int, c array<double>")  # eight lists
    return rows.select("list_id", F.posexplode("c").alias("dim", "value")).select("list_id", "dim", F.round("value", 6).alias("value"))


_PROBES = f"""WITH {_LISTS}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT query_id, list_id::INT AS list_id, list_inner_product(v, c) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(v, c) DESC, list_id) AS r FROM q, c0)
SELECT query_id, list_id, round(s, 6) AS coarse FROM r WHERE r <= """


@register(_PROBES + "3")
def probe_lists(spark, d):
    v = _vectors(spark, d)
    return ivf.probes(_queries(v), ivf.Quantiser(_seeds(v)), 3).select("query_id", "list_id", F.round("coarse", 6).alias("coarse"))


@register(_PROBES + "1 + query_id // 100 % 8")
def probes_per_query(spark, d):
    """Each query says how many lists it probes."""
    v = _vectors(spark, d)
    asked = _queries(v).withColumn("nprobe", (1 + F.floor(F.col("query_id") / 100) % 8).cast("int"))
    return ivf.probes(asked, ivf.Quantiser(_seeds(v)), 3).select("query_id", "list_id", F.round("coarse", 6).alias("coarse"))


@register(_TOPK.format(score=_IP))
def ivf_full_probe(spark, d):
    """All lists probed and vectors kept whole: equal to exact search."""
    v = _vectors(spark, d)
    q = ivf.Quantiser(_seeds(v))
    return ivf.search(_queries(v), _stored(spark, ivf.encode(v, q)), q, 10, 8).select("query_id", "passage_id", "rank", _score())


def _stored(spark: SparkSession, postings: DataFrame) -> DataFrame:
    """The index on disk, one folder per list."""
    path = shared_path(spark, "postings")
    ivf.write_postings(postings, path)
    return ivf.read_postings(spark, path)


def _trained(v: DataFrame, n_lists: int = 16, subs: int = 16, **how) -> ivf.Quantiser:
    return ivf.train(ivf.sample(v, 100_000), n_lists, subs, **how)


#: Lists that a vector stands in, and candidates scored exactly, whatever the number of vectors.
BORDER, CANDIDATES = 3, 400


def _lists(n: int) -> int:
    """Lists for n vectors: of about four blocks, 64 at least. A quarter of them is probed."""
    return max(64, n // (4 * ivf.BLOCK))


@register()
def ivfpq_search(spark, d):
    """Turned product codes of vectors that stand in three lists each; a quarter of the lists, then exact scores of 400 candidates."""
    v = _vectors(spark, d)
    lists = _lists(v.count())
    q = _trained(v, lists, turns=3, border=BORDER)
    found = ivf.search(_queries(v), _stored(spark, ivf.encode(v, q)), q, CANDIDATES, lists // 4)
    return ivf.rescored(found, _queries(v), v, 10).select("query_id", "passage_id", "rank", _score())


@register(_TOPK.format(score=_IP))
def exact_topk_bounded(spark, d):
    """Exact search that passes over lists which cannot hold one of a query's best."""
    v = _vectors(spark, d)
    q = ivf.train(ivf.sample(v, 100_000), 32, None)
    found = ivf.exact_search(_queries(v), _stored(spark, ivf.encode(v, q)), q, ivf.bounds(v, q), 10, 2)
    return found.select("query_id", "passage_id", "rank", _score())


_HASHED = f"""t AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents),
n AS (SELECT doc_id, (('0x' || substr(md5('0:' || t), 1, 8))::BIGINT % 64)::INT AS dim, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
e AS (SELECT doc_id, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS x FROM n)"""


@register(f"""WITH {_HASHED},
s AS (SELECT q.doc_id AS query_id, e.doc_id AS passage_id, round(sum(q.x * e.x), 9) AS score FROM e q JOIN e USING (dim) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s)
SELECT query_id, passage_id, passage_id % 97 AS doc_id, rank, round(score, 6) AS score, d.source || '_passages.jsonl' AS passage_file FROM r JOIN documents d ON d.doc_id = passage_id WHERE rank <= 10""")
def search_indexed(spark, d):
    """Queries as texts: embedded, searched in an index of the embedded documents with every list probed, and joined to passages."""
    docs = table(spark, d, "documents")
    v = written(embed(docs.select(F.col("doc_id").alias("passage_id"), "text"), "passage_id"), "vectors")
    q = ivf.train(v, 16, None)
    asked = S.accepted(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), F.lit(False).alias("rerank")))
    passages = _passages(spark, d).withColumn("passage_file", T.passage_file(F.col("file_name")))
    found = S.search_passages(S.with_vectors(asked), passages, S.indexed(_stored(spark, ivf.encode(v, q)), q, len(q.centroids)))
    return found.select("query_id", "passage_id", "doc_id", "rank", _score(), "passage_file")


@register(f"""WITH f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS file_id FROM (SELECT DISTINCT source FROM documents)),
w AS (SELECT doc_id, CASE WHEN file_id % 2 = 1 THEN {_WORDS} ELSE {_WORDS}[1:16] END AS w FROM documents JOIN f USING (source)),
t AS (SELECT doc_id, unnest(w) AS t FROM w),
n AS (SELECT doc_id, (('0x' || substr(md5('0:' || t), 1, 8))::BIGINT % 64)::INT AS dim, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT doc_id AS passage_id, dim, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT, 5)::DOUBLE AS value FROM n""")
def embeddings_renewed(spark, d):
    """A store of embeddings by an encoder that reads 16 tokens, some of whose files are embedded again by one that reads all."""
    docs = table(spark, d, "documents")
    files = catalog.file_catalogue(docs, "source")
    rows = docs.join(F.broadcast(files), F.col("source") == F.col("file_name")).select(F.col("doc_id").alias("passage_id"), "file_id", "text")
    store = shared_path(spark, "vectors")
    for _ in range(2):  # the second time nothing is missing
        embed_missing(rows, store, max_length=16)
    embed_again(rows, store, [r.file_id for r in files.where("file_id % 2 = 1").collect()])
    out = spark.read.parquet(store).select("passage_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return out.select("passage_id", "dim", F.round("value", 5).cast("double").alias("value"))


@register("""WITH c AS (SELECT label, count(*) AS n, greatest(1, 300 // count(*) OVER ()) AS quota FROM embeddings GROUP BY label),
m AS (SELECT vec_id, label, ('0x' || substr(md5('1234:' || vec_id), 1, 10))::BIGINT AS h FROM embeddings),
r AS (SELECT vec_id, m.label, quota, row_number() OVER (PARTITION BY m.label ORDER BY h, vec_id) AS r FROM m JOIN c USING (label) WHERE h < least(1.0::DOUBLE, (2.0 * quota + 50)::DOUBLE / n) * 1099511627776)
SELECT vec_id AS passage_id, label::BIGINT AS file_id FROM r WHERE r <= quota""")
def training_sample(spark, d):
    v = _vectors(spark, d)
    path = shared_path(spark, "sample")
    return catalog.cached(spark, path, lambda: ivf.sample(v, 300)).select("passage_id", "file_id")


def _entries(postings: DataFrame, q: ivf.Quantiser) -> DataFrame:
    """passage_id, list_id and two sums over the stored numbers of every entry of an index of whole vectors."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(x.sum(axis=1), 4)), pa.array(np.round((x * np.arange(1, x.shape[1] + 1)).sum(axis=1), 3))], ["passage_id", "list_id", "total", "weighed"])

    found = ivf.entries(postings, q.code_size).select("passage_id", F.col("list_id").cast("long"), "code")
    return found.mapInArrow(run, "passage_id long, list_id long, total double, weighed double").select("passage_id", "list_id", (F.col("total") + 0.0).alias("total"), (F.col("weighed") + 0.0).alias("weighed"))


_ENTRIES = f"""WITH {_LISTS}, v AS (SELECT vec_id, i, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
s AS (SELECT vec_id, round(sum(x), 4) + 0.0 AS total, round(sum(x * i), 3) + 0.0 AS weighed FROM v GROUP BY 1)
SELECT a.vec_id AS passage_id, a.list_id, total, weighed FROM {_ASSIGN.format(c='c0')} a JOIN s USING (vec_id)"""


@register(_ENTRIES)
def ivf_append(spark, d):
    """Half of the vectors, then all of them twice: every one is in the index once, in its list, with its own numbers."""
    v = _vectors(spark, d)
    q, path = ivf.Quantiser(_seeds(v)), shared_path(spark, "postings")
    ivf.write_postings(ivf.encode(v.where("passage_id % 2 = 0"), q), path)
    for _ in range(2):
        ivf.append(ivf.read_postings(spark, path), v, q, path)
    return _entries(ivf.read_postings(spark, path), q)


@register(f"WITH {_LISTS} SELECT e.label::VARCHAR AS domain, a.vec_id AS passage_id, a.list_id::INT AS list_id FROM {_ASSIGN.format(c='c0')} a JOIN embeddings e USING (vec_id) WHERE e.label::VARCHAR <= '4'")
def domain_snapshot(spark, d):
    v = _vectors(spark, d)
    posts = ivf.encode(v, ivf.Quantiser(_seeds(v)), "file_id")
    return ivf.entry_ids(ivf.in_domains(posts, "4"))


@register(_ENTRIES)
def stream_maintenance(spark, d):
    """Embeddings that arrive as several files, taken up by a stream; what it has indexed."""
    v = _vectors(spark, d)
    base = shared_path(spark, "stream")
    v.repartition(3, "passage_id").write.parquet(f"{base}/in")
    q = ivf.Quantiser(_seeds(v))
    for _ in range(2):  # the second run finds nothing new
        maintain(spark, f"{base}/in", v.schema, q, f"{base}/postings", f"{base}/checkpoint", files_per_batch=1).awaitTermination()
    return _entries(ivf.read_postings(spark, f"{base}/postings"), q)


def _some(v: DataFrame, every: int, keep: int = 0) -> DataFrame:
    return v.where(F.col("passage_id") % every == keep)


@register(_ENTRIES + " WHERE a.vec_id % 7 <> 0")
def index_replaced(spark, d):
    """An index of wrong vectors for a third of the ids: these are replaced, and a seventh of all is taken out; what searches see then."""
    v = _vectors(spark, d)
    q, path = ivf.Quantiser(_seeds(v)), shared_path(spark, "index")
    wrong = v.withColumn("embedding", F.when(F.col("passage_id") % 3 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    living.add(spark, path, wrong, q)
    living.put(spark, path, _some(v, 3), q)
    living.remove(spark, path, _some(v, 7))
    return _entries(living.read(spark, path), q)


@register(_ENTRIES + " WHERE a.vec_id % 5 <> 0")
def index_compacted(spark, d):
    """Ten batches, entries taken out between them, merged by fours: the same entries, once each."""
    v = _vectors(spark, d)
    q, path = ivf.Quantiser(_seeds(v)), shared_path(spark, "index")
    for i in range(10):
        living.add(spark, path, _some(v, 10, i), q)
        if i == 5:
            living.remove(spark, path, _some(v, 5))
            living.compact(spark, path, q, 4)
    living.remove(spark, path, _some(v, 5))
    living.compact(spark, path, q, 4)
    living.vacuum(spark, path)
    return _entries(living.read(spark, path), q)


def _json_files(spark, d, base: str, split: bool = False) -> int:
    """Documents as JSON lines at `base`/in under their source's name, in the order of doc_id; how many files.

    A source has one file, or with `split` as many as the tasks that its documents were dealt to, numbered in order, so that no task has a whole source.
    """
    line = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    dealt = docs.repartitionByRange("source", "doc_id") if split else docs.repartition("source")
    dealt.sortWithinPartitions("source", "doc_id").select("source", line.alias("value")).write.partitionBy("source").text(f"{base}/written")
    n_files = 0
    for n in (n for n in catalog.names_below(spark, f"{base}/written") if n.startswith("source=")):  # a name per source
        parts = sorted(catalog.files_below(spark, f"{base}/written/{n}"), key=lambda f: (len(f), f))  # by the task's number
        for i, f in enumerate(parts):
            catalog.move(spark, f, f"{base}/in/{n.removeprefix('source=')}--raw_passages-{i:06d}.jsonl")
        n_files += len(parts)
    return n_files


@register(_CHUNKS.format(size=128, least=64) + """, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) - 1 AS passage FROM p)
SELECT source AS domain, passage, chunk_index, md5(array_to_string(part, ' ')) AS text_md5, 1 AS entries FROM o""")
def stream_from_files(spark, d):
    """Files of texts, several of a source, taken up by a stream in two batches: passages numbered on from batch to batch, each in the index once."""
    base = shared_path(spark, "stream")
    docs = table(spark, d, "documents")
    n_files = _json_files(spark, d, base, split=True)
    rows = docs.select(F.col("doc_id").alias("passage_id"), "source", "text")
    chosen = ivf.sample(rows.select("passage_id", "source"), 10_000, "source").select("passage_id")  # no text is shuffled, and only the sample embedded
    v = embed(rows.join(F.broadcast(chosen), "passage_id", "left_semi"), "passage_id", carry=("source",))  # at most 10,000 ids
    grow(spark, f"{base}/in", f"{base}/store", ivf.train(v, 8, 16, 6), f"{base}/checkpoint", -(-n_files // 2)).awaitTermination()
    out = grown(spark, f"{base}/store")
    entries = ivf.entry_ids(out["postings"]).groupBy("passage_id").agg(F.count("*").alias("entries"))
    of_files = out["passages"].groupBy("file_id", "file_name").agg(F.min("passage_id").alias("first"), F.count("*").alias("n")).withColumn("domain", T.domain_of(F.col("file_name")))
    earlier = Window.partitionBy("domain").orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = of_files.select("file_id", "domain", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    told = out["passages"].select("file_id", "passage_id", "chunk_index", F.md5("text").alias("text_md5"))  # digests are joined, not texts
    rows = told.join(starts, "file_id").join(entries, "passage_id", "left")
    return rows.select("domain", (F.col("passage_id") + F.col("shift")).alias("passage"), "chunk_index", "text_md5", "entries")


_BATCH = _TOPK.replace("SELECT query_id, passage_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10", """
SELECT query_id, string_agg(passage_id::VARCHAR, ',' ORDER BY rank) AS passages, string_agg(source, ',' ORDER BY rank) AS domains
FROM r JOIN documents d ON d.doc_id = passage_id WHERE rank <= 10 GROUP BY query_id""").format(score=_IP)


def _batch(spark, d, k, text="text"):
    v = _vectors(spark, d)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.expr(text).alias("text"), F.col("source").alias("domain"))
    return S.batch_retrieval(S.exact(v)(_queries(v), k), rows)


@register(_BATCH)
def batch_retrieval(spark, d):
    out = _batch(spark, d, 10)
    return out.select("query_id", F.array_join(F.col("passage_ids").cast("array<string>"), ",").alias("passages"), F.array_join("domains", ",").alias("domains"))


@register(_BATCH.replace("rank <= 10", "rank <= 4096").replace("AS domains", "AS domains, string_agg(md5(coalesce(text, '')), ',' ORDER BY rank) AS digests"))
def batch_retrieval_4096(spark, d):
    """At the batch job's own number of neighbours; the lists have digests of the texts, which are what is compared."""
    out = _batch(spark, d, S.BATCH_K, "md5(coalesce(text, ''))")
    return out.select("query_id", F.array_join(F.col("passage_ids").cast("array<string>"), ",").alias("passages"), F.array_join("domains", ",").alias("domains"), F.array_join("texts", ",").alias("digests"))


# Files

_FILES = "f AS (SELECT source AS file_name, row_number() OVER (ORDER BY source) - 1 AS file_id FROM (SELECT DISTINCT source FROM documents))"


@register(f"WITH {_FILES} SELECT * FROM f")
def file_catalogue(spark, d):
    return catalog.file_catalogue(table(spark, d, "documents"), "source")


@register(f"WITH {_FILES} SELECT *, file_id % 4 AS shard FROM f")
def shard_strided(spark, d):
    return catalog.file_catalogue(table(spark, d, "documents"), "source").withColumn("shard", catalog.strided(F.col("file_id"), 4))


@register(f"WITH {_FILES} SELECT *, ntile(4) OVER (ORDER BY file_id) - 1 AS shard FROM f")
def shard_contiguous(spark, d):
    return catalog.contiguous(catalog.file_catalogue(table(spark, d, "documents"), "source"), 4)


@register("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 5)")
def resume_left_anti(spark, d):
    docs = table(spark, d, "documents")
    return catalog.not_done(docs, docs.where("doc_id < 5"), "source").select("doc_id")


@register("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 20 < 7)")
def missing_files(spark, d):
    docs = table(spark, d, "documents")
    return catalog.missing_files(docs, docs.where("doc_id % 20 < 7"), "source")


@register("""SELECT doc_id, split_part(split_part(n, 'raw_passages', 1), '--', 1) AS domain, regexp_replace(n, '\\.jsonl$', '') || '_passages.jsonl' AS passage_file,
regexp_replace(n, '\\.jsonl$', '') || '_embeddings.parquet' AS embedding_file, source || '_' || doc_id || '.jsonl' AS converted
FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN source || '--part' || doc_id || 'raw_passages-0.jsonl' ELSE source || '.jsonl' END AS n FROM documents)""".replace("\\\\", "\\"))
def domain_of_file(spark, d):
    x = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("--part"), x, F.lit("raw_passages-0.jsonl"))).otherwise(F.concat("source", F.lit(".jsonl")))
    rows = table(spark, d, "documents").select("doc_id", "source", name.alias("n"))
    return rows.select("doc_id", T.domain_of(F.col("n")).alias("domain"), T.passage_file(F.col("n")).alias("passage_file"), T.embedding_file(F.col("n")).alias("embedding_file"), T.converted_file(F.col("source"), F.concat(x, F.lit(".parquet"))).alias("converted"))


@register("SELECT doc_id, source AS folder, md5(text) AS text_md5 FROM documents")
def corpus_scan(spark, d):
    """Documents stored one folder per source, read as a corpus of folders."""
    root = shared_path(spark, "corpus")
    docs = table(spark, d, "documents")
    docs.select("doc_id", "text", F.col("source").alias("folder_name")).write.partitionBy("folder_name").parquet(root)
    return catalog.read_corpus(spark, root).select("doc_id", F.regexp_replace("folder", "^folder_name=", "").alias("folder"), F.md5("text").alias("text_md5"))


@register("SELECT md5(coalesce(text, '')) AS text_md5, count(*) AS n FROM documents GROUP BY 1")
def json_lines(spark, d):
    """Documents written as JSON lines, some without text and some lines blank, and read back."""
    path = shared_path(spark, "lines")
    docs = table(spark, d, "documents")
    docs.select(F.explode(F.array(catalog.json_line("doc_id", "text"), F.lit("  "))).alias("value")).write.text(path)
    return catalog.read_texts(spark, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@register("""WITH l AS (SELECT doc_id, source, strlen(doc_id || '|' || replace(coalesce(text, ''), chr(10), ' ')) + 1 AS size FROM documents)
SELECT doc_id, source, (sum(size) OVER (PARTITION BY source ORDER BY doc_id) - size)::BIGINT AS position FROM l""")
def document_map(spark, d):
    """Documents written as lines, one file per source in the order of ids, and the byte position of each line."""
    path = shared_path(spark, "lines")
    line = F.concat_ws("|", F.col("doc_id").cast("string"), F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    rows = table(spark, d, "documents").select("source", "doc_id", line.alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    at = line_positions(spark, path)
    folder = F.regexp_extract("file_path", "/source=([^/]*)/", 1)
    return at.select(F.substring_index("value", "|", 1).cast("long").alias("doc_id"), folder.alias("source"), "position")


@register("SELECT 'documents' AS file, count(*) AS rows, true AS ok FROM documents UNION ALL SELECT 'labels', count(*), true FROM labels")
def conversion_report(spark, d):
    out = []
    for name in ("documents", "labels"):
        path = shared_path(spark, f"{name}.parquet")
        table(spark, d, name).write.parquet(path)
        report = catalog.conversion_report(spark, catalog.files_below(spark, path))
        out.append(report.agg(F.sum("rows").alias("rows"), F.min("ok").alias("ok")).select(F.lit(name).alias("file"), "rows", "ok"))
    return out[0].unionByName(out[1])


@register("""WITH q AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS total FROM benchmark)
SELECT e.event_id AS request_id, q.item_id FROM events e, q WHERE q.n = ('0x' || substr(md5('42:' || e.event_id), 1, 8))::BIGINT % q.total""")
def query_picks(spark, d):
    items = written(dense_ids(table(spark, d, "benchmark").select("item_id", "text"), ["item_id"], "query_id"), "questions")
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"))
    return catalog.pick_queries(requests, items, items.count()).select("request_id", "item_id")


# Statistics and checks


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.col("value").cast("double").alias("latency"), (F.col("event_type") != "error").alias("success"))


_E = "(SELECT *, value::DOUBLE AS x, event_type <> 'error' AS ok FROM events)"
_METRICS = """count(*) AS total_requests, count(*) FILTER (ok) AS successful_requests, count(*) FILTER (NOT ok) AS failed_requests,
round(100.0 * count(*) FILTER (ok) / count(*), 6) AS success_rate, round(sum(x), 4) AS total_time, round(count(*) / sum(x), 6) AS throughput_serial, min(x) AS min, max(x) AS max,
round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(stddev_pop(x), 6) AS std,
round(coalesce(avg(x) FILTER (ok), 0), 6) AS ok_mean"""
_ROUNDED = {"success_rate": 6, "total_time": 4, "throughput_serial": 6, "mean": 6, "median": 6, "p95": 6, "p99": 6, "std": 6, "ok_mean": 6}


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in _ROUNDED.items() if c in df.columns})


@register(f"SELECT {_METRICS} FROM {_E}")
def latency_metrics(spark, d):
    return _rounded(metrics.latency_metrics(_log(spark, d)))


@register(f"SELECT (user_id % 3)::INT AS concurrency, user_id % 2 = 0 AS fulltext, {_METRICS} FROM {_E} GROUP BY 1, 2")
def load_summary(spark, d):
    log = _log(spark, d).withColumn("concurrency", (F.col("user_id") % 3).cast("int")).withColumn("fulltext", F.col("user_id") % 2 == 0)
    return _rounded(metrics.latency_metrics(log, "concurrency", "fulltext"))


_QS = (0.0, 0.05, 0.5, 0.9, 0.999, 1.0)


@register(" UNION ALL ".join(f"SELECT event_type, {q}::DOUBLE AS q, round(quantile_cont(value::DOUBLE, {q}), 6) AS value FROM events GROUP BY 1" for q in _QS))
def latency_quantiles(spark, d):
    """Exact quantiles by rounds of counts, no group held together."""
    out = metrics.quantiles(_log(spark, d), _QS, "event_type")
    return out.select("event_type", "q", F.round("value", 6).alias("value"))


@register(f"SELECT event_type, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS success_rate, round(avg(x), 6) AS mean FROM {_E} GROUP BY 1")
def warmup_summary(spark, d):
    return _rounded(metrics.warmup_summary(_log(spark, d), "event_type"))


@register(f"SELECT event_type, count(*) AS total_requests, round(count(*) / (max(epoch_us(ts) / 1e6 + x) - min(epoch_us(ts) / 1e6)), 6) AS throughput_wall FROM {_E} GROUP BY 1")
def wall_throughput(spark, d):
    out = metrics.wall_throughput(_log(spark, d), "event_type")
    return out.withColumn("throughput_wall", F.round("throughput_wall", 6))


@register(f"""WITH e AS {_E}, g AS (SELECT event_type, min(x) AS low, max(x) AS high, avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM e GROUP BY 1)
SELECT event_type, (CASE WHEN high > low THEN least(50, floor((x - low) / (high - low) * 50) + 1) ELSE 1 END)::INT AS bin, count(*) AS n, round(any_value(mean), 6) AS mean, round(any_value(median), 6) AS median
FROM e JOIN g USING (event_type) GROUP BY 1, 2""")
def latency_histogram(spark, d):
    return _rounded(metrics.histogram(_log(spark, d), "event_type"))


def _timings(spark, d) -> DataFrame:
    phase = F.element_at(F.array(*map(F.lit, ("embedding", "search", "retrieval", "total"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _log(spark, d).select((F.col("user_id") % 10).alias("query_id"), phase.alias("phase"), F.col("latency").alias("seconds"))


_PHASES = "(SELECT user_id % 10 AS query_id, ['embedding', 'search', 'retrieval', 'total'][event_id % 4 + 1] AS phase, value::DOUBLE AS s FROM events)"


@register(f"SELECT query_id, phase, round(avg(s), 6) AS avg, min(s) AS min, max(s) AS max FROM {_PHASES} GROUP BY 1, 2")
def phase_timings(spark, d):
    return metrics.phase_timings(_timings(spark, d)).withColumn("avg", F.round("avg", 6))


@register(f"""WITH q AS (SELECT query_id, phase, avg(s) AS a FROM {_PHASES} GROUP BY 1, 2),
o AS (SELECT phase, avg(a) AS avg, min(a) AS min, max(a) AS max FROM q GROUP BY 1)
SELECT phase, round(avg, 6) AS avg, round(min, 6) AS min, round(max, 6) AS max, round(100 * avg / (SELECT avg FROM o WHERE phase = 'total'), 6) AS share FROM o""")
def overall_timings(spark, d):
    return metrics.overall_timings(_timings(spark, d)).select("phase", *(F.round(c, 6).alias(c) for c in ("avg", "min", "max", "share")))


@register("""SELECT (SELECT count(*) FROM embeddings) AS total_passages, (SELECT count(DISTINCT label) FROM embeddings) AS num_passage_files,
(SELECT count(*) FROM documents) AS total_documents, (SELECT count(DISTINCT source) FROM documents) AS num_document_files""")
def stats(spark, d):
    return metrics.corpus_stats(_vectors(spark, d), table(spark, d, "documents").withColumn("file_id", F.col("source")))


@register("""WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0), v AS (SELECT vec_id AS i FROM embeddings),
e AS (SELECT i FROM v WHERE i % 7 <> 0 UNION ALL SELECT i + 1000000000000 FROM v WHERE i % 17 = 0), x AS (SELECT i FROM v WHERE i % 5 <> 0 UNION ALL SELECT i FROM v WHERE i % 11 = 0)
SELECT 'document ids dense' AS rule, (count(*) - count(DISTINCT doc_id) + coalesce(max(doc_id) + 1, 0) - count(DISTINCT doc_id))::BIGINT AS violations FROM d
UNION ALL SELECT 'passage ids dense', (count(*) - count(DISTINCT i) + coalesce(max(i) + 1, 0) - count(DISTINCT i))::BIGINT FROM v
UNION ALL SELECT 'passages have documents', count(*) FROM v WHERE i NOT IN (SELECT doc_id FROM d)
UNION ALL SELECT 'passages have embeddings', count(*) FROM v WHERE i NOT IN (SELECT i FROM e)
UNION ALL SELECT 'embeddings have passages', count(*) FROM e WHERE i NOT IN (SELECT i FROM v)
UNION ALL SELECT 'index holds each row once', count(*) FROM (SELECT i FROM x GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'rows are in the index', count(*) FROM e WHERE i NOT IN (SELECT i FROM x)""")
def verify_report(spark, d):
    """Every rule on tables that break it: documents and embeddings lost, embeddings of nothing, index entries lost and repeated."""
    v = _vectors(spark, d)
    q, i = ivf.Quantiser(_seeds(v)), F.col("passage_id")
    extra = v.where(i % 17 == 0).withColumn("passage_id", i + 1000000000000)
    posts = ivf.encode(v.where(i % 5 != 0), q).unionByName(ivf.encode(v.where(i % 11 == 0), q))
    return verify.verify(table(spark, d, "documents").where("doc_id % 13 <> 0"), v.withColumn("doc_id", i), v.where(i % 7 != 0).unionByName(extra), posts)


@register("""SELECT count(*) AS checked, count(*) FILTER (doc_id % 9 = 0) AS missing, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 10 = 0) AS different FROM documents""")
def round_trip(spark, d):
    """Stored texts, some lost and some changed, against their source."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    kept = docs.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")))
    return verify.round_trip(docs, written(kept, "documents"))


@register(_CHUNKS.format(size=128, least=64) + """, n AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id FROM documents)
SELECT row_number() OVER (ORDER BY new_id, chunk_index) - 1 AS passage_id, new_id AS doc_id, chunk_index, source || '_passages.jsonl' AS passage_file, md5(array_to_string(part, ' ')) AS text_md5 FROM p JOIN n USING (doc_id)""".replace("n AS (SELECT doc_id, row", "o AS (SELECT doc_id, row").replace("JOIN n USING", "JOIN o USING"))
def corpus_build_passages(spark, d):
    """Passages of a build whose documents are numbered by file and line, with their files and texts."""
    texts = table(spark, d, "documents").select(F.col("source").alias("file_name"), "text", F.col("doc_id").alias("line"))
    out = corpus_build.build(texts, shared_path(spark, "store"), n_lists=16, subs=None, order=["line"])
    return out["passages"].select("passage_id", "doc_id", "chunk_index", "passage_file", F.md5("text").alias("text_md5"))


_DIGEST = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _digest(*columns):
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns).cast("binary")), 1, 8), 16, 10).cast("long")


@register(_CHUNKS.format(size=128, least=64) + f""", o AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id FROM documents),
k AS (SELECT p.*, new_id, row_number() OVER (ORDER BY new_id, chunk_index) - 1 AS passage_id FROM p JOIN o USING (doc_id))
SELECT 'documents' AS name, count(*) AS n, sum({_DIGEST.format("new_id || ':' || source || ':' || coalesce(text, '')")})::BIGINT AS digest FROM o
UNION ALL SELECT 'passages', count(*), sum({_DIGEST.format("passage_id || ':' || new_id || ':' || chunk_index || ':' || array_to_string(part, ' ')")})::BIGINT FROM k
UNION ALL SELECT 'indexed', count(*), sum({_DIGEST.format("passage_id::VARCHAR")})::BIGINT FROM k
UNION ALL SELECT 'files', count(*), sum({_DIGEST.format("file_id || ':' || source")})::BIGINT FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS file_id FROM (SELECT DISTINCT source FROM documents))
UNION ALL SELECT 'violations', 0, 0""")
def corpus_build_stages(spark, d):
    """Tables of a build by number of rows and the sum of their rows' digests, so that every id, text and place counts."""
    texts = table(spark, d, "documents").select(F.col("source").alias("file_name"), "text", F.col("doc_id").alias("line"))
    out = corpus_build.build(texts, shared_path(spark, "store"), n_lists=16, subs=8, order=["line"])
    told = {
        "documents": (out["documents"], ("doc_id", "file_name", "text")), "passages": (out["cuts"], ("passage_id", "doc_id", "chunk_index", "text")),
        "indexed": (ivf.entry_ids(out["postings"]), ("passage_id",)), "files": (out["files"], ("file_id", "file_name")),
    }
    parts = [df.agg(F.count("*").alias("n"), F.sum(_digest(*columns)).alias("digest")).select(F.lit(n).alias("name"), "n", "digest") for n, (df, columns) in told.items()]
    parts.append(out["report"].agg(F.sum("violations").alias("n")).select(F.lit("violations").alias("name"), "n", F.lit(0).cast("long").alias("digest")))
    return functools.reduce(DataFrame.unionByName, parts)


@register(_CHUNKS.format(size=128, least=64) + """, o AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS new_id, strlen('{"text":' || to_json(coalesce(text, ''))::VARCHAR || '}') + 1 AS size, source FROM documents),
x AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY doc_id) - size)::BIGINT AS doc_position FROM o),
k AS (SELECT p.chunk_index, p.source, x.new_id, x.doc_position, row_number() OVER (ORDER BY new_id, chunk_index) - 1 AS passage_id, array_to_string(part, ' ') AS text FROM p JOIN x USING (doc_id)),
l AS (SELECT *, strlen('{"passage_id":' || passage_id || ',"text":' || to_json(text)::VARCHAR || '}') + 1 AS size FROM k)
SELECT source AS domain, passage_id, new_id AS doc_id, chunk_index, doc_position, (sum(size) OVER (PARTITION BY source ORDER BY passage_id) - size)::BIGINT AS passage_position, md5(text) AS text_md5 FROM l""")
def build_from_files(spark, d):
    """JSON-lines files, one per source, to passages with the byte positions of their documents and of themselves."""
    base = shared_path(spark, "files")
    _json_files(spark, d, base)
    out = corpus_build.build_files(spark, f"{base}/in", f"{base}/store", n_lists=8, subs=None)
    told = out["cuts"].select(T.domain_of(F.col("file_name")).alias("domain"), "passage_id", "doc_id", "chunk_index", "doc_position", F.md5("text").alias("text_md5"))
    return told.join(out["positions"], "passage_id").select("domain", "passage_id", "doc_id", "chunk_index", "doc_position", "passage_position", "text_md5")  # digests are joined, not texts


def _letters(text):
    """A caller's tokenizer: runs of letters and numbers, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@register(_CHUNKS.format(size=128, least=64).replace(r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')", "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')") + "SELECT doc_id, chunk_index, len(part) AS n_tokens, md5(array_to_string(part, '_')) AS text_md5 FROM p")
def passage_chunks_own_tokenizer(spark, d):
    """Passages by a caller's tokenizer and detokenizer."""
    out = passages(table(spark, d, "documents").select("doc_id", "text"), 128, 64, _letters, lambda part: F.array_join(part, "_"))
    return out.select("doc_id", "chunk_index", "n_tokens", F.md5("text").alias("text_md5"))


def _fewest_words(pairs: DataFrame) -> DataFrame:
    """A caller's scorer: shorter passages first."""
    return pairs.withColumn("rerank_score", -F.size(T.tokens(F.col("passage_text"))).cast("double"))


def _last_passage(found: DataFrame) -> DataFrame:
    """A caller's ranking of documents: the one whose last passage comes last is first."""
    grouped = found.groupBy("query_id", "doc_id").agg(F.count("*").alias("occurrences"), F.max("rank").alias("last"))
    order = Window.partitionBy("query_id").orderBy(F.desc("last"), "doc_id")
    return grouped.withColumn("rank", F.row_number().over(order))


@register(_FOUND.format(fetch=25, words="true", base=25) + r"""
x AS (SELECT *, -len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::DOUBLE AS rs FROM b),
p AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, r0) AS rank FROM x) WHERE rank <= 10),
g AS (SELECT query_id, doc_id, count(*) AS occurrences, max(rank) AS last FROM p GROUP BY ALL)
SELECT query_id, doc_id, occurrences, last, row_number() OVER (PARTITION BY query_id ORDER BY last DESC, doc_id) AS rank FROM g""")
def search_own_rules(spark, d):
    """Search with a caller's scorer of pairs and a caller's ranking of documents."""
    found = S.search_passages(_requests(spark, d), _passages(spark, d), S.exact(_vectors(spark, d)), _fewest_words)
    return ranking.rank_documents(found, _last_passage).select("query_id", "doc_id", "occurrences", "last", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search, the documents of what was found, and their ranking."""
    return rank_docs_occurrence(spark, sf_dir)
