import json
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack import queries
from lodestack.functions import text as T
from lodestack.functions.vectors import inner, masked_mean, negative_distance
from lodestack.operators import ids, ivf, lookup, metrics, ranking, verify
from lodestack.operators.embed import embed, embed_again, embed_missing
from lodestack.operators.passages import passages, passages_by_batch
from lodestack.operators.topk import exact_topk, scored
from lodestack.plans import build, search
from lodestack.session import shared_path
from lodestack.sources import catalog
from lodestack.streaming.maintain import maintain


def vectors(spark, n=300, dim=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    return x, spark.createDataFrame([(i, i % 5, f"d{i % 3}", r.tolist()) for i, r in enumerate(x)], "passage_id long, file_id int, domain string, embedding array<float>")


@pytest.mark.parametrize("size,least,n,want", [
    (128, 64, 0, []), (128, 64, 1, [1]), (128, 64, 128, [128]), (128, 64, 129, [129]), (128, 64, 191, [191]), (128, 64, 192, [128, 64]), (128, 64, 300, [128, 172]),
    (128, 64, 320, [128, 128, 64]), (256, 128, 192, [192]), (256, 128, 300, [300]), (256, 128, 320, [320]),
])
def test_chunk_sizes(spark, size, least, n, want):
    docs = spark.createDataFrame([(7, " ".join(f"t{i}" for i in range(n)))], "doc_id long, text string")
    rows = passages(docs, size, least).orderBy("chunk_index").collect()
    assert [r.n_tokens for r in rows] == want
    assert " ".join(r.text for r in rows) == " ".join(f"t{i}" for i in range(n))


def test_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "a  b", "x"), (4, "a  b", "x")], "doc_id long, text string, chunk string")
    assert [(r.doc_id, r.text, r.chunk) for r in passages(docs).collect()] == [(4, "a b", "x")] * 2
    assert passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k,m,want", [(10, None, 10), (10, 0, 10), (10, 1, 20), (10, 50, 20), (10, 51, 30), (25, 100, 75), (25, 151, 125), (100, 10, 200), (100, 500, 256), (1000, None, 1000), (1000, 1, 256)])
def test_fetch_size(spark, k, m, want):
    row = spark.createDataFrame([(k, m)], "k int, m int").select(T.fetch_size(F.col("k"), F.col("m")).alias("x"))
    assert row.first().x == want


def test_line_positions(spark, tmp_path):
    data = '{"text":"a b"}\n\n{"text":"café x"}\n   \n{"text":"last"}'.encode()
    (tmp_path / "f.jsonl").write_bytes(data)
    assert sorted(r.position for r in ids.line_positions(spark, str(tmp_path)).collect()) == [0, 16, 39]
    texts = [r.text for r in catalog.read_texts(spark, str(tmp_path)).collect()]
    assert sorted(texts) == ["a b", "café x", "last"]


def test_line_positions_in_split_files(spark, tmp_path):
    lines = [f'{{"text":"é {i} {"x" * (i % 50)}"}}' + ("\n" if i % 7 == 0 else "") for i in range(2000)]
    data = "\n".join(lines).encode()
    (tmp_path / "g.jsonl").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = ids.line_positions(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2000
    assert all(data[r.position :].startswith(r.value.encode()) for r in rows)


def test_sums_over_lines_and_totals(spark, tmp_path):
    """Numbers and sums within files that lie in several splits; several totals at once."""
    rng = np.random.default_rng(3)
    files = {f"{n}.txt": ["" if i % 5 == 2 else "x" * int(rng.integers(1, 60)) for i in range(700)] for n in "ab"}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = ids.positioned(spark.read.option("lineSep", "\n").text(str(tmp_path)).select(*ids.line_columns()), n=F.length("value")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in files.items():
        real = [t for t in lines if t]
        got = sorted((r.number, r.n, r.n_before, r.value) for r in rows if r.file_name == name)
        assert got == [(i, len(t), sum(map(len, real[:i])), t) for i, t in enumerate(real)]
    amounts = spark.range(500).select((F.col("id") * 7 % 501).alias("x"), (F.col("id") % 9).alias("n"), F.lit("other").alias("start"))
    out = ids.running_totals(amounts, ["x"], {"at": (None, 5), "before": ("n", 0)}).orderBy("x").collect()
    assert [r["at"] for r in out] == list(range(5, 505)) and [r.before for r in out] == np.concatenate([[0], np.cumsum([r.n for r in out])[:-1]]).tolist()


def test_texts_missing_or_null(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"x":1}\n{"text":null}\n{"text":"a"}\n')
    assert sorted(r.text for r in catalog.read_texts(spark, str(tmp_path)).collect()) == ["", "", "a"]


def test_json_keeps_nulls(spark, tmp_path):
    catalog.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":null}'


def test_conversion_report_of_a_bad_file(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "good"))
    good = str(next((tmp_path / "good").glob("*.parquet")))
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"not parquet")
    rows = {r.path: (r.rows, r.ok) for r in catalog.conversion_report(spark, [good, str(bad)]).collect()}
    assert rows == {good: (5, True), str(bad): (0, False)}


def test_shards(spark):
    files = spark.range(10).withColumnRenamed("id", "file_id")
    assert [r.s for r in files.orderBy("file_id").select(catalog.strided(F.col("file_id"), 4).alias("s")).collect()] == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1]
    assert [r.shard for r in catalog.contiguous(files, 4).orderBy("file_id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("name,want", [("wiki--part1raw_passages-0.jsonl", "wiki"), ("books_passages.jsonl", "books_passages.jsonl"), ("a/b/wiki--x.jsonl", "wiki")])
def test_domain(spark, name, want):
    assert spark.range(1).select(T.domain_of(F.lit(name)).alias("d")).first().d == want


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = ids.dense_ids(rows, ["x"], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1000))
    assert ids.dense_ids(rows.limit(0), ["x"], "n").count() == 0


def test_document_ranking(spark):
    found = spark.createDataFrame([(1, 1, 7, 0.90), (1, 2, 3, 0.80), (1, 3, 7, 0.50), (1, 4, 5, 0.45), (1, 5, 3, 0.70)], "query_id long, rank int, doc_id long, score double")
    order = lambda rule: [r.doc_id for r in ranking.rank_documents(found, rule).orderBy("rank").collect()]
    assert order("occurrence") == [7, 3, 5]
    assert order("score_sum") == [3, 7, 5]
    assert order("best_passage") == [7, 3, 5]
    assert order(lambda df: ranking.by_occurrence(df)) == [7, 3, 5]


def test_latency_metrics(spark):
    log = spark.createDataFrame([(x, True) for x in (0.1, 0.2, 0.3, 0.4, 1.0)], "latency double, success boolean")
    r = metrics.latency_metrics(log).first()
    assert (r.total_requests, r.failed_requests) == (5, 0)
    for name, want in (("total_time", 2.0), ("throughput_serial", 2.5), ("mean", 0.4), ("median", 0.3), ("p95", 0.88), ("p99", 0.976), ("std", 0.316228)):
        assert math.isclose(r[name], want, abs_tol=1e-6), name
    empty = metrics.latency_metrics(log.limit(0)).first()
    assert set(empty.asDict().values()) == {0}


def test_masked_mean(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "v array<array<double>>, m array<int>")
    assert [r.x for r in row.select(masked_mean(F.col("v"), F.col("m"), 2).alias("x")).collect()] == [[2.0, 3.0], None]


def test_exact_topk_by_brute_force(spark):
    x, v = vectors(spark)
    q = v.where("passage_id < 7").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))
    for metric, s in (("ip", x[:7].astype(float) @ x.T.astype(float)), ("l2", -np.linalg.norm(x[:7, None].astype(float) - x[None], axis=2))):
        got = exact_topk(q, v, 5, metric, query_block=3, block=64).collect()
        want = {(i, j) for i in range(7) for j in np.lexsort((np.arange(300), -np.round(s[i], 9)))[:5].tolist()}
        assert {(r.query_id, r.passage_id) for r in got} == want
    assert exact_topk(q, v.limit(0), 5).count() == 0
    assert exact_topk(q.limit(0), v, 5).count() == 0
    rows = q.crossJoin(v).select(inner(F.col("qvec"), F.col("embedding")).alias("a"), negative_distance(F.col("qvec"), F.col("embedding")).alias("b")).count()
    assert rows == 2100


def test_index_recall_append_and_domains(spark):
    x, v = vectors(spark, 600)
    q = v.where("passage_id % 20 = 0").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))
    model = ivf.train(ivf.sample(v, 500), 8, 8, 6)
    exact = exact_topk(q, v, 10)
    whole = ivf.Quantiser(model.centroids)
    same = ivf.search(q, ivf.encode(v, whole), whole, 10, 99)
    assert ivf.recall(same, exact).first().recall == 1.0
    posts = ivf.encode(v, model, "domain")
    recalls = [ivf.recall(ivf.rescored(ivf.search(q, posts, model, 80, n), q, v, 10), exact).first().recall for n in (1, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] >= 0.9
    path = shared_path(spark, "posts")
    ivf.write_postings(ivf.encode(v.where("passage_id < 300"), model, "domain"), path)
    for _ in range(2):
        ivf.append(ivf.read_postings(spark, path), v, model, path, domain="domain")
    assert ivf.next_id(v, "passage_id") == 600
    a = ivf.search(q, ivf.read_postings(spark, path), model, 10, 8).select("query_id", "passage_id", "score")
    assert sorted(a.collect()) == sorted(ivf.search(q, posts, model, 10, 8).select("query_id", "passage_id", "score").collect())
    ids_ = ivf.in_domains(posts, "d1").select(F.explode("passage_ids").alias("i")).where("i % 3 = 2")
    assert ids_.count() == 0
    store = shared_path(spark, "model")
    ivf.save(model, spark, store)
    back = ivf.load(spark, store, "hashed")
    assert np.allclose(back.centroids, model.centroids) and np.allclose(back.codebooks, model.codebooks)
    with pytest.raises(ValueError):
        ivf.load(spark, store, "another")


@pytest.mark.parametrize("n", [500, 2000, 32000])
def test_registered_recall_as_tables_grow(spark, tmp_path, n):
    vectors(spark, n, 64)[1].select(F.col("passage_id").alias("vec_id"), "embedding", F.col("file_id").alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    found, exact = (queries.QUERIES[q](spark, str(tmp_path)) for q in ("ivfpq_search", "exact_topk_ip"))
    assert ivf.recall(found, exact).first().recall >= 0.9


def test_training_is_distributed_and_equals_numpy(spark, monkeypatch):
    """Coarse rounds against plain numpy from the same start; codebooks against a search over all codes."""
    x, v = vectors(spark, 400)
    start = x[:6].astype(float)
    c = start.copy()
    for _ in range(3):
        near = (x.astype(float) @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].astype(float).mean(axis=0) if (near == j).any() else c[j] for j in range(6)])
    for most in (ivf.DRIVER_BYTES, 0):
        monkeypatch.setattr(ivf, "DRIVER_BYTES", most)
        assert np.allclose(ivf.lloyd(v, start, 3), c)
    q = ivf.train(v, 6, 4, 4)
    assert q.centroids.shape == (6, 16) and q.codebooks.shape == (4, 16, 4)
    lists = q.assign(x.astype(float))
    rest = (x - q.centroids[lists]).reshape(400, 4, 4)
    far = ((rest[:, :, None] - q.codebooks[None]) ** 2).sum(axis=3)
    codes = q.encode(x.astype(float), lists)
    assert (codes == far.argmin(axis=2)).mean() > 0.999
    assert far.min(axis=2).sum() < 0.7 * (rest**2).sum()
    s = q.score(x[:3].astype(float), 2, codes)
    want = [[x[i] @ q.centroids[2] + sum(x[i].reshape(4, 4)[m] @ q.codebooks[m, k[m]] for m in range(4)) for k in codes] for i in range(3)]
    assert np.allclose(s, want)
    same = v.where("passage_id < 3")
    assert len(ivf.train(same.unionByName(same), 8, None).centroids) == 3


def test_training_at_size(spark):
    """200,000 vectors: rounds over the sample where it lies."""
    rows = spark.range(200_000, numPartitions=8).select(F.col("id").alias("passage_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.xxhash64("id", i) / float(1 << 63)).cast("float")).alias("embedding"))
    q = ivf.train(rows, 32, 4, 6, 4)
    n = ivf.assign(rows, q).groupBy("list_id").count().collect()
    assert len(n) == 32 and max(r["count"] for r in n) < 10 * 200_000 / 32


def test_only_probed_lists_are_read(spark):
    x, v = vectors(spark, 300)
    model = ivf.Quantiser(np.eye(16)[:8])
    path = shared_path(spark, "lists")
    ivf.write_postings(ivf.encode(v, model), path)
    q = v.where("passage_id < 2").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found = ivf.search(q, ivf.read_postings(spark, path), model, 5, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(list_id" in plan
    assert {r.passage_id for r in found.where("rank = 1").collect()} == {0, 1}
    # Queries with a probe number of their own
    got = ivf.search(q.withColumn("nprobe", F.lit(8)), ivf.read_postings(spark, path), model, 5, 1)
    assert sorted((r.query_id, r.passage_id) for r in got.collect()) == sorted((r.query_id, r.passage_id) for r in exact_topk(q, v, 5).collect())


def test_build_from_files_and_indexed_search(spark, tmp_path):
    """JSON lines to answers: ids by (file, line), byte positions that hold, results with files and positions, custom plug points."""
    texts = {f"{n}.jsonl": [" ".join(f"{n}{i}w{(i * j) % 90}" for j in range(1, 20 + 60 * i)) for i in range(4)] for n in ("beta", "alpha")}
    (tmp_path / "in").mkdir()
    for name, lines in texts.items():
        (tmp_path / "in" / name).write_text("\n\n".join(json.dumps({"text": t}) for t in lines) + "\n")
    out = build.build_files(spark, str(tmp_path / "in"), shared_path(spark, "store"), n_lists=2, subs=None)
    docs = out["documents"].orderBy("doc_id").collect()
    assert [(r.file_name, r.text) for r in docs] == [(n, t) for n in sorted(texts) for t in texts[n]]
    for r in docs:
        raw = (tmp_path / "in" / r.file_name).read_bytes()[r.doc_position :]
        assert json.loads(raw.split(b"\n")[0])["text"] == r.text
    assert out["report"].agg(F.sum("violations")).first()[0] == 0
    build.write_passage_files(out["passages"], str(tmp_path / "passages"))
    for r in out["passages"].collect():
        (file,) = (tmp_path / "passages" / f"file_id={r.file_id}").glob("part-*")
        line = json.loads(file.read_bytes()[r.passage_position :].split(b"\n")[0])
        assert (line["passage_id"], line["text"]) == (r.passage_id, r.text)
    asked = search.accepted(spark.createDataFrame([(1, texts["beta.jsonl"][3][:400], 3, False), (2, "  ", 3, False), (3, "beta3w1 beta3w2", 2, True)], "query_id long, query string, k int, rerank boolean"))
    find = search.indexed(out["postings"], out["quantiser"], 2, out["embeddings"], 4)
    found = search.search_passages(search.with_vectors(asked), out["passages"], find)
    rows = found.orderBy("query_id", "rank").collect()
    assert [r.query_id for r in rows] == [1, 1, 1, 3, 3] and rows[0].doc_file == "beta.jsonl" and rows[0].passage_file == "beta_passages.jsonl" and rows[0].passage_position is not None
    first = search.responses(asked, found).where("query_id = 1").first().results[0]
    assert first.doc_file == "beta.jsonl" and first.doc_position == docs[7].doc_position
    turned = search.search_passages(search.with_vectors(asked), out["passages"], find, scorer=lambda p: p.withColumn("rerank_score", -F.col("passage_id").cast("double")))
    assert [r.passage_id for r in turned.where("query_id = 3").orderBy("rank").collect()] == sorted(r.passage_id for r in turned.where("query_id = 3").collect())
    with pytest.raises(ValueError, match="missing"):
        build.complete(out["passages"], out["embeddings"].where("file_id = 0"))


def test_sample_quota(spark):
    _, v = vectors(spark, 100)
    got = ivf.sample(v.where("passage_id > 2"), 20).groupBy("file_id").count().collect()
    assert {r["count"] for r in got} == {4} and len(got) == 5
    few = ivf.sample(v, 3)
    assert few.count() == 3 and few.select("file_id").distinct().count() == 3
    plan = ivf.sample(v, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_stream_equals_one_build(spark, tmp_path):
    _, v = vectors(spark, 200)
    model = ivf.Quantiser(np.eye(16)[:4])
    v.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        maintain(spark, str(tmp_path / "in"), v.schema, model, str(tmp_path / "posts"), str(tmp_path / "check"), "domain", 2).awaitTermination()
    flat = lambda df: sorted(df.select("list_id", "domain", F.explode("passage_ids")).collect())
    assert flat(ivf.read_postings(spark, str(tmp_path / "posts"))) == flat(ivf.encode(v, model, "domain"))
    plan = ivf.read_postings(spark, str(tmp_path / "posts")).where("list_id in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan.replace("isnotnull(list_id#", "list_id#") or "PartitionFilters: [isnotnull(list_id" in plan


def test_requests(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 101), (3, "c", 100), (4, " ", None)], "query_id long, query string, k int")
    assert {r.query_id for r in search.rejected(rows).collect()} == {1, 2}
    good = {r.query_id: (r.k, r.base_k, r.fetch_k) for r in search.accepted(rows).collect()}
    assert good == {3: (100, 25, 25), 4: (10, 25, 25)}


def test_search_blank_queries_and_few_candidates(spark):
    x, v = vectors(spark, 4)
    asked = search.accepted(spark.createDataFrame([(1, "w0", x[0].tolist(), True), (2, " ", x[1].tolist(), True)], "query_id long, query string, qvec array<float>, return_fulltext boolean"))
    rows = spark.createDataFrame([(i, i // 2, f"w{i} b") for i in range(4)], "passage_id long, doc_id long, text string")
    docs = spark.createDataFrame([(i, f"doc {i}") for i in range(2)], "doc_id long, text string")
    found = search.search_passages(asked, rows, search.exact(v))
    assert found.count() == 4
    assert found.where("rank = 1").first().passage_id == 0
    plan = search.search_passages(asked, rows, search.exact(v))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    out = {r.query_id: r for r in search.responses(asked, found, search.search_documents(found, docs)).collect()}
    assert len(out[1].results) == 4 and out[2].results == [] and out[2].documents == []
    unranked = search.search_passages(asked, rows, search.exact(v), scorer=None)
    assert unranked.where("rerank_score is not null").count() == 0


def test_lookup(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, text string")
    got = lookup.documents_by_id(spark.createDataFrame([(-1,), (1,), (9,)], "doc_id long"), docs).collect()
    assert {(r.doc_id, r.status) for r in got} == {(-1, "not_found"), (1, "found"), (9, "not_found")}


def test_verify_and_round_trip(spark):
    docs = spark.createDataFrame([(0, "a"), (2, "b")], "doc_id long, text string")
    rows = spark.createDataFrame([(0, 0), (1, 5)], "passage_id long, doc_id long")
    got = {r.rule: r.violations for r in verify.verify(docs, rows).collect()}
    assert got["passage ids dense"] == 0 and got["passages have documents"] == 1 and got["document ids dense"] > 0
    r = verify.round_trip(docs, spark.createDataFrame([(0, "x")], "doc_id long, text string")).first()
    assert (r.checked, r.missing, r.different) == (2, 1, 1)


def test_build_reuses_and_verifies(spark):
    texts = spark.createDataFrame([(f"f{i % 3}.jsonl", " ".join(f"w{(i * j) % 50}" for j in range(1 + i * 5)), i) for i in range(60)] + [("f0.jsonl", None, 99)], "file_name string, text string, line int")
    store = shared_path(spark, "store")
    out = build.build(texts, store, n_lists=4, subs=4, bits=4, sample_size=50, dim=16, order=["line"])
    assert out["documents"].count() == 61
    assert out["report"].agg(F.sum("violations")).first()[0] == 0
    again = build.build(texts.limit(1), store, n_lists=4, subs=4, bits=4, dim=16)
    assert again["documents"].count() == 61
    fewer = build.build(texts.limit(1), store, n_lists=2, subs=4, bits=4, dim=16, retrain=True)
    assert len(fewer["quantiser"].centroids) == 2 and fewer["documents"].count() == 61 and fewer["report"].agg(F.sum("violations")).first()[0] == 0
    anew = build.build(texts.where("line < 7"), store, n_lists=2, subs=4, bits=4, dim=16, order=["line"], rebuild=True)
    assert anew["documents"].count() == 7 and anew["report"].agg(F.sum("violations")).first()[0] == 0


def test_build_embeds_whole_passages(spark):
    words = [f"w{i}" for i in range(191)]
    texts = spark.createDataFrame([("f.jsonl", " ".join(words), 0)], "file_name string, text string, line int")
    out = build.build(texts, shared_path(spark, "store"), n_lists=1, subs=None, dim=16, order=["line"])
    assert out["passages"].count() == 1
    slots = spark.createDataFrame([(w,) for w in words], "w string").groupBy(T.slot(F.col("w"), 16).alias("s")).count().collect()
    want = np.zeros(16)
    for r in slots:
        want[r.s] = r["count"]
    assert np.allclose(out["embeddings"].first().embedding, want / np.linalg.norm(want), atol=1e-6)


def test_embedding_stores(spark):
    rows = spark.createDataFrame([(i, i % 2, f"word{i} b") for i in range(6)], "passage_id long, file_id int, text string")
    store = shared_path(spark, "vectors")
    embed_missing(rows.where("file_id = 0"), store, dim=8)
    embed_missing(rows, store, dim=8)
    embed_again(rows, store, [1], dim=8)
    got = spark.read.parquet(store).collect()
    assert sorted(r.passage_id for r in got) == list(range(6))
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got)

    def ones(batches):
        for b in batches:
            yield b[["passage_id"]].assign(embedding=[[1.0, 0.0]] * len(b))

    assert embed(rows, encoder=ones).where("embedding[0] = 1").count() == 6


def test_many_neighbours_take_little_memory():
    """A block of queries at k = 4096 against several of vectors: the task holds what it keeps and a small merge, and the best are right."""
    rng, k, n = np.random.default_rng(3), 4096, 240
    q, x = rng.normal(size=(n, 8)).astype(np.float32), rng.normal(size=(4 * k, 8)).astype(np.float32)
    block = lambda ids, v: [pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([8], pa.int32()), pa.array([v.tobytes()], pa.binary())]
    pairs = [block(np.arange(n), q) + [pa.array([[k] * n], pa.list_(pa.int32()))] + block(np.arange(i, i + k), x[i : i + k]) for i in range(0, 4 * k, k)]
    tracemalloc.start()
    found = {}
    for b in scored((pa.RecordBatch.from_arrays(p, list("abcdefg")) for p in pairs), k, "ip", True):
        for row, i in zip(b.column(0).to_numpy(), b.column(1).to_numpy()):
            if row % 60 == 0:
                found.setdefault(int(row), []).append(int(i))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    score = np.round(q.astype(np.float64) @ x.astype(np.float64).T, 9)
    assert found == {r: np.lexsort((np.arange(4 * k), -score[r]))[:k].tolist() for r in range(0, n, 60)}


def test_passages_take_a_text_apart_once(spark):
    """Rows of passages get their own tokens, not all of the text's, and the text is split once."""
    rows = passages(spark.createDataFrame([(1, "a b " * 300), (2, None), (3, " ")], "doc_id int, text string"), 8, 4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and " _tokens#" not in plan
    assert [(r.doc_id, r.chunk_index, r.n_tokens, r.text) for r in rows.collect()] == [(1, i, 8, "a b a b a b a b") for i in range(75)]


def test_batches_of_texts_say_what_rows_say(spark):
    """Odd white space, nulls and long tokens: batches are cut and embedded as the column expressions say for each row."""
    odd = [None, "", " \t\n", "a", " a  b\x0bc\x0cd\r", "e\x1cf\x85g\xa0h 　i", "üä " * 9, "x" * 53 + " " + "y" * 54 + " z" * 7, *(" ".join("ab c\td"[i % 6 :] * (i % 5)) for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(odd)), "passage_id long, text string").repartition(3)
    for size, least in ((4, 2), (1, 1), (128, 64)):
        assert sorted(passages_by_batch(docs, size, least).collect()) == sorted(passages(docs, size, least).collect())
    words = docs.select("passage_id", F.posexplode(T.tokens(F.col("text"))).alias("at", "word")).where("at < 20").groupBy("passage_id", T.slot(F.col("word"), 8).alias("slot")).count().collect()
    counts = np.zeros((len(odd), 8))
    for r in words:
        counts[r.passage_id, r.slot] = r["count"]
    found = np.array([r.embedding for r in embed(docs, dim=8, max_length=20).orderBy("passage_id").collect()])
    assert np.allclose(found, counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300), atol=1e-6)


def test_lines_are_not_shuffled_to_meet_their_places(spark, tmp_path):
    """The sums of splits go to the lines, however large Spark takes them to be."""
    (tmp_path / "a.jsonl").write_text("".join(f'{{"text":"line {i}"}}\n' for i in range(50)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ids.line_positions(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r.position for r in found.orderBy("position").limit(3).collect()] == [0, 18, 36]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
