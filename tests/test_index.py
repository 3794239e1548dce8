"""Running best, pruned exact search, rotated codes, border lists and vectors that are not there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import queries
from lodestack.operators import ivf, lookup, metrics, topk
from lodestack.operators.topk import Best, exact_topk, task_best
from lodestack.session import shared_path


def vectors(spark, x):
    return spark.createDataFrame([(i, i % 5, r.tolist()) for i, r in enumerate(x.astype(np.float32))], "passage_id long, file_id int, embedding array<float>")


def unit(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, n, centres=20, dim=16, spread=0.03):
    x = unit(rng, centres, dim)[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def asked(v, every=20):
    return v.where(f"passage_id % {every} = 0").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))


def pairs(df):
    return sorted((r.query_id, r["rank"], r.passage_id) for r in df.collect())


@pytest.mark.parametrize("k,held,distinct", [(1, 10, False), (7, 50, False), (7, 10**6, True), (500, 40, True), (40, 200, False)])
def test_running_best(k, held, distinct):
    rng = np.random.default_rng(k)
    best, sent, all_ = Best(k, held, distinct), [], []
    for _ in range(30):
        of, ids = rng.choice(40, 9, replace=False), rng.choice(90, 33, replace=False)
        score = np.round(rng.normal(size=(9, 33)), 1)  # many ties
        all_ += [(int(q), float(s), int(i)) for q, row in zip(of, score) for s, i in zip(row, ids)]
        sent += [b for b in best.add(of, score, ids)]
    sent.append(best.out())
    rows = [tuple(r.values()) for b in sent for r in b.to_pylist()]

    def cut(rows):
        out = {}
        for q, s, i in rows:
            out.setdefault(q, []).append((-s, i))
        for q, r in out.items():
            if distinct:
                least = {}
                for s, i in r:
                    least[i] = min(s, least.get(i, 9))
                r = [(s, i) for i, s in least.items()]
            out[q] = sorted(r)[:k]
        return out

    assert cut([(q, s, i) for q, i, s in rows]) == cut(all_)
    assert best.out().num_rows == 0


@pytest.mark.parametrize("k", [1000, 1500, 4096])
def test_top_k_is_cut_in_tasks_at_any_k(spark, k, monkeypatch):
    """At most k rows for each query and task are shuffled, and memory of a task is bounded by what it may hold."""
    x = unit(np.random.default_rng(0), 6000)
    v = vectors(spark, x).repartition(3).coalesce(3)
    q = asked(v, 500)
    sent = task_best(q, v, k, block=512)
    by = sent.groupBy("query_id", F.spark_partition_id()).count().collect()
    assert len(by) >= 12 and max(r["count"] for r in by) <= k and len(by) <= 12 * 3
    assert "CartesianProduct" in sent._jdf.queryExecution().executedPlan().toString()
    score = np.round(x.astype(np.float32).astype(float)[::500] @ x.astype(np.float32).astype(float).T, 9)
    want = sorted((500 * i, r + 1, int(j)) for i in range(12) for r, j in enumerate(np.lexsort((np.arange(6000), -score[i]))[:k]))
    monkeypatch.setattr(topk, "HELD", 3000)  # much is sent before a task's end
    assert pairs(exact_topk(q, v, k, block=512)) == want


def test_a_scoring_task_has_no_python_for_its_queries(spark):
    """Blocks of queries are read as a table while a task scores, however many tasks do, and none is lost."""
    v = vectors(spark, unit(np.random.default_rng(31), 700)).repartition(3).coalesce(3)
    sent = task_best(asked(v, 7), v, 300, query_block=16)
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the blocks of vectors, and their scores
    assert sorted(r.query_id for r in sent.select("query_id").distinct().collect()) == list(range(0, 700, 7))


def test_each_query_has_its_own_number(spark):
    """A request for many does not make the others fetch as many, by exact and by index search."""
    v = vectors(spark, unit(np.random.default_rng(21), 1000)).repartition(2).coalesce(2)
    q = asked(v, 100).withColumn("fetch_k", F.when(F.col("query_id") == 300, 500).when(F.col("query_id") == 400, 0).when(F.col("query_id") > 600, None).otherwise(7).cast("int"))
    want = {i: {300: 500, 400: 0}.get(i, 900 if i > 600 else 7) for i in range(0, 1000, 100)}
    whole = {(r.query_id, r["rank"]): r.passage_id for r in exact_topk(asked(v, 100), v, 900).collect()}
    model = ivf.Quantiser(unit(np.random.default_rng(22), 4))
    for found in (exact_topk(q, v, 900, block=64), ivf.search(q, ivf.encode(v, model, block=64), model, 900, 4)):
        got = {(r.query_id, r["rank"]): r.passage_id for r in found.collect()}
        assert all(got[i, r] == whole[i, r] for i, n in want.items() for r in range(1, n + 1))
    sent = task_best(q, v, 900, block=64).groupBy("query_id", F.spark_partition_id()).count().collect()
    assert all(r["count"] <= want[r.query_id] for r in sent)


def test_index_search_is_cut_in_tasks(spark):
    v = vectors(spark, unit(np.random.default_rng(2), 3000))
    q = asked(v, 300)
    model = ivf.Quantiser(unit(np.random.default_rng(3), 8))
    posts = ivf.encode(v, model, block=100)
    assert pairs(ivf.search(q, posts, model, 2000, 8)) == pairs(exact_topk(q, v, 2000))


def test_pruned_exact_search(spark):
    """Equal to exact search, on clusters with most lists passed over, and without clusters too."""
    rng = np.random.default_rng(4)
    for x, least_passed in ((clustered(rng, 2000), 0.7), (unit(rng, 2000), 0.0), (np.repeat(unit(rng, 40), 50, axis=0) * rng.uniform(0.1, 9, (2000, 1)), 0.0)):
        v = vectors(spark, x)
        q = asked(v, 40)
        model = ivf.train(v, 20, None)
        path = shared_path(spark, "whole")
        ivf.write_postings(ivf.encode(v, model, block=64), path)
        posts, limits = ivf.read_postings(spark, path), ivf.bounds(v, model)
        assert pairs(ivf.exact_search(q, posts, model, limits, 10)) == pairs(exact_topk(q, v, 10))
        probed = ivf.bounded_probes(q, ivf.search(q, posts, model, 10, 1), model, limits, 10)
        passed = 1 - probed.count() / (q.count() * len(model.centroids))
        assert passed >= least_passed
    many = ivf.exact_search(q, posts, model, limits, 1990)  # more than the first lists hold
    assert pairs(many) == pairs(exact_topk(q, v, 1990))


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = clustered(rng, 500), unit(rng, 50)
    lists = (x @ x[:9].T).argmax(axis=1)
    centres = np.stack([x[lists == j].mean(axis=0) for j in range(9)])
    radius = np.array([np.linalg.norm(x[lists == j] - centres[j], axis=1).max() for j in range(9)])
    most = ivf.Bounds(centres, radius).most(q)
    assert all(((q @ x[lists == j].T).max(axis=1) <= most[:, j] + 1e-12).all() for j in range(9))
    assert (ivf.Bounds(centres, np.where(np.arange(9) == 3, -1.0, radius)).most(q)[:, 3] == -np.inf).all()


def test_rotation_lowers_the_error(spark):
    """Where few dimensions vary, a rotation shares them among the sub-spaces; the driver's fit equals the distributed one."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)) * np.r_[np.full(4, 1.0), np.full(12, 0.05)]
    v = vectors(spark, x)

    def error(q):
        y = x.astype(np.float32).astype(float)
        lists = q.assign(y)
        return ((q.turned(y - q.centroids[lists]) - q.decode(q.encode(y, lists))) ** 2).sum()

    plain, turned = ivf.train(v, 4, 4, 4), ivf.train(v, 4, 4, 4, turns=6)
    assert np.allclose(turned.rotation @ turned.rotation.T, np.eye(16)) and error(turned) < 0.8 * error(plain)
    y = x[:5]
    assert np.allclose(turned.score(y, 1, turned.encode(x[:40], np.ones(40, int))), y @ turned.centroids[1][:, None] + y @ (turned.decode(turned.encode(x[:40], np.ones(40, int))) @ turned.rotation.T).T)
    path = shared_path(spark, "turned")
    ivf.save(turned, spark, path)
    back = ivf.load(spark, path)
    assert np.allclose(back.rotation, turned.rotation) and back.border == 1


def test_distributed_training_equals_the_drivers(spark, monkeypatch):
    v = vectors(spark, unit(np.random.default_rng(7), 500))
    here = ivf.train(v, 6, 4, 4, turns=2)
    monkeypatch.setattr(ivf, "LOCAL_BYTES", 0)
    there = ivf.train(v, 6, 4, 4, turns=2)
    assert np.allclose(here.centroids, there.centroids) and np.allclose(here.rotation, there.rotation) and np.allclose(here.codebooks, there.codebooks)


def test_border_lists(spark):
    """A vector in several lists is found once, and appended once."""
    v = vectors(spark, unit(np.random.default_rng(8), 600))
    q = asked(v)
    model = ivf.Quantiser(unit(np.random.default_rng(9), 12), border=3)
    posts = ivf.encode(v, model)
    assert ivf.entry_ids(posts).count() == 1800
    assert pairs(ivf.search(q, posts, model, 10, 12)) == pairs(exact_topk(q, v, 10))
    one = ivf.Quantiser(model.centroids)
    exact = exact_topk(q, v, 10)
    recalls = [ivf.recall(ivf.search(q, ivf.encode(v, m), m, 10, 3), exact).first().recall for m in (one, model)]
    assert recalls[1] > recalls[0] + 0.2
    path = shared_path(spark, "border")
    ivf.write_postings(ivf.encode(v.where("passage_id < 99"), model), path)
    for _ in range(2):
        ivf.append(ivf.read_postings(spark, path), v, model, path)
    assert ivf.entry_ids(ivf.read_postings(spark, path)).count() == 1800


@pytest.mark.parametrize("n", [2000, 32_000, 200_000])
def test_recall_at_a_quarter_of_the_lists(spark, tmp_path, n):
    """Vectors without any clusters, the registered query's lists, probes and candidates."""
    rows = spark.createDataFrame([(i,) for i in range(8)], "part int").repartition(8, "part").mapInPandas(_random_vectors(n), "vec_id long, label int, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    lists = queries._lists(n)
    assert queries.CANDIDATES == 400 and lists // 4 * 4 <= lists
    v = queries._vectors(spark, str(tmp_path))
    few = v.where("passage_id % 100 = 0 and passage_id < 20000").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))
    model = ivf.train(ivf.sample(v, 100_000), lists, 16, turns=3, border=queries.BORDER)
    found = ivf.rescored(ivf.search(few, queries._stored(spark, ivf.encode(v, model)), model, queries.CANDIDATES, lists // 4), few, v, 10)
    assert ivf.recall(found, exact_topk(few, v, 10)).first().recall >= 0.9


def _random_vectors(n):
    def run(batches):
        import pandas as pd

        for b in batches:
            for part in b["part"]:
                ids = np.arange(part, n, 8)
                x = np.random.default_rng(part).normal(size=(len(ids), 64))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"vec_id": ids, "label": ids % 5, "embedding": list(x.astype(np.float32))})

    return run


def test_null_and_short_vectors(spark):
    x = unit(np.random.default_rng(10), 50)
    good = vectors(spark, x)
    null = spark.createDataFrame([(900 + i, 0, None) for i in range(3)], good.schema)
    v = good.unionByName(null).repartition(3)
    q = asked(good, 10)
    model = ivf.train(v, 4, 4, 4)
    assert ivf.assign(v, model).count() == 50 and ivf.entry_ids(ivf.encode(v, model)).count() == 50
    asked_null = q.unionByName(spark.createDataFrame([(901, None)], q.schema))
    assert {r.query_id for r in ivf.search(asked_null, ivf.encode(v, model), model, 3, 4).collect()} == {0, 10, 20, 30, 40}
    assert {r.query_id for r in exact_topk(asked_null, v, 3).collect()} == {0, 10, 20, 30, 40}
    path = shared_path(spark, "nulls")
    ivf.write_postings(ivf.encode(v.where("passage_id < 20 or passage_id > 900"), model), path)
    ivf.append(ivf.read_postings(spark, path), v, model, path)
    assert ivf.entry_ids(ivf.read_postings(spark, path)).count() == 50
    for bad, told in (([1.0] * 15, "of length 15"), ([1.0] * 17, "of length 17"), ([None] + [1.0] * 15, "null entry")):
        rows = good.unionByName(spark.createDataFrame([(77, 0, bad)], good.schema)).coalesce(1)
        for act in (lambda r: ivf.assign(r, model).count(), lambda r: ivf.encode(r, model).count(), lambda r: exact_topk(q, r, 3).count()):
            with pytest.raises(Exception, match=f"vector 77 (is|has a) ?{told}"):
                act(rows)


def test_lists_are_pruned_by_the_join(spark):
    """The folders to read come from the broadcast of the probes, without a trip to the driver."""
    v = vectors(spark, unit(np.random.default_rng(11), 300))
    model = ivf.Quantiser(unit(np.random.default_rng(12), 16))
    path = shared_path(spark, "pruned")
    ivf.write_postings(ivf.encode(v, model), path)
    found = ivf.search(asked(v, 150), ivf.read_postings(spark, path), model, 5, 1)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.passage_id for r in found.collect() if r["rank"] == 1} == {0, 150}
    read = [m for m in _scans(found) if m is not None]
    assert read and max(read) <= 2  # the partitions (lists) of the scan that were read


def _scans(df):
    """Partitions read by each file scan of the plan that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            metric = p.metrics().get("numPartitions")
            out.append(metric.get().value() if metric.isDefined() else None)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def _files_read(df):
    """Files that each scan of the plan that ran has read."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            out.append((p.relation().location().rootPaths().mkString(), p.metrics().get("numFiles").get().value()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_lookups_read_what_they_need(spark):
    """Ten ids: at most ten files of two hundred; ids that are not there, repeated, negative or null are told as ever."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(8)
    store = lookup.write_ranged(docs.unionByName(spark.createDataFrame([(None, "lost"), (-4, "lost")], "doc_id long, text string")), shared_path(spark, "ranged"), "doc_id", 100)
    wanted = [3, 4, 250, 999, 1000, 12_345, 12_346, 19_999, 7_777, 5_005]
    ids = spark.createDataFrame([(i, n) for n, i in enumerate(wanted)], "doc_id long, position int")
    found = lookup.passages_by_id(ids, store, "doc_id")
    assert sorted((r.doc_id, r.text, r.position) for r in found.collect()) == sorted((i, f"text {i}", n) for n, i in enumerate(wanted))
    assert [n for path, n in _files_read(found) if "ranged" in path] == [8]
    odd = spark.createDataFrame([(5,), (5,), (-4,), (10**12,), (20_000,), (None,)], "doc_id long")
    got = sorted((str(r.doc_id), r.status, r.doc_text) for r in lookup.documents_by_id(odd, store).collect())
    assert got == sorted([("5", "found", "text 5")] * 2 + [(str(i), "not_found", None) for i in (-4, 10**12, 20_000, None)])
    assert [r.doc_id for r in lookup.lost_ids(ids.unionByName(spark.createDataFrame([(20_001, 0)], ids.schema)), store, "doc_id").collect()] == [20_001]
    assert lookup.documents_of(ids.limit(0), store).count() == 0
    again = lookup.read_ranged(spark, store.rows.inputFiles()[0].split("/_span=")[0])
    assert (again.key, again.span, again.rows.count()) == ("doc_id", 100, 20_000)
    with pytest.raises(ValueError, match="not whole"):
        lookup.read_ranged(spark, shared_path(spark, "nothing"))


def test_quantiles(spark):
    """Every kind of number, ties, groups of one, null groups; against numpy."""
    rng = np.random.default_rng(13)
    groups = {"a": rng.normal(size=1001), "b": np.r_[rng.integers(0, 3, 500), -0.0, 0.0], "c": [7.5], None: -(10.0 ** rng.uniform(-300, 300, 77)), "inf": [-np.inf, 1.0, 2.0, 5e-324], "d": np.r_[1e308, -1e308, 0.0]}
    rows = [(g, float(x)) for g, of in groups.items() for x in of] + [("a", None), ("only null", None)]
    log = spark.createDataFrame(rows, "g string, latency double").repartition(5)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.value for r in metrics.quantiles(log, qs, "g").collect()}
    assert set(got) == {(g, q) for g in groups for q in qs}
    for g, of in groups.items():
        for q in qs:
            s, at = np.sort(np.asarray(of, float)), q * (len(of) - 1)
            a, b = float(s[int(at)]), float(s[int(np.ceil(at))])
            assert np.array_equal(got[g, q], a if a == b else a + (b - a) * (at - int(at)), equal_nan=True)
    assert metrics.quantiles(log.limit(0), qs, "g").count() == 0
    assert np.isnan(metrics.quantiles(spark.createDataFrame([(float("nan"),), (1.0,)], "latency double"), [1.0]).first().value)


def test_metrics_of_long_logs(spark):
    rng = np.random.default_rng(14)
    rows = [(None if i % 50 == 0 else int(i % 3), float(x), bool(i % 7)) for i, x in enumerate(rng.exponential(size=3000))]
    log = spark.createDataFrame(rows, "level int, latency double, success boolean").repartition(4)
    for by in ((), ("level",)):
        few, many = (sorted(map(str, metrics.latency_metrics(log, *by, held=held).select(*by, "total_requests", *(F.round(c, 9) for c in ("median", "p95", "p99", "mean"))).collect())) for held in (10**6, 100))
        assert few == many
    few, many = (sorted(map(str, metrics.histogram(log, "level", held=held).withColumn("median", F.round("median", 9)).collect())) for held in (10**6, 100))
    assert few == many


def test_quantiles_of_a_large_group(spark):
    """Two million distinct values in one group."""
    rows = spark.range(2_000_000, numPartitions=8).select((F.xxhash64("id") / float(1 << 40)).alias("latency"))
    (half, last) = (r.value for r in metrics.quantiles(rows, [0.5, 1.0]).orderBy("q").collect())
    assert last == rows.agg(F.max("latency")).first()[0]
    below = rows.where(F.col("latency") < half).count()
    assert below == 1_000_000


def test_a_hot_files_rows_are_cut_before_they_meet(spark, monkeypatch):
    """The cut by hash comes with the scan where files are few, and the sample is the same where their counts are joined by shuffle."""
    rows = spark.range(20_000).select(F.col("id").alias("passage_id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 20).alias("file_id"), F.array(F.lit(1.0)).alias("embedding"))
    few = ivf.sample(rows, 1000)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("hashpartitioning(file_id") < plan.index("BroadcastHashJoin")  # from the top down: cut, shuffle, join
    found = {tuple(r) for r in few.select("file_id", "passage_id").collect()}
    sizes = [n for _, n in few.groupBy("file_id").count().collect()]
    assert len(sizes) == 20 and max(sizes) == 50 and sum(sizes) == len(found)
    monkeypatch.setattr(ivf, "BROADCAST_FILES", 0)
    assert {tuple(r) for r in ivf.sample(rows, 1000).select("file_id", "passage_id").collect()} == found


def test_training_rounds_are_dealt_evenly(spark, monkeypatch):
    """A sample that comes from one file, and so from one task: the rounds of training read it in even parts."""
    x = np.random.default_rng(4).normal(size=(4000, 8))
    v = spark.createDataFrame([(i, 7, r.tolist()) for i, r in enumerate(x)], "passage_id long, file_id int, embedding array<float>")
    kept, made = [], ivf.written
    monkeypatch.setattr(ivf, "written", lambda df, name: kept.append(df) or made(df, name))
    ivf.train(ivf.sample(v, 4000), 4, None, rounds=1)
    sizes = [r["count"] for r in kept[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 1 and max(sizes) < 2 * 4000 / len(sizes)
