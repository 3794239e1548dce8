"""Stores that change, stages that survive a crash, and streams from files, against fresh builds."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_index import asked, pairs, unit, vectors

from lodestack.operators import ivf, living
from lodestack.operators.embed import embed, embed_again
from lodestack.operators.ids import line_columns, positioned
from lodestack.operators.passages import chunk_count, numbered
from lodestack.operators.topk import exact_topk
from lodestack.operators.verify import verify
from lodestack.plans import build
from lodestack.session import shared_path
from lodestack.sources import catalog
from lodestack.streaming import maintain as maintain_module
from lodestack.streaming.maintain import grow, grown, maintain_store, take_up

MODEL = ivf.Quantiser(unit(np.random.default_rng(0), 6))


@pytest.fixture(scope="module")
def rows(spark):
    return vectors(spark, unit(np.random.default_rng(1), 400)).cache()


def found(spark, path, q, version=None):
    return pairs(ivf.search(q, living.read(spark, path, version), MODEL, 10, 6))


def ids(postings):
    return sorted(r.passage_id for r in ivf.entry_ids(postings).collect())


def test_entries_taken_out_and_replaced(spark, rows):
    path, q = shared_path(spark, "index"), asked(rows)
    living.add(spark, path, rows.where("passage_id < 300"), MODEL)
    living.add_missing(spark, path, rows, MODEL)
    assert living.add_missing(spark, path, rows, MODEL)["version"] == 2 and found(spark, path, q) == pairs(exact_topk(q, rows, 10))
    living.remove(spark, path, rows.where("passage_id % 4 = 1").unionByName(rows.where("passage_id = 1")))
    left = rows.where("passage_id % 4 <> 1")
    assert found(spark, path, q) == pairs(exact_topk(q, left, 10)) and ids(living.read(spark, path)) == sorted(r.passage_id for r in left.collect())
    turned = rows.where("passage_id % 3 = 0").withColumn("embedding", F.reverse("embedding"))
    living.put(spark, path, turned, MODEL)  # some were taken out before and come back
    want = left.where("passage_id % 3 <> 0").unionByName(turned)
    assert found(spark, path, q) == pairs(exact_topk(q, want, 10))
    assert living.remove(spark, path, spark.range(5000, 5010).withColumnRenamed("id", "passage_id"))["version"] == 4  # nothing to do
    assert {r.violations for r in verify(want.select(F.col("passage_id").alias("doc_id")), want.withColumn("doc_id", F.col("passage_id")), want, living.read(spark, path)).where("rule like '%index%'").collect()} == {0}
    assert found(spark, path, q, 2) == pairs(exact_topk(q, rows, 10))  # an older version stays readable
    living.compact(spark, path, MODEL, 2)
    assert found(spark, path, q) == pairs(exact_topk(q, want, 10)) and not living.current(spark, path)["deletes"]
    living.vacuum(spark, path)
    assert found(spark, path, q) == pairs(exact_topk(q, want, 10))
    with pytest.raises(ValueError):
        living.read(spark, path, 2)


def test_an_embedding_file_made_again_reaches_the_index(spark):
    texts = spark.createDataFrame([(i, i % 3, f"word{i % 7} b{i} c{i % 5}") for i in range(60)], "passage_id long, file_id int, text string")
    store, path = shared_path(spark, "vectors"), shared_path(spark, "index")
    embed_again(texts, store, [0, 1, 2], dim=16, max_length=1)
    q = ivf.Quantiser(unit(np.random.default_rng(2), 4))
    living.add(spark, path, spark.read.parquet(store), q)
    embed_again(texts, store, [1], dim=16)
    living.put(spark, path, spark.read.parquet(store).where("file_id = 1"), q)
    look = embed(texts, dim=16).select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))
    fresh = ivf.search(look, ivf.encode(spark.read.parquet(store), q), q, 5, 4)
    assert pairs(ivf.search(look, living.read(spark, path), q, 5, 4)) == pairs(fresh)


def test_readers_see_whole_batches_and_few_files(spark, rows):
    """Twenty batches by a stream: live batches stay few, whatever is written meanwhile is not seen, and a repeated batch counts once."""
    path, base = shared_path(spark, "index"), shared_path(spark, "in")
    rows.repartition(20, "passage_id").write.parquet(base)
    for _ in range(2):
        maintain_store(spark, base, rows.schema, MODEL, path, shared_path(spark, "check"), files_per_batch=1, fan=3).awaitTermination()
    now = living.current(spark, path)
    assert now["streams"] == {"embeddings": 19} and len(now["batches"]) <= 2 * 3 + 2 and [b["level"] for b in now["batches"]] == [2, 2, 0, 0]
    assert ids(living.read(spark, path)) == list(range(400))
    ivf.write_postings(ivf.encode(rows, MODEL), f"{path}/postings", "half-written")
    living.add(spark, path, rows, MODEL, stream="embeddings", number=7)
    assert ids(living.read(spark, path)) == list(range(400)) and ids(living.read(spark, path, 1)) != list(range(400))
    living.vacuum(spark, path)
    assert len(catalog.names_below(spark, f"{path}/postings")) <= 8 + 1 and ids(living.read(spark, path)) == list(range(400))


def test_two_writers(spark, rows):
    """A commit that loses the race is tried on the version that won; entries of a batch that was merged away meanwhile are found anew."""
    path = shared_path(spark, "index")
    for i in range(2):
        living.add(spark, path, rows.where(f"passage_id % 2 = {i}"), MODEL)
    raced = []

    def change(now):
        if not raced:
            raced.append(1)
            living.add(spark, path, rows.where("passage_id = 0").withColumn("passage_id", F.lit(900).cast("long")), MODEL)
        return now | {"batches": now["batches"][::-1]}

    assert living.commit(spark, path, change)["version"] == 4 and len(living.current(spark, path)["batches"]) == 3
    old, merged = living._deleted, []

    def late(*args):
        out = old(*args)
        if not merged:
            merged.append(1)
            living.compact(spark, path, MODEL, 3)
        return out

    living._deleted = late
    try:
        living.remove(spark, path, rows.where("passage_id < 10"))
    finally:
        living._deleted = old
    assert ids(living.read(spark, path)) == [*range(10, 400), 900]


def test_empty_store_and_batches(spark, rows):
    path = shared_path(spark, "index")
    assert living.read(spark, path).count() == 0 and living.compact(spark, path, MODEL)["version"] == 0
    living.add(spark, path, rows.limit(0), MODEL)
    living.add(spark, path, rows.limit(0), MODEL, stream="s", number=0)
    assert living.current(spark, path)["streams"] == {"s": 0} and ids(living.read(spark, path)) == []
    living.put(spark, path, rows.where("passage_id < 5"), MODEL)
    assert ids(living.read(spark, path)) == [0, 1, 2, 3, 4]


def test_notes(spark, tmp_path):
    path = f"file://{tmp_path}/a/n.json"
    assert catalog.read_note(spark, path) is None
    assert catalog.write_note(spark, path, {"x": "é"}) and not catalog.write_note(spark, path, {"x": 2})
    assert catalog.read_note(spark, path) == {"x": "é"} and catalog.names_below(spark, f"file://{tmp_path}/a") == ["n.json"]


def test_stages_survive_a_crash(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.range(100).repartition(4)

    assert catalog.stage(spark, path, make, {"a": 1})[0].count() == 100
    catalog.stage(spark, path, make, {"a": 1})
    catalog.stage(spark, path, make, {"a": None})
    assert len(made) == 1  # whole, and with the same settings: reused
    lost = next((tmp_path / "t").glob("part-*"))
    lost.unlink()
    assert catalog.stage(spark, path, make, {"a": 1})[0].count() == 100 and len(made) == 2  # a file was lost
    for f in (tmp_path / "t").glob("part-*"):
        f.unlink()
    assert catalog.cached(spark, path, make, {"a": 1}).count() == 100 and len(made) == 3
    (tmp_path / "t" / "_stage.json").unlink()
    assert catalog.stage(spark, path, make)[0].count() == 100 and len(made) == 4  # writing was cut off before its end
    assert catalog.stage(spark, path, make, {"a": 2})[1]["given"] == {"a": 2} and len(made) == 5  # other settings
    other = tmp_path / "u"
    (other / "_temporary" / "0").mkdir(parents=True)
    assert catalog.stage(spark, str(other), make)[0].count() == 100 and len(made) == 6  # a job that died
    with pytest.raises(ZeroDivisionError):
        catalog.stage(spark, path, lambda: 1 / 0, rebuild=True)


def _texts(n):
    return [(f"f{i % 3}.jsonl", " ".join(f"w{(i * j) % 50}" for j in range(1 + i * 5)), i) for i in range(n)]


def test_build_sees_changes_and_losses(spark, tmp_path):
    texts = spark.createDataFrame(_texts(40), "file_name string, text string, line int")
    store = str(tmp_path / "store")
    how = {"n_lists": 4, "subs": 4, "bits": 4, "sample_size": 50, "dim": 16, "order": ["line"]}
    n = build.build(texts, store, fingerprint="a", **how)["passages"].count()
    notes = lambda: {n: json.loads((tmp_path / "store" / n / catalog.NOTE).read_text()) for n in ("files", "documents", "passages", "embeddings", "index", "postings")}
    before = notes()
    build.build(texts, store, fingerprint="a", **how)
    assert notes() == before
    next((tmp_path / "store" / "passages").glob("part-*")).unlink()
    out = build.build(texts, store, fingerprint="a", **how)
    after = notes()
    assert after["documents"] == before["documents"] and all(after[n] != before[n] for n in ("passages", "embeddings", "index", "postings"))
    assert out["passages"].count() == n and out["report"].agg(F.sum("violations")).first()[0] == 0
    smaller = build.build(texts, store, fingerprint="a", size=64, least_last=32, **how)
    assert smaller["passages"].count() > n and smaller["report"].agg(F.sum("violations")).first()[0] == 0
    other = build.build(texts.where("line < 9"), store, fingerprint="b", **how)
    assert other["documents"].count() == 9 and other["report"].agg(F.sum("violations")).first()[0] == 0
    with pytest.raises(ValueError, match="order"):
        build.build(texts, str(tmp_path / "new"), n_lists=2)


def _write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"text": t}) for t in lines) + "\n\n")
    time.sleep(1.1)  # files are taken up in the order of their times


def test_stream_from_files_equals_one_build(spark, tmp_path):
    texts = {f"{n}--raw_passages-0.jsonl": [" ".join(f"{n}{i}w{(i * j) % 90}" for j in range(1, 20 + 60 * i)) for i in range(4)] + [""] for n in ("alpha", "beta", "gamma")}
    for name, lines in texts.items():
        _write(tmp_path / "in", name, lines)
    store, check = shared_path(spark, "grown"), shared_path(spark, "check")
    model = ivf.Quantiser(unit(np.random.default_rng(3), 3, 64))
    for _ in range(2):  # the second run finds nothing new
        grow(spark, str(tmp_path / "in"), store, model, check, 1, fan=2).awaitTermination()
    lines = lambda name: spark.read.option("lineSep", "\n").text(str(tmp_path / "in" / name)).select(*line_columns())
    take_up(lines("beta--raw_passages-0.jsonl"), 1, store, model)  # done already
    with pytest.raises(ValueError, match="other files"):
        take_up(lines("alpha--raw_passages-0.jsonl"), 1, store, model)
    with pytest.raises(ValueError, match="not done"):
        take_up(lines("alpha--raw_passages-0.jsonl"), 9, store, model)
    catalog.delete(spark, f"{store}/batches/2.json")  # the last batch died before its end, and is repeated
    take_up(lines("gamma--raw_passages-0.jsonl"), 2, store, model, fan=2)
    out = grown(spark, store)
    fresh = build.build_files(spark, str(tmp_path / "in"), shared_path(spark, "fresh"), n_lists=3, subs=None)
    for name, columns in (("files", ["file_id", "file_name"]), ("documents", ["doc_id", "file_id", "doc_position", "text"]), ("passages", ["passage_id", "doc_id", "chunk_index", "text", "passage_file"]), ("embeddings", ["passage_id", "domain", "embedding"])):
        assert sorted(map(str, out[name].select(columns).collect())) == sorted(map(str, fresh[name].select(columns).collect()))
    n = out["passages"].count()
    assert ids(out["postings"]) == list(range(n))
    look = out["embeddings"].where("passage_id % 5 = 0").select(F.col("passage_id").alias("query_id"), F.col("embedding").alias("qvec"))
    assert pairs(ivf.search(look, out["postings"], model, 5, 3)) == pairs(ivf.search(look, ivf.encode(fresh["embeddings"], model), model, 5, 3))
    assert verify(out["documents"], out["passages"], out["embeddings"], out["postings"]).agg(F.sum("violations")).first()[0] == 0


def test_fingerprint(spark, tmp_path):
    _write(tmp_path / "in", "a.jsonl", ["x"])
    one = catalog.fingerprint(spark, str(tmp_path / "in"))
    assert catalog.fingerprint(spark, str(tmp_path / "in")) == one
    _write(tmp_path / "in", "b.jsonl", ["y"])
    two = catalog.fingerprint(spark, str(tmp_path / "in"))
    _write(tmp_path / "in", "b.jsonl", ["z"])
    assert len({one, two, catalog.fingerprint(spark, str(tmp_path / "in"))}) == 3


def test_a_batch_of_lines_is_not_shuffled_to_meet_its_places(spark, tmp_path, monkeypatch):
    """Tables of a batch come from the tasks that read its splits: the plan of its documents joins by broadcast alone, whatever Spark takes sizes to be."""
    (tmp_path / "a--raw_passages-0.jsonl").write_text("".join(f'{{"text":"word {i}"}}\n' for i in range(60)))
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path)).select(*line_columns())
    plans = []
    monkeypatch.setattr(maintain_module, "numbered", lambda docs, *how: plans.append(placed[-1]._jdf.queryExecution().executedPlan().toString()) or numbered(docs, *how))
    placed = []
    monkeypatch.setattr(maintain_module, "positioned", lambda *how, **amounts: placed.append(positioned(*how, **amounts)) or placed[-1])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        take_up(lines, 0, shared_path(spark, "store"), ivf.Quantiser(np.eye(64)[:2]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_a_line_is_parsed_once_and_its_passages_counted_by_batch(spark, tmp_path, monkeypatch):
    """Blank lines, null, missing and empty texts and other white space count as the column functions count them."""
    texts = ["one two", None, "", " \t ", "w " * 700, "a b c " * 80, "x\x0by\x0cz " * 90, "é " * 191]
    lines = [json.dumps({"text": t}) if i % 3 else json.dumps({"text": t}) + "\n  " for i, t in enumerate(texts)] + ['{"x": 1}', json.dumps({"text": "v " * 300})]
    (tmp_path / "a--raw_passages-0.jsonl").write_text("\n".join(lines))
    parsed = []
    monkeypatch.setattr(maintain_module, "text_of", lambda line: parsed.append(line) or catalog.text_of(line))
    store = shared_path(spark, "store")
    take_up(spark.read.option("lineSep", "\n").text(str(tmp_path)).select(*line_columns()), 0, store, ivf.Quantiser(np.eye(64)[:2]))
    assert len(parsed) == 1
    docs = grown(spark, store)["documents"].select("doc_id", "text", "passage_start", chunk_count(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r.text for r in docs] == [t or "" for t in texts] + ["", "v " * 300]
    assert [r.passage_start for r in docs] == np.cumsum([0] + [r.n for r in docs])[:-1].tolist() and sum(r.n for r in docs) > 10
