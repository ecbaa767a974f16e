"""Phases that go on after a failure, promotion, tails of logs, and rows paired by position."""

import functools
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from parley.operators import conversations, hierarchy, phases, providers, runs
from parley.sources import manifest, tables

FIELDS, NONE = "rating int, justification string", {"rating": 1, "justification": "none for {id}"}


class Dying(providers.RuleAnswerer):
    """Writes down what it is asked for, and dies while a file is there and enough has been asked; some ids fail while another is."""

    def __init__(self, folder, after):
        self.folder, self.after = folder, after

    def complete(self, task, items):
        asked = f"{self.folder}/asked"
        n = sum(1 for _ in open(asked)) if os.path.exists(asked) else 0
        if n >= self.after and os.path.exists(f"{self.folder}/dies"):
            raise RuntimeError("the provider died")
        with open(asked, "a") as file:
            file.write("".join(f"{k}\n" for k, _ in items))
        if os.path.exists(f"{self.folder}/fails") and any(k % 10 == 3 for k, _ in items):
            raise providers.ProviderError("no answer")
        return super().complete(task, items)


def test_a_second_run_asks_only_for_what_is_left(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    provider, root = Dying(str(tmp_path), 25), f"{tmp_path}/run"
    (tmp_path / "dies").touch()
    go = lambda: phases.run_phase(df, "id", "t", "audit", FIELDS, NONE, root=root, name="audits", provider=provider, batch=50, most=1, wave_rows=5)
    # One thread and one batch for each task, so that a wave is asked for whole or not at all.
    with pytest.raises(Exception, match="died"):
        go()
    waves = manifest.read(spark, root)[1]["waves"]["audits"]
    assert 4 <= len(waves) < 10 and manifest.read(spark, root)[1]["checkpoints"]["audits"]["completed"] is False
    paid = {r.id for r in phases.committed(spark, root, "audits", f"id long, {FIELDS}, ok boolean, fallback_used boolean, error string, round int, width int, wave int").collect()}
    (tmp_path / "dies").unlink()
    found = go().collect()
    asked = [int(x) for x in open(tmp_path / "asked")]
    assert sorted(r.id for r in found) == list(range(50)) and all(r.rating == 5 and not r.fallback_used and r.error is None for r in found)
    assert all(asked.count(i) == 1 for i in paid)  # what was committed is not asked for again
    state = manifest.read(spark, root)[1]
    assert state["checkpoints"]["audits"] == {"phase": "audits", "total": 50, "processed": 50, "completed": True}
    before = len(asked)
    assert go().count() == 50 and sum(1 for _ in open(tmp_path / "asked")) == before
    assert go().join(df.where("id < 3"), "id").count() == 3


def test_the_fifth_wave_dies_and_each_id_is_asked_once(spark, tmp_path):
    df = spark.range(40).select("id", F.lit("x").alias("t")).coalesce(1)
    provider, root = Dying(str(tmp_path), 20), f"{tmp_path}/run"
    (tmp_path / "dies").touch()
    waves = spark.range(40).select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("w")).groupBy("w").count().orderBy("w").collect()
    provider.after = sum(r["count"] for r in waves[:4])  # it dies when the fifth wave asks
    go = lambda: phases.run_phase(df, "id", "t", "audit", FIELDS, NONE, root=root, name="audits", provider=provider, batch=50, most=1, wave_rows=5)
    with pytest.raises(Exception, match="died"):
        go()
    assert [w["wave"] for w in manifest.read(spark, root)[1]["waves"]["audits"]] == [1, 2, 3, 4]
    (tmp_path / "dies").unlink()
    assert go().count() == 40
    assert sorted(int(x) for x in open(tmp_path / "asked")) == list(range(40))


def test_errors_drop_out_after_success(spark, tmp_path):
    df = spark.range(20).select("id", F.lit("x").alias("t"))
    provider, root = Dying(str(tmp_path), 10**9), f"{tmp_path}/run"
    (tmp_path / "fails").touch()
    go = lambda: {r.id: r for r in phases.run_phase(df, "id", "t", "audit", FIELDS, NONE, root=root, name="a", provider=provider, batch=4, most=2).collect()}
    got = go()
    assert {i for i, r in got.items() if r.error} >= {3, 13} and (got[3].rating, got[3].justification, got[3].fallback_used) == (1, "none for 3", True)
    assert all(r.rating == 5 for i, r in got.items() if i % 10 != 3)
    (tmp_path / "fails").unlink()
    again = go()
    assert again[3].rating == again[13].rating == 5 and again[3].error is None
    assert manifest.read(spark, root)[1]["waves"]["a"][-1]["rows"] == 2


def test_labels_and_audits_resume(spark, tmp_path):
    facets = spark.createDataFrame([(k % 4, i, f"word{k} {i}") for i, k in enumerate([0, 1, 2, 3] * 5)], "cluster_id int, n int, summary string")
    texts = spark.createDataFrame([("raw", str(i), "a@b.org" if i % 3 else "fine") for i in range(12)], "stage string, id string, content string")
    root = str(tmp_path)
    for name, go in (("labels", lambda **x: providers.cluster_labels(facets, "n", **x)), ("audits", lambda **x: providers.audited(texts, **x))):
        ask = functools.partial(phases.run_phase, root=root, name=name, wave_rows=3)
        wanted = sorted(map(str, go().collect()))
        assert sorted(map(str, go(ask=ask).collect())) == wanted
        waves = len(manifest.read(spark, root)[1]["waves"][name])
        assert waves > 1 and sorted(map(str, go(ask=ask).collect())) == wanted and len(manifest.read(spark, root)[1]["waves"][name]) == waves


class Counting:
    """Knows how many requests are open at once, and fails batches of chosen numbers."""

    def __init__(self, failing):
        self.lock, self.open, self.seen, self.failing = threading.Lock(), 0, [], failing

    def complete(self, task, items):
        with self.lock:
            self.open += 1
        time.sleep(0.05)
        with self.lock:
            self.seen.append(self.open)
            self.open -= 1
        if items[0][0] in self.failing:
            return []
        return [{"id": k, "rating": 5, "justification": t} for k, t in items]


@pytest.mark.parametrize("failing", [set(), {0}, {0, 4, 8, 12, 13}, set(range(60))])
def test_widths_follow_the_issues(failing):
    provider = Counting(failing)
    batches = [[(k, f"t{k}")] for k in range(60)]
    rounds = list(phases.adaptive(iter(batches), "audit", provider, 6))
    rows = [r for _, _, rows in rounds for r in rows]
    assert [r["id"] for r in rows] == list(range(60)) and all((r["answer"] is None) == (r["id"] in failing) for r in rows)
    issues = [sum(r["id"] in failing for r in rows) for _, _, rows in rounds]
    assert [w for _, w, _ in rounds] == providers.waves(issues, 6, 6)
    assert max(provider.seen) == 6 and all(len(rows) == w for _, w, rows in rounds[:-1])


def test_promotion_refuses_and_commits_at_once(spark, tmp_path):
    root, schema = f"{tmp_path}/run", "id long, v string"
    partial, errors = f"{tmp_path}/partial", f"{tmp_path}/errors"
    with pytest.raises(FileNotFoundError):
        tables.promote(spark, root, partial, schema)
    manifest.commit(spark, root, lambda m: m | {"run_id": "r", "completed_phases": ["phase1_dataset_load"]})
    with pytest.raises(FileNotFoundError):
        tables.promote(spark, root, partial, schema)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    tables.append(rows.limit(0), partial)
    with pytest.raises(ValueError):
        tables.promote(spark, root, partial, schema)
    assert manifest.read(spark, root)[0] == 1 and manifest.table(spark, root, "facets", schema) is None
    tables.append(rows, partial)
    tables.append(spark.createDataFrame([("3", "bad")], "id string, error string"), errors)
    new = tables.promote(spark, root, partial, schema, errors=errors)
    assert manifest.table(spark, root, "facets", schema).count() == 2 and manifest.table(spark, root, "facets_errors", "id string, error string").count() == 1
    assert new["completed_phases"] == ["phase1_dataset_load", "phase2_facet_extraction"] and new["run_id"] == "r" and new["promoted_from_partial"] is True
    done = new["checkpoints"]["phase2_facet_extraction"]
    assert (done["completed"], done["note"], done["facets_count_success"], done["error_count_recorded"]) == (True, "promoted_from_partial", 2, 1)
    with pytest.raises(FileExistsError):
        tables.promote(spark, root, partial, schema)
    assert manifest.read(spark, root)[0] == 2


def test_readers_see_the_old_version_or_the_new(spark, tmp_path):
    root = str(tmp_path)
    manifest.commit(spark, root, lambda m: {"tables": {"t": manifest.write_table(spark.range(3).select("id"), root, "t")}})
    folder = manifest.write_table(spark.range(5).select("id"), root, "t")  # written, and not named yet
    assert manifest.table(spark, root, "t", "id long").count() == 3
    reader = manifest.table(spark, root, "t", "id long")
    manifest.commit(spark, root, lambda m: m | {"tables": {"t": folder}}, 1)
    assert reader.count() == 3 and manifest.table(spark, root, "t", "id long").count() == 5
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, root, lambda m: m, 1)

    def meanwhile(m):  # another writer is first
        manifest.commit(spark, root, lambda x: x | {"other": 1})
        return m

    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, root, meanwhile)
    assert manifest.read(spark, root) == (3, manifest.read(spark, root)[1]) and manifest.read(spark, root)[1]["other"] == 1
    assert [f for f in os.listdir(f"{root}/manifest") if f.startswith(".") and not f.endswith(".crc")] == []


def test_objects_and_loaders(spark, tmp_path):
    root = str(tmp_path)
    assert tables.read_object(spark, root, "report") == {}
    tables.write_object(spark.createDataFrame([(1, None)], "a int, b string"), root, "report")
    tables.write_object(spark.createDataFrame([(2, None)], "a int, b string"), root, "report")
    assert tables.read_object(spark, root, "report") == {"a": 2, "b": None}
    with pytest.raises(ValueError):
        tables.write_object(spark.range(2), root, "report")
    assert tables.resumable(spark, root, "base_clusters").count() == 0
    (tmp_path / "base_clusters.json").write_text(json.dumps({"clusters": [{"cluster_id": 4, "size": 9, "unique_users": 3, "kept_by_threshold": True, "centroid": [0.5, 1]}, {"cluster_id": 5}]}))
    (tmp_path / "facets.jsonl").write_text('{"conversation_id": "c", "summary": "s", "turn_count": 2, "message_count": 2}\n\n{"conversation_id": "torn\n')
    (tmp_path / "labeled_clusters.json").write_text('{"clusters": [{"cluster')
    (tmp_path / "hierarchy.json").write_text('{"other": 1}')
    got = tables.resumable(spark, root, "base_clusters").orderBy("cluster_id").collect()
    assert (got[0].cluster_id, got[0].size, got[0].centroid) == (4, 9, [0.5, 1.0]) and got[1].size is None
    facets = tables.resumable(spark, root, "facets").collect()
    assert [(r.conversation_id, r.message_count, r.language) for r in facets] == [("c", 2, None)]
    assert [tables.resumable(spark, root, k).count() for k in ("labeled_clusters", "hierarchy", "evaluation")] == [0, 0, 0]
    assert [tables.read_object_file(spark, f"{root}/{k}.json") for k in ("none", "labeled_clusters", "hierarchy")] == [{}, {}, {"other": 1}]
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "blank.json").write_text("")
    assert [tables.read_object_file(spark, f"{root}/{k}.json") for k in ("list", "blank")] == [{}, {}]
    (tmp_path / "privacy_audit.json").write_text('{"audits": [{"stage": "raw", "id": "1", "rating": 5}]}')
    assert [t.count() for t in tables.resumable_privacy(spark, root)] == [0, 0]
    (tmp_path / "gated_clusters.json").write_text('{"clusters": []}')
    assert [t.count() for t in tables.resumable_privacy(spark, root)] == [1, 0]


def test_a_tail_reads_no_more_of_a_longer_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TAIL_BLOCK", 512)
    sizes = []
    for n in (1_000, 50_000):
        path = tmp_path / f"log{n}"
        path.write_text("".join(f"line {i:06d} é\n" for i in range(n)))
        found, read = tables.tail_file(spark, str(path), 40)
        assert [(r.position, r.line) for r in found.collect()] == [(k + 1, f"line {i:06d} é") for k, i in enumerate(range(n - 40, n))]
        sizes.append(read)
    assert sizes[0] == sizes[1] <= 2048
    folder = tmp_path / "parts"
    folder.mkdir()
    for k, lines in enumerate((["a"] * 30, ["b", "", "c" * 3000], [], ["d"])):
        (folder / f"part-{k}").write_text("".join(f"{x}\n" for x in lines))
    (folder / "_SUCCESS").write_text("")
    assert [r.line for r in tables.tail_file(spark, str(folder), 20)[0].collect()] == ["a"] * 16 + ["b", "", "c" * 3000, "d"]
    (tmp_path / "short").write_text("one\ntwo")
    assert [r.line for r in tables.tail_file(spark, str(tmp_path / "short"), 20)[0].collect()] == ["one", "two"]
    (tmp_path / "empty").write_text("")
    assert tables.tail_file(spark, str(tmp_path / "empty"), 20)[0].count() == 0


def test_rows_paired_by_position(spark):
    left = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "a long, t string").repartition(7)
    order = [r.a for r in left.collect()]
    right = spark.createDataFrame([(i * 2.0,) for i in range(100)], "v double").coalesce(3)
    got = conversations.zipped(left, right).orderBy("position").collect()
    assert [r.position for r in got] == list(range(100)) and [r.a for r in got] == order and [r.v for r in got] == [i * 2.0 for i in range(100)]
    plan = conversations.zipped(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        conversations.zipped(left, right.limit(99))
    assert conversations.zipped(left.limit(0), right.limit(0)).count() == 0


def test_ordinals_over_all_rows(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(50)], "i long, k string").repartition(6)
    got = [(r.k, r.i) for r in conversations.ordinals(df, "k", F.desc("i")).orderBy("parley_n").collect()]
    assert got == sorted(got, key=lambda x: (x[0], -x[1])) and len(got) == 50


def test_rows_without_an_order_are_last(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (1, "a"), (None, "b"), (5, None)], "o long, id string")
    assert sorted((r.o is None, r.o or 0, r.batch) for r in conversations.batches(df, "o", 2).collect()) == [(False, 1, 0), (False, 2, 0), (False, 5, 1), (True, 0, 1), (True, 0, 2)]
    from parley.sources import jsonl

    got = jsonl.unique_ids(df.select("o", "id"), "id", "o").collect()
    assert sorted(str(r.unique_id) for r in got) == ["None", "a", "a_dup1", "a_dup2", "b"]
    assert {r.o: r.unique_id for r in got if r.id == "a"} == {1: "a", 2: "a_dup1", None: "a_dup2"}


def test_null_labels_and_orders_keep_their_rows(spark):
    from parley.operators import clustering

    points = spark.createDataFrame([(1, 7), (2, None), (3, 3), (4, None), (5, 7)], "vec_id long, label int")
    assert {r.vec_id: r.label for r in clustering.dense_labels(points).collect()} == {1: 1, 2: 2, 3: 0, 4: 2, 5: 1}
    placed = spark.createDataFrame([(0, "a", 2), (0, "b", None), (0, "c", 1), (None, "d", 5)], "cluster_id int, conversation_id string, ord long")
    assert {r.conversation_id: r.position for r in clustering.members(placed, "ord").collect()} == {"a": 2, "b": 3, "c": 1, "d": 1}


def test_trees_of_any_depth(spark):
    n = 70
    edges = spark.createDataFrame([(f"n{i + 1:02d}", f"n{i:02d}") for i in range(n)], "parent_id string, child_id string")
    nodes = spark.createDataFrame([(f"n{i:02d}", i + 1, n - i) for i in range(n + 1)], "node_id string, size long, level int")
    assert hierarchy.roots(edges, nodes.where("node_id in ('n00', 'n69', 'n70')")).orderBy("node_id").collect() == [("n00", "n70", 70), ("n69", "n70", 1), ("n70", "n70", 0)]
    flat = hierarchy.flattened(nodes, edges, F.col("node_id") == "n70").orderBy("path").collect()
    assert [r.node_id for r in flat] == [f"n{i:02d}" for i in range(n, -1, -1)] and [r.depth for r in flat] == list(range(n + 1))
    cycle = edges.union(spark.createDataFrame([("n00", "n70")], edges.schema))
    with pytest.raises(ValueError):
        hierarchy.roots(cycle, nodes)


def test_timeline_by_rank_of_its_sources(spark):
    a, b, c = runs.PHASES[:3]
    table = spark.createDataFrame([(1, b, True), (2, a, True), (3, c, False)], "run_id long, phase string, locked boolean")
    done = spark.createDataFrame([(1, a), (2, a), (3, a), (3, b)], "run_id long, phase string")
    said = spark.createDataFrame([(1, a, "skipped", 1), (1, b, "failed", 2), (2, b, "odd", 1), (3, b, "failed", 1), (3, b, "resumed", 2), (3, c, "running", 1)], "run_id long, phase string, status string, ord long")
    got = {(r.run_id, r.phase): (r.status, r.source) for r in runs.resolved_timeline(table, done, said).collect()}
    assert len(got) == 21
    assert [got[1, p] for p in (a, b, c)] == [("skipped", "metric"), ("running", "lock"), ("pending", "none")]
    assert [got[2, p] for p in (a, b, c)] == [("completed", "manifest"), ("pending", "none"), ("pending", "none")]
    assert [got[3, p] for p in (a, b, c)] == [("completed", "manifest"), ("resumed", "metric"), ("running", "metric")]
