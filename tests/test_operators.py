import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import plans
from parley.functions import text
from parley.operators import clustering, conversations, evaluate, hierarchy, privacy, providers, vectors
from parley.sources import jsonl, tables

GOOD = {"conversation_id": "a", "user_id": "u", "timestamp": "2025-01-01T00:00:00Z", "messages": [{"role": "user", "content": "hi"}]}


SF = "/root/testdata/sf0.001"


def lines(spark, rows):
    return spark.createDataFrame([(i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "line_number long, line string")


def test_mixed_defects(spark):
    rows = [GOOD, "{not valid json}", "[]", {k: v for k, v in GOOD.items() if k != "user_id"}, GOOD]
    report = jsonl.validation_report(lines(spark, rows)).first()
    assert (report.total_lines, report.non_empty_lines, report.valid_lines, report.invalid_lines, report.duplicates, report.errors) == (5, 5, 1, 4, 1, 4)
    assert [r.code for r in jsonl.errors(lines(spark, rows)).collect()] == ["invalid_json", "non_object_line", "schema_validation_failed", "duplicate_conversation_id"]


def test_errors_are_cut_and_counted(spark):
    report = jsonl.validation_report(lines(spark, ["{bad}"] * 3), max_errors=1).first()
    assert (report.retained, report.dropped) == (1, 2)


def test_empty_dataset_and_extra_keys(spark):
    assert jsonl.validation_report(lines(spark, ["", "  "])).first().errors == 1
    wrong = [GOOD | {"extra": 1}, GOOD | {"messages": [{"role": "user", "content": "x", "more": 1}]}, GOOD | {"conversation_id": 1}]
    assert {r.code for r in jsonl.errors(lines(spark, wrong)).collect()} == {"schema_validation_failed"}
    assert jsonl.checked(lines(spark, [GOOD | {"metadata": {"a": [1]}, "schema_version": None}])).first().code is None


def test_types_of_the_contract(spark):
    said = lambda c: GOOD | {"messages": [{"role": "user", "content": c}]}
    wrong = [said(5), said({"k": 1}), said(None), GOOD | {"metadata": None}, GOOD | {"metadata": []}, GOOD | {"messages": "x"}, GOOD | {"timestamp": "soon"}]
    assert [r.code for r in jsonl.checked(lines(spark, wrong)).orderBy("line_number").collect()] == ["schema_validation_failed"] * len(wrong)
    twice = json.dumps(GOOD)[:-1] + ', "user_id": "v"}'
    right = [twice, json.dumps(GOOD | {"conversation_id": "b", "messages": []}), json.dumps(GOOD | {"conversation_id": "c", "timestamp": 1700000000})]
    assert [r.code for r in jsonl.checked(lines(spark, right)).collect()] == [None] * 3
    assert {r.user_id for r in jsonl.strict(lines(spark, right)).collect()} == {"u", "v"}


def test_strict_scan_stops_and_limits_stop_looking(spark):
    rows = [GOOD | {"conversation_id": f"c{i}"} for i in range(7)]
    got = jsonl.chunks(lines(spark, [*rows[:5], "{bad"]), 3, 5)
    assert [r["count"] for r in got.groupBy("batch").count().orderBy("batch").collect()] == [3, 2]
    with pytest.raises(ValueError, match="line 6: invalid_json"):
        jsonl.strict(lines(spark, [*rows[:5], "{bad"]))
    with pytest.raises(ValueError, match="line 2: duplicate_conversation_id"):
        jsonl.strict(lines(spark, [rows[0], rows[0]]))
    with pytest.raises(ValueError, match="empty_dataset"):
        jsonl.strict(lines(spark, [" "]))


def test_lenient_reads(spark):
    rows = ['{"a": 1}', "[]", '{"a": 2}', "{bad", '{"a": 3}']
    assert jsonl.capped(lines(spark, rows)).count() == 0
    assert [r.line_number for r in jsonl.capped(lines(spark, rows), 2).collect()] == [1, 3]
    assert [r.line_number for r in jsonl.records(lines(spark, rows[:3])).collect()] == [1, 3]
    with pytest.raises(Exception, match="bad JSON in line 4"):
        jsonl.records(lines(spark, rows)).collect()
    df = lines(spark, rows).select(jsonl.object_or_empty(F.col("line")).alias("x"))
    assert [r.x for r in df.collect()] == ['{"a": 1}', "{}", '{"a": 2}', "{}", '{"a": 3}']


def test_discovery_takes_the_first_candidate_of_the_majority(spark):
    rows = [{"chatId": "c", "id": str(i), "userHash": "h", "createdAt": 1, "turns": [{"speaker": "Human", "text": "hi"}], "messages": "no"} for i in range(3)]
    rows = [r if i else {k: v for k, v in r.items() if k != "chatId"} for i, r in enumerate(rows)] + [{"id": "z", "userHash": "h", "createdAt": 1, "turns": []}]
    found = jsonl.discover(lines(spark, rows))
    assert found == {"conversation_id": "id", "user_id": "userHash", "timestamp": "createdAt", "messages": "turns", "role": "speaker", "content": "text"}
    assert jsonl.discover(lines(spark, ["nope"]))["messages"] is None
    good, rejects = jsonl.normalized(lines(spark, rows), found)
    assert (good.count(), rejects.count()) == (3, 1)
    report = jsonl.normalization_report(lines(spark, [*rows, "nope", ""]), found).first()
    assert (report.total_lines, report.parsed_lines, report.output_lines, report.rejected_lines, report.roles, report.errors) == (6, 4, 3, 2, "user:3", "4:no_valid_messages,5:invalid_json")


def test_lines_of_many_files_are_numbered_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(40)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        got = [(r.line_number, r.line) for r in jsonl.read_lines(spark, str(tmp_path)).orderBy("line_number").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, f"{i // 40} {i % 40}") for i in range(120)]


def test_unique_ids_pass_over_taken_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x_dup1"), (4, "x")], "n int, id string")
    assert [r.unique_id for r in jsonl.unique_ids(df, "id", "n").orderBy("n").collect()] == ["x", "x_dup2", "x_dup1", "x_dup3"]
    taken = spark.createDataFrame([(i, "x") for i in range(6)] + [(10 + k, f"x_dup{k}") for k in (1, 2, 5)], "n int, id string")
    assert [r.unique_id for r in jsonl.unique_ids(taken, "id", "n").orderBy("n").limit(6).collect()] == ["x", "x_dup3", "x_dup4", "x_dup6", "x_dup7", "x_dup8"]


def test_normalized(spark):
    rows = [{"id": "1", "userHash": "h", "createdAt": "soon", "messages": [{"from": "Human", "text": " hi "}, {"role": "ai", "content": ""}]}, {"messages": []}, "nope"]
    found, rejects = jsonl.normalized(lines(spark, rows), {"conversation_id": "id", "user_id": "userHash", "timestamp": "createdAt", "messages": "messages"})
    row = found.first()
    assert (row.conversation_id, row.timestamp_synthetic, [tuple(m) for m in row.messages]) == ("1", True, [("user", "hi")])
    assert {(r.line_number, r.reason) for r in rejects.collect()} == {(2, "no_valid_messages"), (3, "invalid_json")}


def test_scalars(spark):
    df = spark.createDataFrame([("  a\x1c", 3725.0, "x" * 121)], "a string, s double, long string")
    row = df.select(text.strip(F.col("a")).alias("a"), text.duration(F.col("s")).alias("d"), text.preview(F.col("long")).alias("p"), text.slug(F.lit(" a b/c ")).alias("g"), text.percent(F.lit(1), F.lit(0)).alias("z")).first()
    assert (row.a, row.d, len(row.p), row.p[-3:], row.g, row.z) == ("a", "1:02:05", 120, "...", "a_bc", 0.0)


def test_reconcile(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = spark.createDataFrame([(1,), (2,), (2,), (9,)], "k int")
    assert {r.k: r.status for r in conversations.reconcile(expected, got, "k").collect()} == {1: "ok", 2: "duplicate", 3: "missing", 9: "unexpected"}


def test_batches_have_their_size(spark):
    df = spark.range(103).select((F.col("id") * F.col("id")).alias("k")).repartition(7)
    counts = [r["count"] for r in conversations.batches(df, "k", 10).groupBy("batch").count().orderBy("batch").collect()]
    assert counts == [10] * 10 + [3]


def test_leaf_count():
    assert clustering.leaf_count(100) == (20, 20)
    assert clustering.leaf_count(3) == (3, 20)
    assert clustering.leaf_count(5, mode="fixed", requested=9) == (5, None)
    with pytest.raises(ValueError):
        clustering.leaf_count(5, mode="other")


def test_thresholds_mark_and_keep(spark):
    rows = spark.createDataFrame([(0, "u1"), (1, "u2"), (1, "u2")], "cluster_id int, user_id string")
    assert [tuple(r) for r in clustering.rollup(rows, min_users=2, min_conversations=2).orderBy("cluster_id").collect()] == [(0, 1, 1, False), (1, 2, 1, False)]


def test_fit_reports_what_it_did(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(5 * (i % 2), 0.1, 2) + (100 * i if i > 58 else 0)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found, report = clustering.fit(df, "density", 4, noise="drop")
    assert report["noise_policy"] == "drop_bucket" and report["noise"] >= 1 and found.where("label < 0").count() == 0
    assert clustering.fit(df, "kmeans", 3)[1]["effective_k"] == 3
    with pytest.raises(ValueError):
        clustering.fit(df.withColumn("v", F.array(F.lit(float("nan")))), "kmeans", 2)
    with pytest.raises(ValueError):
        clustering.fit(df, "other", 2)


def test_noise_policies(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 1, [9.0]), (2, -1, [8.0]), (3, -1, [1.0])], "vec_id long, label int, v array<double>")
    got = lambda p: [r.label for r in clustering.with_noise(df, p).orderBy("vec_id").collect()]
    assert (got("nearest"), got("singleton"), got("drop")) == ([0, 1, 1, 0], [0, 1, 2, 3], [0, 1, 2, 2])
    none = df.withColumn("label", F.lit(-1))
    assert sorted(r.label for r in clustering.with_noise(none, "nearest").collect()) == [0, 1, 2, 3]


def test_hierarchy_sizes_add_up(spark):
    rows = [(f"leaf-{i:03d}", f"n{i}", i + 1, [float(i), float(i % 3)]) for i in range(9)]
    nodes, edges, why = hierarchy.levels(spark.createDataFrame(rows, "node_id string, name string, size long, v array<double>"), target_group_size=3)
    by_level = {r.level: r.s for r in nodes.groupBy("level").agg(F.sum("size").alias("s")).collect()}
    assert set(by_level.values()) == {45} and why
    assert edges.select("child_id").distinct().count() == edges.count()


def test_trees_by_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "parent_id string, child_id string")
    leaves = spark.createDataFrame([("d",), ("e",), ("z",)], "node_id string")
    assert {tuple(r) for r in hierarchy.roots(edges, leaves).collect()} == {("d", "a", 3), ("e", "a", 1), ("z", "z", 0)}
    nodes = spark.createDataFrame([(k, k, n, 0) for k, n in zip("abcde", (9, 3, 3, 3, 6), strict=True)], "node_id string, name string, size long, level int")
    flat = hierarchy.flattened(nodes, edges, F.col("node_id") == "a").orderBy("path").collect()
    assert [(r.node_id, r.depth) for r in flat] == [("a", 0), ("e", 1), ("b", 1), ("c", 2), ("d", 3)]


def test_levels_stop_for_a_reason(spark):
    rows = [(f"leaf-{i}", f"n{i}", 1, [float(i % 2), 0.0]) for i in range(4)]
    leaves = spark.createDataFrame(rows, "node_id string, name string, size long, v array<double>")
    assert hierarchy.levels(leaves.limit(1))[2] == hierarchy.SINGLE_ROOT
    assert hierarchy.levels(leaves, target_group_size=2, most=2)[2] == hierarchy.REACHED
    named = hierarchy.levels(leaves, target_group_size=2, most=2, label=lambda t: t.select("node_id", F.concat(F.lit("of "), F.replace("text", F.lit("\n"), F.lit("+"))).alias("name")))[0]
    assert {r.name for r in named.where("level = 1").collect()} == {"of n0+n2", "of n1+n3"}
    with pytest.raises(Exception, match="unknown node_id"):
        hierarchy.two_level(leaves.drop("v"), leaves.limit(2).select("node_id", F.lit(0).alias("label")))[1].collect()


def test_numbers_of_a_hot_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(100)], "n int, k string").repartition(5)
    got = {r.n: r.parley_n for r in conversations.numbered_within(df, ["k"], "n").collect()}
    hot = [i for i in range(100) if i % 3]
    assert all(got[i] == hot.index(i) + 1 for i in hot) and [got[i] for i in range(0, 100, 3)] == list(range(1, 35))


def test_joins_that_must_match(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, x string")
    with pytest.raises(Exception, match="unknown k: 2"):
        conversations.joined_or_error(left, right, "k").collect()
    assert conversations.semi_or_all(left, right.where("k = 7"), "k").count() == 2 and conversations.semi_or_all(left, right, "k").count() == 1


def test_progress_of_skipped_runs(spark):
    from parley.operators import runs

    rows = [(1, i, f"2024-01-01 00:00:0{i}", p, "skipped") for i, p in enumerate(runs.PHASES)] + [(2, 9, "2024-01-01 00:00:00", runs.PHASES[0], "warning"), (2, 10, "2024-01-01 00:00:01", runs.PHASES[1], "running")]
    events = spark.createDataFrame(rows, "run_id int, event_id int, ts string, phase string, status string")
    reached = spark.createDataFrame([(2, runs.PHASES[1], 70.0)], "run_id int, phase string, percent double")
    assert {tuple(r) for r in runs.progress(events, reached).collect()} == {(1, 100.0), (2, 10.0)}
    with pytest.raises(ValueError):
        runs.resolved(spark.createDataFrame([("r", "r", "", "")], "folder string, run_id string, created string, updated string"), "q")


def test_gate(spark):
    clusters = spark.createDataFrame([(1, True), (2, False), (3, True)], "cluster_id int, kept_by_threshold boolean")
    audits = spark.createDataFrame([(1, 4), (2, 5)], "cluster_id int, rating int")
    assert [(r.rating, r.final_kept) for r in privacy.gate(clusters, audits).orderBy("cluster_id").collect()] == [(4, True), (5, False), (1, False)]


def test_privacy_summary(spark):
    audits = spark.createDataFrame([("s", r) for r in (2, 3, 4, 5)], "stage string, rating int")
    row = privacy.summary(audits, 3).first()
    assert (row.total, row.passed, row.failed, row.pass_rate, row.histogram) == (4, 3, 1, 0.75, "2:1,3:1,4:1,5:1")


class Flaky:
    def complete(self, task, items):
        if any("bad" in t for _, t in items):
            raise providers.ProviderError("no answer")
        return [{"id": k, "name": t, "description": "d"} for k, t in items]


class Careless:
    """Swaps the first two, leaves out the third, answers the fourth twice and one that was not asked."""

    def complete(self, task, items):
        out = [{"id": k, "name": t, "description": "d"} for k, t in items]
        if len(out) < 4:
            return out
        return [out[1], out[0], out[3], out[3], {"id": 99, "name": "?", "description": "?"}]


class Broken:
    def complete(self, task, items):
        raise KeyError("a mistake of the program")


def test_provider_falls_back(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(6)], "k int, t string").coalesce(1)
    got = {r.k: r for r in providers.answered(df, "k", "t", "label", providers.LABEL, providers.NO_LABEL, Flaky(), batch=3).collect()}
    assert got[3].name == "Cluster 3" and got[3].fallback_used and got[0].name == "t0" and not got[0].fallback_used and got[4].fallback_used
    assert got[3].error == "no answer"


def test_answers_go_by_id(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "k int, t string").coalesce(1)
    got = {r.k: r for r in providers.answered(df, "k", "t", "label", providers.LABEL, providers.NO_LABEL, Careless(), batch=4).collect()}
    assert [got[i].name for i in range(4)] == ["t0", "t1", "t2", "t3"]
    assert (got[2].fallback_used, got[2].error) == (True, "MissingConversationInBatchOutput")
    assert (got[3].fallback_used, got[3].error) == (False, "DuplicateConversationIdInBatchOutput")
    assert providers.reconciled([1], [{"id": 2}])[1] == {2: "UnexpectedConversationIdInBatchOutput", 1: "MissingConversationInBatchOutput"}


def test_mistakes_are_not_fallbacks(spark):
    df = spark.createDataFrame([(1, "t")], "k int, t string")
    with pytest.raises(Exception, match="a mistake of the program"):
        providers.answered(df, "k", "t", "label", providers.LABEL, providers.NO_LABEL, Broken())


def test_failed_audits_rate_lowest(spark):
    texts = spark.createDataFrame([("raw", "1", "bad"), ("raw", "2", "fine")], "stage string, id string, content string")
    got = {r.id: r for r in providers.audited(texts, Auditor()).collect()}
    assert (got["1"].rating, got["1"].fallback_used, got["2"].rating) == (1, True, 4)


class Auditor:
    def complete(self, task, items):
        if any("bad" in t for _, t in items):
            raise providers.ProviderError("no answer")
        return [{"id": k, "rating": 4, "justification": "-"} for k, _ in items]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    row = conversations.dataset_summary(none, F.col("conv_id")).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0, 0)
    assert conversations.facet_statistics(none).count() == 0
    points = spark.createDataFrame([], "vec_id long, label int, v array<double>")
    assert vectors.calinski_harabasz(points).first().score is None and vectors.silhouette(points).first().score is None


def test_snapshot_has_no_user(spark):
    held = conversations.assemble(spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert held.columns == ["conversation_id", "messages"] and [m.content for m in held.first().messages] == ["a", "b"]


def test_tables_of_a_run(spark, tmp_path):
    folder, schema = str(tmp_path), "id long, name string"
    assert tables.read_or_empty(spark, f"{folder}/none", schema).count() == 0
    for k in range(2):
        tables.append(spark.createDataFrame([(k, None if k else "a")], schema), f"{folder}/partial")
    tables.write_lines(spark.read.parquet(f"{folder}/partial"), f"{folder}/lines")
    held = jsonl.read_lines(spark, f"{folder}/lines")
    assert sorted(r.line for r in held.collect()) == ['{"id":0,"name":"a"}', '{"id":1}']
    assert tables.resumable(spark, folder, "facets").count() == 0 and [t.count() for t in tables.resumable_privacy(spark, folder)] == [0, 0]
    spark.createDataFrame([("raw", "1", 5, "-", False, None)], tables.RESUMABLE["privacy_audit"]).write.parquet(f"{folder}/privacy_audit")
    assert [t.count() for t in tables.resumable_privacy(spark, folder)] == [0, 0]  # one without the other
    assert [r.line_number for r in tables.tail(spark.range(1, 31).select(F.col("id").alias("line_number")), 1).collect()] == list(range(11, 31))


def test_widths_follow_waves():
    assert providers.waves([0, 2, 0], 4, 5) == [4, 5, 4]
    assert [providers.next_width(4, i, 5, left) for i, left in ((0, True), (2, True), (0, False))] == [5, 3, 4]
    assert providers.next_width(5, 0, 5) == 5 and providers.next_width(1, 1, 5) == 1


def test_ablation_tells_texts_apart(spark):
    rows = [(i, "cat", "purr meow purr", "same words", "x y") if i % 2 else (i, "dog", "bark woof bark", "same words", "x y") for i in range(20)]
    got = {r.representation: r for r in evaluate.ablation(spark.createDataFrame(rows, "id long, truth string, good string, bad string, none string"), "id", ["good", "bad", "none"], 2).collect()}
    assert got["good"].macro_f1 == 1.0 and got["bad"].macro_f1 < 0.6 and got["good"].n == 20
    assert (got["none"].n, got["none"].accuracy, got["none"].error, got["good"].error) == (20, 0.0, "no words", None)
    assert [r.line for r in tables.report_lines(spark.createDataFrame([got["good"]], "representation string, n long, accuracy double, macro_f1 double, weighted_f1 double, error string, vectors string")).collect()] == [*tables.REPORT_HEAD, "| good | 20 | 1.0000 | 1.0000 | 1.0000 |"]


def test_a_provider_that_fails_is_replaced_and_said_so(spark):
    from collections import Counter

    from pyspark.ml.functions import array_to_vector

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"), "text", F.concat(F.lit("* "), "text").alias("marked"))
    got = {r.representation: r for r in evaluate.ablation(docs, "doc_id", ["text", "marked"], 4, provider=plans.FailingEmbedder()).collect()}
    assert (got["text"].vectors, got["text"].error, got["marked"].vectors, got["marked"].error) == ("provider", None, "tfidf", "no vectors")
    vectors = providers.embedded(docs, "doc_id", "text").select("doc_id", array_to_vector("v").alias("v"))
    for name, v in (("text", vectors), ("marked", evaluate.tfidf(docs, "doc_id", "marked"))):
        rows = evaluate.clustered(docs, v.sort("doc_id"), "doc_id", 4).collect()
        named = {}
        for c in {r.cluster_id for r in rows}:
            own = sorted((r.doc_id, r.truth) for r in rows if r.cluster_id == c)
            n = Counter(t for _, t in own)
            named[c] = max(n, key=lambda t: (n[t], -next(i for i, x in own if x == t)))
        hits = sum(named[r.cluster_id] == r.truth for r in rows)
        f1 = []
        for t in {r.truth for r in rows} | set(named.values()):
            tp = sum(r.truth == t == named[r.cluster_id] for r in rows)
            f1.append(2 * tp / (sum(r.truth == t for r in rows) + sum(named[r.cluster_id] == t for r in rows)))
        assert abs(got[name].accuracy - hits / len(rows)) < 0.05 and abs(got[name].macro_f1 - sum(f1) / len(f1)) < 0.08 and got[name].n == len(rows)


def test_silhouette_sample_is_not_a_prefix(spark):
    rows = [(i, int(i >= 300), [float(i >= 300), (i % 7) / 100]) for i in range(600)]
    points = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    assert vectors.silhouette(points, sample=300).first().score > 0.9


def test_main_components_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (80, 5)) * [5, 1, 3, 0.5, 0.1] + 7
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = np.array([[r.x, r.y] for r in vectors.pca_map(points).orderBy("vec_id").collect()])
    _, _, loads = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    loads = loads[:2] * np.sign(loads[:2][np.arange(2), np.abs(loads[:2]).argmax(axis=1)])[:, None]
    assert np.allclose(got, (v - v.mean(axis=0)) @ loads.T)
