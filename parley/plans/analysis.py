"""Queries of clusters, labels, audits and single conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import clustering, conversations, hierarchy, privacy, providers, runs, visuals
from parley.plans import _AUDITS, _FACETS, _LABELS, _TREE, audits, extracted, messages, points, query, source_labels, table, tree

#: The rule by which the offline provider rates 1.
_CONTACT = r"[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d ().-]{7,}\d"


@query(rf"""WITH {_FACETS}, {_LABELS}, c AS (
 SELECT 'raw_conversation' AS stage, conv_id::VARCHAR AS id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id
 UNION ALL SELECT 'facet_summary', conversation_id::VARCHAR, 'summary=' || summary || chr(10) || 'task=' || task || chr(10) || 'language=unknown' || chr(10) || 'turn_count=' || turn_count FROM facets
 UNION ALL SELECT 'cluster_summary', cluster_id, name || ': ' || description FROM named)
 SELECT stage, id, CASE WHEN regexp_matches(x, '{_CONTACT}') THEN 1 ELSE 5 END AS rating, CASE WHEN contains(x, '@') THEN 'contact data' ELSE 'rule' END AS justification, false AS fallback_used, NULL::VARCHAR AS error FROM c""")
def privacy_stages(spark, sf_dir):
    raw = conversations.audit_text("raw_conversation", conversations.assemble(messages(spark, sf_dir)))
    turns = conversations.facet_statistics(messages(spark, sf_dir)).select(F.col("conv_id").alias("conversation_id"), "turn_count")
    facets = conversations.audit_text("facet_summary", extracted(spark, sf_dir).join(turns, "conversation_id"))
    clusters = conversations.audit_text("cluster_summary", source_labels(spark, sf_dir))
    return providers.audited(raw.union(facets).union(clusters))


@query("SELECT label::INTEGER AS label, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ORDER BY n DESC, label LIMIT 1")
def largest_cluster(spark, sf_dir):
    return clustering.largest(points(spark, sf_dir))


@query("SELECT label::INTEGER AS cluster_id, vec_id AS conversation_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position FROM embeddings")
def cluster_members(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("conversation_id"), F.col("vec_id").alias("ord"))
    return clustering.members(p, "ord")


@query("SELECT label::INTEGER AS cluster_id, count(*) AS size, count(DISTINCT vec_id % 37) AS unique_users, count(*) >= 45 AND count(DISTINCT vec_id % 37) >= 20 AS kept_by_threshold FROM embeddings GROUP BY label")
def facet_rollup(spark, sf_dir):
    p = points(spark, sf_dir)
    facets = p.select(F.col("vec_id").alias("conversation_id"), F.col("label").alias("cluster_id"))
    return clustering.rolled_up(facets, p.select(F.col("vec_id").alias("conversation_id"), (F.col("vec_id") % 37).alias("user_id")), min_users=20, min_conversations=45)


@query("SELECT kept, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, vec_id % 4 <> 0 AND label % 2 = 0 AS kept FROM embeddings) GROUP BY kept")
def kept_and_filtered(spark, sf_dir):
    p = points(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.col("label") % 2 == 0).alias("kept_by_threshold"))
    kept, rest = clustering.kept_split(p)
    summed = lambda df, name: df.agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).select(F.lit(name).alias("kept"), "n", "first").where("n > 0")
    return summed(kept, True).union(summed(rest, False))


@query("SELECT vec_id, label::INTEGER AS cluster_id, CASE WHEN label % 2 = 0 THEN 'k' || label ELSE 'Cluster ' || label END AS name, CASE WHEN label % 2 = 0 THEN label > 4 ELSE vec_id % 3 = 0 END AS kept_by_threshold FROM embeddings ORDER BY vec_id LIMIT 1600")
def visual_points(spark, sf_dir):
    p = points(spark, sf_dir).select("vec_id", F.col("label").alias("cluster_id"), (F.col("vec_id") % 3 == 0).alias("kept_by_threshold"))
    labels = p.select("cluster_id").distinct().where("cluster_id % 2 = 0").select("cluster_id", F.concat(F.lit("k"), F.col("cluster_id").cast("string")).alias("name"), (F.col("cluster_id") > 4).alias("kept"))
    return clustering.visual_points(p, labels, order="vec_id").select("vec_id", "cluster_id", "name", "kept_by_threshold")


@query("""WITH g AS (SELECT DISTINCT label::INTEGER AS label, label % 3 AS g FROM embeddings), n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), r AS (SELECT g, printf('top-%03d', row_number() OVER (ORDER BY g) - 1) AS id FROM (SELECT DISTINCT g FROM g))
 SELECT printf('leaf-%03d', label) AS node_id, 0 AS level, size, id AS parent_id FROM g JOIN n USING (label) JOIN r USING (g) UNION ALL SELECT id, 1, sum(size)::BIGINT, NULL FROM g JOIN n USING (label) JOIN r USING (g) GROUP BY id""")
def two_level_tree(spark, sf_dir):
    leaves = points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("size"))
    name = F.format_string("leaf-%03d", "label").alias("node_id")
    nodes, edges = hierarchy.two_level(leaves.select(name, F.format_string("Cluster %d", "label").alias("name"), "size"), leaves.select(name, (F.col("label") % 3).alias("label")))
    return nodes.join(edges, nodes.node_id == edges.child_id, "left").select("node_id", "level", "size", "parent_id")


@query("SELECT 'lloyd' AS strategy, count(*) AS points, count(*) FILTER (label < 0) AS negative FROM embeddings UNION ALL SELECT 'density', count(*), 0 FROM embeddings")
def cluster_fits(spark, sf_dir):
    out = None
    for name in ("kmeans", "density"):
        found, _ = clustering.fit(points(spark, sf_dir).drop("label"), name, 8)
        one = found.agg(F.count("*").alias("points"), F.count_if(F.col("label") < 0).alias("negative")).select(F.lit("lloyd" if name == "kmeans" else name).alias("strategy"), "points", "negative")
        out = one if out is None else out.union(one)
    return out


@query("""WITH t AS (SELECT conv_id, string_agg(role || '|' || text, chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)
 SELECT conv_id AS conversation_id, 'u' || conv_id AS user_id, md5(x) AS said, CASE conv_id WHEN 4 THEN 'own' ELSE 'facet' END AS summary, 1 AS cluster_id, CASE conv_id WHEN 4 THEN 'named' ELSE 'k1' END AS cluster_name FROM t WHERE conv_id IN (4, 5)""")
def conversation_detail(spark, sf_dir):
    held = conversations.assemble(messages(spark, sf_dir)).where("conversation_id in (4, 5)")
    enriched = held.where("conversation_id = 4").select("conversation_id", "messages", F.lit("own").alias("summary"), F.lit(1).alias("cluster_id"), F.lit("named").alias("cluster_name"))
    facets = held.select("conversation_id", F.lit("facet").alias("summary"))
    given = held.select("conversation_id", F.lit(1).alias("cluster_id"), F.lit("").alias("user_id"))
    source = held.select("conversation_id", F.concat(F.lit("u"), F.col("conversation_id").cast("string")).alias("user_id"), "messages")
    labels = spark.createDataFrame([(1, "k1")], "cluster_id int, name string")
    both = [conversations.detail(k, enriched, facets, given, labels, source) for k in (4, 5)]
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"]))
    return both[0].union(both[1]).select("conversation_id", "user_id", F.md5(F.array_join(line, "\n")).alias("said"), "summary", "cluster_id", "cluster_name")


@query("SELECT count(*) AS rows, bit_xor(b)::VARCHAR || ':' || sum(b)::VARCHAR AS digest FROM (SELECT ('0x' || substr(md5(props), 1, 15))::BIGINT AS b FROM events)")
def dataset_digest(spark, sf_dir):
    return runs.dataset_digest(table(spark, sf_dir, "events"), "props")


@query("SELECT vec_id, md5(text) AS mark, vec_id % 2 = 0 AS saved FROM (SELECT doc_id AS vec_id, text FROM documents)")
def embedding_resume(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    mark = F.sha2("text", 256).alias("mark")
    saved = d.where("vec_id % 2 = 0").select("vec_id", mark, F.array(F.lit(9.0)).alias("v"))
    found = providers.embedded_rest(d, "vec_id", "text", saved)
    return found.join(d, "vec_id").select("vec_id", F.md5("text").alias("mark"), (F.size("v") == 1).alias("saved"))


@query(f"""WITH {_AUDITS}, {_TREE} SELECT 'map' AS part, unnest(['points', 'kept', 'filtered']) AS name, unnest([count(*)::DOUBLE, count(*) FILTER (vec_id % 3 = 0)::DOUBLE, count(*) FILTER (vec_id % 3 <> 0)::DOUBLE]) AS value FROM embeddings
 UNION ALL SELECT 'hierarchy', unnest(['leaves', 'levels', 'roots']), unnest([(SELECT count(*) FROM leaf)::DOUBLE, 3.0::DOUBLE, (SELECT count(*) FROM top)::DOUBLE])
 UNION ALL SELECT 'privacy', stage, round(count(*) FILTER (rating >= 3) / count(*), 6)::DOUBLE FROM a GROUP BY stage
 UNION ALL SELECT 'evaluation', 'labels', 0.75::DOUBLE""")
def visuals_payload(spark, sf_dir):
    shown = points(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 == 0, True).alias("kept_by_threshold"))
    evaluation = spark.createDataFrame([("labels", 0.75)], "representation string, accuracy double")
    return visuals.payload(shown, *tree(spark, sf_dir), privacy.summary(audits(spark, sf_dir)), evaluation)


@query(f"""WITH {_AUDITS}, {_TREE}, l AS (SELECT DISTINCT label::INTEGER AS label, 'k' || label::INTEGER AS name, label > 4 AS kept FROM embeddings WHERE label % 2 = 0),
 q AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, e.label::INTEGER AS cluster, coalesce(name, 'Cluster ' || e.label::INTEGER) AS name, coalesce(kept, vec_id % 3 = 0) AS kept FROM embeddings AS e LEFT JOIN l ON l.label = e.label),
 w AS (SELECT t.*, round(t.size / coalesce(u.size, (SELECT sum(size) FROM top)), 6) AS share FROM t LEFT JOIN t AS u ON t.parent = u.node_id),
 g AS (SELECT stage, rating, count(*) AS n FROM a GROUP BY ALL)
 SELECT 'point' AS section, vec_id::VARCHAR AS id, cluster::VARCHAR AS parent, name, x, y, NULL::BIGINT AS size, NULL::INTEGER AS level, kept, NULL::DOUBLE AS value, NULL::VARCHAR AS histogram FROM q
 UNION ALL SELECT 'cluster', cluster::VARCHAR, NULL, name, round(avg(x), 6), round(avg(y), 6), count(*), NULL, bool_or(kept), NULL, NULL FROM q GROUP BY cluster, name
 UNION ALL SELECT 'node', node_id, parent, name, NULL, NULL, size, level, NULL, share, NULL FROM w UNION ALL SELECT 'root', node_id, NULL, name, NULL, NULL, size, level, NULL, NULL, NULL FROM w WHERE parent IS NULL
 UNION ALL SELECT 'stage', stage, NULL, NULL, NULL, NULL, sum(n)::BIGINT, NULL, NULL, round(coalesce(sum(n) FILTER (rating >= 3), 0) / sum(n), 6), string_agg(rating || ':' || n, ',' ORDER BY rating) FROM g GROUP BY stage
 UNION ALL SELECT 'ablation', lang, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(avg(quality), 6), NULL FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def visuals_sections(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("label").alias("cluster_id"), (F.col("vec_id") % 3 == 0).alias("kept_by_threshold"))
    labels = p.select("cluster_id").distinct().where("cluster_id % 2 = 0").select("cluster_id", F.concat(F.lit("k"), F.col("cluster_id").cast("string")).alias("name"), (F.col("cluster_id") > 4).alias("kept"))
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("lang").alias("representation")).agg(F.round(F.avg("quality"), 6).alias("accuracy"))
    return visuals.sections(p, labels, *tree(spark, sf_dir), audits(spark, sf_dir), judged)
