"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import fill_middle, filter_audit, fingerprint, histogram_packing, language_id, license_scan, mixing, near_dup, packing, quality_gam, quality_rules, token_count, url_filter
from parley.llm.profile import CLASSES, SYMBOLS

#: Rules of the url query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Target weights of the mixing query; sources are tempered.
WANTED = {"source": None, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.85, "tabular": 0.05, "numeric": 0.1}}
BUDGET, SEED, ROUNDS = 0.5, 11, 24
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({k: F.round(k, 6) for k in ("char_distance", "word_distance")})


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), WANTED, budget=BUDGET, seed=SEED, rounds=ROUNDS)
    return found.withColumns({k: F.round(k, 9) for k in ("share", "expected")})


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("mark")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=42)
    return made.withColumn("d", fill_middle.digests(F.col("output"), F.col("form"))).drop("output").select("*", "d.*").drop("d")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_quality_rules, op3_best_fit_packing, op4_fingerprints, op5_quality_classifier]
    own += [op6_near_duplicates, op7_token_counts, op8_source_mix, op9_url_filters, op10_language_id]
    own += [op11_filter_audit, op12_histogram_packing, op13_fill_in_middle]
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    phrase = lambda p: " AND ".join(f"ws[i + {k + 1}] = {_quoted(w)}" for k, w in enumerate(p.split()))
    places = " OR ".join(f"({phrase(p)})" for p in license_scan.PHRASES)
    labels = " UNION ALL ".join(f"SELECT r, {_quoted(v)} AS label FROM w WHERE len(list_filter(range(0, len(ws)), lambda i: {phrase(p)})) > 0" for p, v in license_scan.PHRASES.items())
    told = lambda k: "[" + ", ".join(map(_quoted, license_scan.MUST[k].split())) + "]"
    templates = ", ".join(f"({_quoted(k)}, {_quoted(v)}, {told(k)}, {_quoted(license_scan.FAMILIES.get(k, k))})" for k, v in license_scan.TEMPLATES.items())
    longest = license_scan.longest_template(license_scan.TEMPLATES)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, x, regexp_extract_all(x, '{license_scan.WORD}') AS ws
           FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents)),
b AS (SELECT r, doc_id, len(ws) AS n_words, list_filter(range(0, len(ws)), lambda i: {places}) AS p FROM w),
labelled AS ({labels}),
t AS (SELECT k, list_distinct(regexp_extract_all(lower(v), '{license_scan.WORD}')) AS tw, must, family FROM (VALUES {templates}) AS v(k, v, must, family)),
line AS (SELECT r, i, regexp_extract_all(line, '{license_scan.WORD}') AS lw
         FROM (SELECT r, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM w)),
summed AS (SELECT r, i, lw, len(lw) AS n, sum(len(lw)) OVER o AS words, count(*) FILTER (len(lw) = 0) OVER o AS blank FROM line WINDOW o AS (PARTITION BY r ORDER BY i)),
reach AS (SELECT a.r, a.i AS first, max(b.i) AS last FROM summed AS a JOIN summed AS b ON a.r = b.r AND b.i BETWEEN a.i + 1 AND a.i + {longest}
          WHERE a.n > 0 AND b.blank = a.blank AND b.words - b.n - a.words < {longest - 1} GROUP BY ALL),
blocks AS (SELECT r, i AS first, i AS last, list_distinct(lw) AS bw FROM line
           UNION ALL SELECT r, first, last, list_distinct(flatten(list(lw))) FROM reach JOIN line USING (r) WHERE i BETWEEN first AND last GROUP BY r, first, last),
fit AS (SELECT r, first, last, k, len(list_intersect(bw, tw)) / len(tw) AS share FROM blocks, t
        WHERE len(list_intersect(bw, tw)) >= ceil(0.8 * len(tw) - 1e-9) AND len(list_intersect(bw, must)) = len(must)
        QUALIFY row_number() OVER (PARTITION BY r, first, last, family ORDER BY len(must) DESC, len(list_intersect(bw, tw)) DESC, k) = 1),
met AS (SELECT * FROM fit AS a WHERE first = last OR NOT EXISTS (FROM fit AS b WHERE a.r = b.r AND a.k = b.k AND b.first = b.last AND b.first BETWEEN a.first AND a.last)),
apart AS (SELECT *, CASE WHEN coalesce(max(last) OVER (PARTITION BY r, k ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < first, true) THEN first END AS start FROM met),
island AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY r, k ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM apart),
placed AS (SELECT r, share, max(first) OVER (PARTITION BY r, k, island) AS block FROM island),
found AS (SELECT r, max(share) AS share, count(DISTINCT block) AS n_blocks FROM placed GROUP BY r),
every AS (SELECT r, label FROM labelled UNION SELECT r, k FROM met),
listed AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY r),
base AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(listed.labels, '') AS labels,
       round(CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END, 6) AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM b LEFT JOIN base USING (r) LEFT JOIN listed USING (r) LEFT JOIN found USING (r)"""


def url_sql() -> str:
    rules = ", ".join(f"({', '.join(map(_quoted, r))})" for r in RULES)
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
k AS (SELECT r, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
met AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h) DESC, length(p) DESC) AS n
        FROM k JOIN (VALUES {rules}) AS t(h, p, v) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM k LEFT JOIN (SELECT * FROM met WHERE n = 1) AS m USING (r)"""


def mix_sql(source: str = "documents", budget: float = BUDGET) -> str:
    ctes, last = [], "c0"
    for d in mixing.DIMENSIONS:
        wanted = WANTED[d]
        raw = "power(share, 0.5)" if wanted is None else f"CASE {' '.join(f'WHEN {d} = {_quoted(v)} THEN {x}::DOUBLE' for v, x in wanted.items())} ELSE share END"
        ctes.append(f"t_{d} AS (SELECT {d}, raw / sum(raw) OVER () AS {d}_target FROM (SELECT {d}, {raw} AS raw FROM (SELECT {d}, sum(tokens) / sum(sum(tokens)) OVER () AS share FROM cells GROUP BY {d})))")
    ctes.append("c0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS share FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    for k in range(ROUNDS * 3 + 1):  # sources come once more at the end
        d = mixing.DIMENSIONS[k % 3]
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT * REPLACE (share * {d}_target / sum(share) OVER (PARTITION BY {d}) AS share) FROM {last})")
        last = f"c{k + 1}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
                  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'numeric' ELSE 'prose' END AS topic,
                  greatest(1, ceil(coalesce(length(text), 0) / 4))::BIGINT AS tokens FROM {source}),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(ctes)},
rates AS (SELECT source, lang, topic, share, share * ({budget} * (SELECT sum(tokens) FROM cells)::DOUBLE) / tokens AS rate FROM {last})
SELECT doc_id, source, lang, topic, d.tokens, round(share, 9) AS share, round(rate, 9) AS expected,
       (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN rates USING (source, lang, topic)"""


def rules_sql() -> str:
    classes = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^\x00-\x09\x0B-\x20]", "line": r"[^\x0A]", "stop": r"[^.,;:''\"?\-]", "symbol": f"[^{SYMBOLS.replace('$', '[$]').replace('[$]', '$')}]", "beyond": r"[\x00-\x7F]"}
    counted = {k: f"length(regexp_replace(x, '{v}', '', 'g'))" for k, v in classes.items()}
    chars = [f"c_{k}" for k in CLASSES]
    one = ", ".join(f"{v}::DOUBLE AS c_{k}" for k, v in counted.items())
    mark = "length(x) - " + " - ".join(f"c_{k}" for k in counted)

    def distance(pairs: str) -> str:
        return f"sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) FROM {pairs}"

    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (SELECT r, i, list_aggregate(ws[i + 1 : i + 5], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 4)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM dup, range(0, 5) AS s(j) GROUP BY r),
line AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(x, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT *, ({mark})::DOUBLE AS c_mark FROM (SELECT r, x, {one} FROM t)),
f AS (SELECT t.r, doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed
      FROM t JOIN w USING (r) JOIN c USING (r) LEFT JOIN line USING (r) LEFT JOIN rep USING (r)),
big AS (SELECT lang FROM t GROUP BY lang HAVING count(*) >= 30),
g AS (SELECT r, CASE WHEN lang IN (FROM big) THEN '=' || lang ELSE '' END AS grp FROM t),
tok AS (SELECT r, grp, unnest(regexp_extract_all(translate(x, '{_UPPER}', '{_LOWER}'), '{license_scan.WORD}')) AS word FROM t JOIN g USING (r)),
df AS (SELECT grp, word, count(DISTINCT r) AS texts FROM tok GROUP BY ALL),
vocabulary AS (SELECT grp, word AS v FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY texts DESC, word) AS n FROM df) WHERE n <= 100),
h AS (SELECT r, 'c' AS kind, k, n FROM (UNPIVOT (SELECT r, {", ".join(chars)} FROM c) ON {", ".join(chars)} INTO NAME k VALUE n)
      UNION ALL
      SELECT r, 'w', coalesce(v, chr(0)), count(*)::DOUBLE FROM tok LEFT JOIN vocabulary ON word = v AND tok.grp = vocabulary.grp GROUP BY r, coalesce(v, chr(0))),
ref AS (SELECT grp, kind, k, sum(n) AS n FROM h JOIN f USING (r) JOIN g USING (r) WHERE NOT base_failed GROUP BY ALL),
refs AS (SELECT grp, kind, k, n / sum(n) OVER (PARTITION BY grp, kind) AS q FROM ref),
shares AS (SELECT r, kind, k, n / sum(n) OVER (PARTITION BY r, kind) AS p FROM h WHERE n > 0),
side AS (SELECT r, kind, k, p, 0.0::DOUBLE AS q FROM shares UNION ALL SELECT r, kind, k, 0, q FROM g JOIN refs USING (grp)),
pair AS (SELECT r, kind, k, sum(p) AS p, sum(q) AS q FROM side GROUP BY ALL),
far AS (SELECT r, kind, {distance("pair")} GROUP BY r, kind),
d AS (SELECT f.*, grp, coalesce(a.col2, 0) AS cd, coalesce(b.col2, 0) AS wd FROM f JOIN g USING (r) LEFT JOIN far AS a(r, kind, col2) ON f.r = a.r AND a.kind = 'c' LEFT JOIN far AS b(r, kind, col2) ON f.r = b.r AND b.kind = 'w'),
u AS (SELECT grp, round(wd, 4) AS v, count(*) AS n FROM d WHERE NOT base_failed AND n_words >= 40 AND cd <= 0.25 AND wd <= 0.75 GROUP BY ALL),
k AS (SELECT grp, v, sum(n) OVER (PARTITION BY grp ORDER BY v) AS upto, sum(n) OVER (PARTITION BY grp) AS total FROM u),
q AS (SELECT grp, min(v) FILTER (upto >= 0.25::DOUBLE * total) AS q1, min(v) FILTER (upto >= 0.75::DOUBLE * total) AS q3 FROM k WHERE total >= 30 GROUP BY grp)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= 40 AND (cd > 0.25 OR wd > 0.75 OR coalesce(round(wd, 4) > round(q3 + greatest(0.05::DOUBLE, 1.5::DOUBLE * (q3 - q1)), 6), false))) AS kept,
       CASE WHEN n_words >= 40 THEN round(cd, 6) END AS char_distance, CASE WHEN n_words >= 40 THEN round(wd, 6) END AS word_distance
FROM d LEFT JOIN q USING (grp)"""


def audit_sql() -> str:
    fails = {f: f"(m >> {i}) & 1 = 1" for i, f in enumerate(filter_audit.FILTERS)}
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(fails))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^ 	-
]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY x) AS again FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN again THEN 16 ELSE 0 END AS m FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES {letters}) AS t(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INTEGER AS step, f AS filter, bit, (SELECT coalesce(sum(g.bit), 0) FROM f AS g WHERE strpos(filter_order, g.f) < step)::BIGINT AS before
      FROM o, range(1, 6) AS r(step) JOIN f ON f = substr(filter_order, step, 1)),
p AS (SELECT DISTINCT part FROM c),
e AS (SELECT part, filter_order, step, filter,
             coalesce(sum(n) FILTER (m & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & bit > 0 AND m & before = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (m & bit > 0 AND m & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (m & bit > 0 AND m & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (m & bit > 0 AND m & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM e"""


def middle_sql() -> str:
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    part = lambda a, b: f"coalesce(array_to_string(u[{a} : {b}], ''), '')"
    p, s, m = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(x, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u FROM d),
n AS (SELECT *, len(u)::BIGINT AS n, {number(0)} % (len(u) + 1) AS a, {number(1)} % (len(u) + 1) AS b,
             CASE WHEN x = '' OR contains(x, '{p}') OR contains(x, '{s}') OR contains(x, '{m}') OR {number(2)} % 100 >= 50 THEN 'plain' WHEN {number(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, {part(1, "least(a, b)")} AS prefix, {part("least(a, b) + 1", "greatest(a, b)")} AS middle, {part("greatest(a, b) + 1", "n")} AS suffix FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": audit_sql(), "op13_fill_in_middle": middle_sql(), "op1_license_scan": license_sql(), "op2_quality_rules": rules_sql(), "op8_source_mix": mix_sql(), "op9_url_filters": url_sql()}


