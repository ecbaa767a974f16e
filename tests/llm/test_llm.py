"""The training-data operators against SQL, brute force, public tokenizers and held-out labels."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import queries as Q
from parley.llm.fingerprint import edited_fingerprints, likeness, sketches
from parley.llm.language_id import languages
from parley.llm.license_scan import license_scan
from parley.llm.mixing import mix
from parley.llm.near_dup import least_matches, near_duplicates, one_of_each
from parley.llm.packing import best_fit, pack
from parley.llm.quality_gam import quality_scores
from parley.llm.quality_rules import quality_rules
from parley.llm.token_count import PairMerger, token_counts
from parley.llm.url_filter import filter_urls
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


def shingled(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    root, links, sets = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}, {i: shingled(t) for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120)) for _ in range(3)]
    for k in range(90):  # chains of edits about the threshold
        words = base[k % 3].split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(words)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_posterior_bound_grows_with_matches():
    assert least_matches(100, 0.8, 1e-4) > least_matches(100, 0.6, 1e-4) > 0


def test_packing_is_whole_and_without_conflicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pack(docs, capacity=512, shard_items=64).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = got.groupby("doc_id")["tokens"].sum()
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) == total[i] for i, t in texts.items())
    for _, rows in got.groupby("bin"):
        assert rows["tokens"].sum() == rows["bin_tokens"].iloc[0] <= 512
        assert rows["source"].nunique() == len(rows) and rows["doc_id"].map(texts).nunique() == len(rows)
        assert rows.sort_values("offset")["tokens"].cumsum().shift(fill_value=0).tolist() == rows.sort_values("offset")["offset"].tolist()


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    sizes = sorted((rng.randrange(1, 60) for _ in range(200)), reverse=True)
    sources, clusters = [rng.randrange(12) for _ in sizes], [rng.randrange(-1, 20) for _ in sizes]
    left, seen, want = [], [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(x, k) for k, x in enumerate(left) if x >= max(n, 1) and s not in seen[k][0] and (c < 0 or c not in seen[k][1])]
        k = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(100)
            seen.append((set(), set()))
        left[k] -= n
        seen[k][0].add(s)
        seen[k][1].add(c)
        want.append(k)
    assert best_fit(sizes, sources, clusters, 100) == want


def test_token_counts_match_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), PairMerger(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\t  ab's'll1é😀<|endoftext|>.! 　") for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["<|endoftext|>a <|endoftext|>  ", "x" * 5000, " a  b "]
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert found == {r.doc_id: len(library.encode(r.text, add_special_tokens=False)) for r in docs.collect()}


def test_fingerprints_of_shifted_texts_stay_near():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000)).encode()
    a, b, c, d = sketches([text, b"zz" + text, text[::-1], text])
    near = lambda x, y: likeness(x[None], y[None])[0]
    assert near(a, d) == 1 and near(a, b) > 0.9 and near(a, c) < 0.1
    alone = sketches([text])[0]
    assert (alone == a).all()  # what else is in the batch does not matter


def test_edited_fingerprints_match_brute_force(spark):
    from hashlib import sha256

    rows = [(i, "abc défg " * (i % 7) + str(i)) for i in range(40)] + [(7, "twice"), (None, "none"), (3, None), (100, "")]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for x, y in zip(order, order[1:] + order[:1], strict=True):
        text, k = x[1] or "", len(x[1] or "") // 3
        edited = text[: len(text) - k] + (y[1] or "")[:k]
        want.append((x[0] if x[0] is not None else -1, len(text), sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_held_out_quality_and_language(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{k}.parquet") for k in ("documents", "labels"))
    judged = quality_scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (judged["predicted"] == judged["quality"]).mean() > 0.95
    told = languages(docs).where("held_out").join(docs, "doc_id").toPandas()
    assert (told["lang_pred"] == told["lang"]).mean() > 0.95


def test_raking_meets_the_targets(spark):
    found = mix(spark.read.parquet(f"{SF}/documents.parquet"), Q.WANTED).toPandas()
    cells = found.drop_duplicates(["source", "lang", "topic"])
    assert abs(cells["share"].sum() / cells["share"].sum() - 1) < 1e-9
    topics = cells.groupby("topic")["share"].sum() / cells["share"].sum()
    there = {k: v for k, v in Q.WANTED["topic"].items() if k in topics}
    assert np.allclose([topics[k] for k in there], np.array(list(there.values())) / sum(there.values()), atol=1e-6)
    assert (abs(found["copies"] - found["expected"]) < 1).all()


def test_url_rules_by_sweep_and_by_join(spark):
    urls = ["http://a.net/x", "https://m.EXAMPLE.net/en/1?q", "http://example.com/de/", "http://org/fr/", "http://xorg/fr/", "nothing", None, "http://net", "http://b.example.net/de/", "ftp://deep.a.b.net/#x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    sweep = filter_urls(pages, Q.RULES)
    joined = filter_urls(pages, spark.createDataFrame(Q.RULES, "host string, path string, verdict string"), sweep_rules=1)
    assert sorted(map(str, sweep.collect())) == sorted(map(str, joined.collect()))
    assert [r.rule for r in sweep.orderBy("page_id").collect()] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, "net/", "net/"]


OPERATORS = {
    "license": lambda d: license_scan(d),
    "rules": lambda d: quality_rules(d),
    "packing": lambda d: pack(d),
    "fingerprint": lambda d: edited_fingerprints(d),
    "quality": lambda d: quality_scores(d, d.select("doc_id", F.lit(None).cast("int").alias("quality"))),
    "near": lambda d: near_duplicates(d),
    "tokens": lambda d: token_counts(d, Q.tokenizer_path()),
    "mix": lambda d: mix(d, Q.WANTED),
    "languages": lambda d: languages(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, name):
    long = "word " * 30_000
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (None, "x", "en", "s"), (3, "", "en", None), (4, long, "de", "s"), (5, "!!! ###", None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({k: F.lit(7) for k in ("row", "node", "n", "words", "score", "piece", "order", "share", "tokens", "n_words", "chars", "range", "label", "cluster", "mark", "x")})
    got = OPERATORS[name](docs).toPandas()
    extra = sum(-(-30_000 // 2048) - 1 for _ in [0]) if name == "packing" else 0
    assert len(got) == len(rows) + extra
    assert len(OPERATORS[name](docs.limit(0)).toPandas()) == 0


def test_pipeline_stages_keep_the_columns(spark):
    from parley.llm import pipeline as corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert 0 < docs.count() <= before
            before = docs.count()
            if name == "near_duplicates":
                assert brute_classes([(r.doc_id, r.text) for r in docs.collect()]) == {r.doc_id: (r.doc_id, 0) for r in docs.collect()}
    assert out.select("doc_id").distinct().count() == before


def test_one_of_each_keeps_null_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (6, ""), (6, "z")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in one_of_each(docs).collect()) == ["1", "6", "6", "None"]


def test_urls_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (None, None), (2, ""), (3, "http://b.net/" + "x" * 100_000), (4, "no host")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({k: F.lit(7) for k in ("host", "path", "key", "rule", "verdict", "row", "suffix")})
    got = filter_urls(pages, Q.RULES).collect()
    assert len(got) == len(rows)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id in (None, 2, 4)] == [("", "", None, "allow")] * 3
    assert {r.verdict for r in got if r.page_id in (1, 3)} == {"block"}
    assert filter_urls(pages.limit(0), Q.RULES).count() == 0


def test_filters_of_the_pipeline_drop_what_their_operators_reject(spark):
    from parley.llm import pipeline as corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{k}.parquet") for k in ("documents", "labels"))
    scored = {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.classify(spark, docs, SF).collect()} == scored
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.filter_rules(spark, docs, SF).collect()} == kept
    assert 0 < len(scored) < docs.count() and 0 < len(kept) < docs.count()


def test_rules_reject_texts_by_word_distance_alone(spark):
    from parley.llm import pipeline as corpus_pipeline

    rng = random.Random(5)
    common = {"en": "the of and to in is that for was with".split(), "de": "der die und den von zu mit nicht ein eine".split()}

    def text(lang, n=120):
        other = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(n)]
        return " ".join(rng.choice(common[lang]) if lang and rng.random() < 0.27 else w for w in other)

    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(1000, text(None), "en", "s"), (1001, text("de"), "en", "s"), (1002, text("en"), "de", "s"), (1003, text(None), "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert not any(got[i].kept or got[i].base_failed or got[i].char_distance > 0.25 for i in range(1000, 1004))
    assert sum(got[i].kept for i in range(120)) >= 117
    assert {r.doc_id for r in corpus_pipeline.filter_rules(spark, docs, SF).collect()} == {i for i in got if got[i].kept}
    fixed = {r.doc_id for r in quality_rules(docs, word_fence=None).where("kept").collect()}
    assert {1000, 1001, 1002, 1003} <= fixed


def test_rows_drawn_once_meet_all_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(12_000):
        lang = rng.choices(["en", "de", "fr", "es"], [0.7, 0.12, 0.12, 0.06])[0]
        form = rng.choices(["w" * 40, "w" * 37 + " | ", "w" * 39 + "1"], [0.9, 0.03, 0.07])[0]
        rows.append((i, form, lang, rng.choices("abc", [0.9, 0.08, 0.02])[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wanted = {**Q.WANTED, "source": {"a": 0.8, "b": 0.15, "c": 0.05}}
    got = mix(docs, wanted, budget=0.25, keep=("doc_id", "source", "lang", "text")).toPandas()
    assert got["doc_id"].is_unique and abs(len(got) / len(rows) - 0.25) < 0.02
    got["topic"] = ["tabular" if " | " in t else "numeric" if "1" in t else "prose" for t in got["text"]]
    for d, goal in wanted.items():
        shares = got[d].value_counts(normalize=True)
        assert all(abs(shares[v] - w) < 0.03 for v, w in goal.items()), (d, shares)
    # es has 0.06 of the tokens and would need 0.16: all of it is drawn, and the others make up the budget in their proportions
    full = mix(docs, wanted, budget=0.8, keep=("lang",)).toPandas()["lang"].value_counts() / len(rows)
    assert abs(full.sum() - 0.8) < 0.02 and abs(full["es"] - 0.06) < 0.01 and full["de"] > 0.115 and full["fr"] > 0.115
    # a value of one short text does not shrink the corpus
    rare = spark.createDataFrame([(i, "w" * 40 + (" | " if i == 0 else ""), "en", "a") for i in range(2_000)], docs.schema)
    assert abs(mix(rare, Q.WANTED, budget=0.8, keep=("doc_id",)).count() / 2_000 - 0.8) < 0.05


def test_wrapped_notices_match(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy */"
    narrow = "text\n" + "\n".join("Released under the MIT License".split()) + "\nmore"
    apart = "released under\n\nthe mit license"
    both = "Released under the MIT License.\nother words\nLicensed under the Apache\nLicense, Version 2.0"
    texts = [bsd, mpl, narrow, apart, both, "first line\n" + bsd + "\nlast line"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.n_blocks) for r in license_scan(docs).collect()}
    assert got == {0: ("bsd", 1), 1: ("mpl-2.0", 1), 2: ("mit", 1), 3: ("", 0), 4: ("apache-2.0,mit", 2), 5: ("bsd", 1)}


def test_notices_get_the_license_they_name_and_no_other(spark):
    texts = {
        "Released under the Apache License.": "",
        "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
        "Licensed under the GNU Affero General Public License version 3": "agpl-3.0,gpl",
        "the software under license was released in May": "",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-3.0",
        "Licensed under the MIT License": "mit",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0,gpl",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl-3.0",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under the GNU General Public License version 2": "gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Released under\nthe GNU\nAffero General Public License,\nversion 3": "agpl-3.0,gpl",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    with pytest.raises(ValueError):
        license_scan(docs, must={"mit": "other"})


def test_leaders_left_after_the_rounds_are_compared(spark, monkeypatch):
    from parley.llm import near_dup

    monkeypatch.setattr(near_dup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(near_dup, "PART", 1)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*words[:140], *(f"x{i}y{k}" for k in range(8))])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == {i: c for i, (c, _) in brute_classes(rows).items()} and set(got.values()) == {0}
