"""Filter audit, histogram packing and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import fill_middle, filter_audit, histogram_packing
from parley.llm import queries as Q
from tests.llm.test_llm import SF
from tests.oracle import same

CLASHING = ("row", "n", "words", "mask", "part", "task", "number", "start", "length", "mark", "x", "d", "output", "form", "shard", "good", "toxic")


def clashing(df):
    return df.withColumns({k: F.lit(7) for k in CLASHING})


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_matches_sql(spark, name):
    same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


def odd_documents(spark):
    long = " ".join(f"Word{i % 7000}" for i in range(60_000))
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(5, words, "en"), (3, words, "de"), (3, words, "de"), (3, words, None), (9, words, "en"), (None, words, "en"), (None, words, "en"), (7, None, "en"), (8, "", None)]
    rows += [(1, "A# b", "en"), (2, "a " * 200, "en"), (2, "a " * 200, "en"), (4, long, "fr"), (6, "x\x1cy z " * 150, "fr"), (10, "<P> a b", "en"), (11, " \n ", "en"), (12, "ÄÖ 日本\n\n語 ", "en")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string")), rows


def plain_masks(rows):
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]
        smaller = [i for i, t, _ in rows if (t or "") == text and i is not None and (doc_id is None or i < doc_id)]
        out.append((doc_id, part or "", [*fails, bool(smaller)]))
    return out


def plain_audit(rows, labels):
    out = {}
    held = plain_masks(rows)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    for part in {p for _, p, _ in held}:
        own = [(i, f) for i, p, f in held if p == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [f, len(left), len(gone), sum(x[1][k] for x in own) - len(gone), sum(x[1][k] and sum(x[1]) == 1 for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[out[key][0]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("chain", [1 << 26, 1])
def test_audit_equals_a_plain_one(spark, monkeypatch, chain):
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", chain)
    docs, rows = odd_documents(spark)
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, None), (2, None, 1), (None, 1, 1), (77, 1, 1)]
    got = filter_audit.filter_audit(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({k: F.lit(7) for k in ("good", "part", "mask", "n")})).collect()
    wanted = plain_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == wanted
    assert len(got) == len(wanted) == 600 * 4


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, "a", None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_texts_that_share_a_fingerprint_stay_apart():
    chains = filter_audit.Chains()
    got = [x for i, data in ((4, b"a"), (2, b"b"), (3, b"a"), (1, b"b"), (9, b"b")) for x in chains.add(77, data, i, 0, {"p": 1})]
    assert sorted(got) == [(2, "p", 16, 1), (4, "p", 16, 1), (9, "p", 16, 1)]
    assert sorted(x[2] for x in chains.drained()) == [1, 3]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def test_ids_are_those_of_the_library(library):
    encode, rng = histogram_packing.TokenIds(Q.tokenizer_path()), random.Random(4)
    assert encode.fast is not None
    pool = [chr(c) for c in [*range(300), 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x4E00, 0x661, 0xB2, 0x301]] + ["'s", "'ll", "  ", "<|endoftext|>", "word", " the"] * 9
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" " * 400_000, "x" + "\n " * 100_000]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_another_kind_of_vocabulary():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = histogram_packing.TokenIds(path)
    assert encode.fast is None
    assert np.frombuffer(encode("Some words"), "<u4").tolist() == Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids


def held_to_contract(pieces, rows, library, window, end_id=1):
    """Every id of every document lies in one piece, sequences have no gaps, and checksums are right; the tokens of padding."""
    ids = defaultdict(list)  # rows may repeat an id
    for doc_id, text in rows:
        ids[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, end_id])
    by_sequence, tokens = defaultdict(list), 0
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        crcs = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id] if len(x) == r.doc_tokens}
        assert r.ids_crc32 in crcs and r.length > 0
        tokens += r.length
    for doc_id, held in ids.items():
        cover = defaultdict(int)
        for r in pieces:
            if r.doc_id == doc_id:
                for k in range(r.start, r.start + r.length):
                    cover[r.doc_tokens, k] += 1
        for n in {len(x) for x in held}:
            assert [cover[n, k] for k in range(n)] == [sum(len(x) == n for x in held)] * n
    assert tokens == sum(len(x) for held in ids.values() for x in held)
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(by_sequence), tokens


def test_packing_holds_its_contract(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Q.queries()["op12_histogram_packing"](spark, SF).collect()
    padding, sequences, tokens = held_to_contract(got, rows, library, 2048)
    assert padding == 0 and sequences <= -(-tokens // 2048) + 11
    whole = {r.doc_id for r in got if r.length == r.doc_tokens}
    assert len(whole) > 0.6 * sum(1 for _, t in rows if len(library.encode(t, add_special_tokens=False).ids) < 2047)


@pytest.mark.parametrize("shard", [50_000, 5])
def test_packing_of_odd_rows(spark, library, monkeypatch, shard):
    monkeypatch.setattr(histogram_packing, "SHARD_ITEMS", shard)
    docs, rows = odd_documents(spark)
    got = histogram_packing.pack(docs.repartition(3), Q.tokenizer_path(), window=64).collect()
    padding, _, _ = held_to_contract(got, [r[:2] for r in rows], library, 64)
    assert padding == 0
    assert histogram_packing.pack(docs.limit(0), Q.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        histogram_packing.pack(docs, Q.tokenizer_path(), window=100)


def test_sequences_hold_the_ids(spark, library):
    docs, rows = odd_documents(spark)
    pieces = histogram_packing.pack(docs, Q.tokenizer_path(), window=128)
    got = histogram_packing.sequences(pieces, docs, Q.tokenizer_path(), window=128).collect()
    assert all(len(r.ids) == r.n_tokens and (r.n_tokens == 128 or r.n_tokens & (r.n_tokens - 1) == 0) for r in got)
    wanted = sorted(i for r in rows for i in [*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
    assert sorted(i for r in got for i in r.ids) == wanted
    padded = histogram_packing.sequences(pieces.where("offset = 0 and length not in (1, 2, 4, 8, 16, 32, 64, 128)"), docs, Q.tokenizer_path(), window=128).collect()
    assert padded and all(len(r.ids) == 128 and r.ids[r.n_tokens :] == [0] * (128 - r.n_tokens) for r in padded)


def brute_nnls(a, b):
    """Non-negative least squares by trying every set of columns that may be positive."""
    best = float((b**2).sum())
    for bits in range(1, 1 << a.shape[1]):
        on = [k for k in range(a.shape[1]) if bits >> k & 1]
        x, *_ = np.linalg.lstsq(a[:, on], b, rcond=None)
        if (x >= -1e-9).all():
            best = min(best, float(((a[:, on] @ x - b) ** 2).sum()))
    return best


def test_least_squares_and_combinations():
    rng = np.random.default_rng(3)
    for window in (6, 9, 12):
        for _ in range(4):
            counts = np.append(0, rng.integers(0, 9, window - 1))
            combos = histogram_packing.combinations(np.flatnonzero(counts), window)
            there = set(np.flatnonzero(counts).tolist())
            wanted = {c for c in ((a, b, window - a - b) for a in there for b in there | {0} if a >= b >= window - a - b >= 0) if c[2] in there | {0} and (c[1] or not c[2])}
            assert {tuple(c) for c in combos.tolist()} == {c for c in wanted if c[1]}
            a = np.array([[np.count_nonzero(c == k) for c in combos] for k in range(1, window)], float)
            b = counts[1:].astype(float)
            x = histogram_packing.least_squares(combos, np.append(counts, 0).astype(float))
            assert (x >= 0).all() and float(((a @ x - b) ** 2).sum()) <= brute_nnls(a, b) + 0.05
            chosen, repeats = histogram_packing.planned(np.append(counts, 0), window)
            used = sum(n * np.bincount(c, minlength=window + 1) for c, n in zip(chosen, repeats, strict=True)) if len(chosen) else np.zeros(window + 1)
            assert (used[1:window] <= counts[1:]).all()


def test_greedy_leaves_no_gap():
    rng = random.Random(5)
    for window in (8, 16, 64):
        for n in (1, 2, 30, 200):
            sizes = [rng.randint(1, window - 1) for _ in range(n)]
            got = histogram_packing.greedy(sizes, window)
            filled = defaultdict(int)
            for item, start, length, sequence, offset in got:
                assert offset == filled[sequence] and 0 <= start and start + length <= sizes[item]
                filled[sequence] += length
            assert sum(filled.values()) == sum(sizes) and all(v & (v - 1) == 0 and v <= window for v in filled.values())
            assert sum(v == window for v in filled.values()) == sum(sizes) // window


def plain_middle(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(fill_middle.UNIT, text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_a_plain_one_and_is_undone(spark):
    docs, rows = odd_documents(spark)
    rng = random.Random(6)
    more = [(100 + i, "".join(rng.choice(["<", "P", ">", "<P", "M>", " ", "\n", "é", "日", "word", "\x1c", " "]) for _ in range(rng.randint(0, 40))), "en") for i in range(600)]
    docs = docs.unionByName(clashing(spark.createDataFrame(more, "doc_id long, text string, lang string")))
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("back", fill_middle.restored("output", "form")).withColumn("d", fill_middle.digests(F.col("output"), F.col("form"))).collect()
    plain = lambda x: sorted(x, key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = [(i, *(p := plain_middle(i, t)), t or "", sha(p[4]), sha(t or "")) for i, t, _ in [*rows, *more]]
    assert plain((*tuple(r)[:7], r.d.output_sha256, r.d.restored_sha256) for r in got) == plain(wanted)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_shares_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"))
    n = {r.form: r["count"] for r in fill_middle.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] / 4000 - 0.5) < 0.03 and abs(n["spm"] / (n["spm"] + n["psm"]) - 0.8) < 0.03
    n = {r.form for r in fill_middle.fill_in_middle(docs, moved=100, suffix_first=0).select("form").distinct().collect()}
    assert n == {"psm"}
