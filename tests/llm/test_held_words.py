"""Words counted over texts in bounded memory."""

from collections import Counter

import pyarrow as pa

from parley.llm import common, quality_rules


def test_frequent_words_are_held_while_rare_ones_are_given_on(monkeypatch):
    monkeypatch.setattr(quality_rules, "HELD_WORDS", 20)
    monkeypatch.setattr(common, "SLICE_BYTES", 40)
    texts = [f"the and w{i} w{i + 1} x{i % 7}" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["=en"] * len(texts)), pa.array(texts)], names=["group", "text"])
    given = [r for out in quality_rules._held_by_texts(iter([batch])) for r in out.to_pylist()]
    counts = Counter()
    for r in given:
        counts[r["word"]] += r["n"]
    assert counts == Counter(w for t in texts for w in set(t.split()))
    assert [r["n"] for r in given if r["word"] in ("the", "and")] == [200, 200]
