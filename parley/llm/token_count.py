"""Token counts by byte-pair merging, without making any token identifiers.

A text is cut at special strings (one token each) and by the tokenizer's pattern; each piece starts as a linked list of byte
symbols with a heap of adjacent pairs by rank. The lowest-rank pair is popped and merged again and again; the count is the
initial number of symbols less the merges. Pieces recur, so each Python worker remembers the counts of up to ``MEMORY`` pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import small_batches

#: Fixed value: the pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairMerger:
    """Counts tokens of texts as the vocabulary file (the JSON form, byte-level BPE) does."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        with open(vocabulary, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        if model["type"] != "BPE" or held["normalizer"] or held["pre_tokenizer"]["type"] != "ByteLevel" or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are counted")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in reversed([*enumerate(merges)])}
        self.letters = byte_letters()
        self.pieces = regex.compile(PATTERN).findall
        special = sorted((t["content"] for t in held["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece of the pattern."""
        symbols: list[str | None] = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = left = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank, heap = self.ranks.get, []
        for i in range(n - 1):
            if (r := rank((symbols[i], symbols[i + 1]))) is not None:
                heappush(heap, (r, i, symbols[i], symbols[i + 1]))
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if symbols[i] == a else -1
            if j < 0 or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h, symbols[h], symbols[i]))
        return left

    def _part(self, part: str) -> int:
        """Tokens of a stretch that the pattern never joins with what stands around it."""
        found = 0
        for piece in self.pieces(part):
            got = self.known.get(piece)
            if got is None:
                got = self.merged(piece)
                if len(piece) < 64:
                    if len(self.known) >= MEMORY:
                        self.known.clear()
                    self.known[piece] = got
            found += got
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A blank between two characters that are not white space starts a piece, so texts are cut there and the parts, each with
        its blank, are remembered whole; parts that touch other white space at their ends are counted together.
        """
        if not text:
            return 0
        parts = text.split(" ")
        first, rest = parts[0], parts[1:]
        try:
            found = sum(map(self.whole.__getitem__, rest))
        except KeyError:
            found = self._slowly(rest, first)
            return found
        return found + self._part(first) if first and not first[-1].isspace() else self._part(text)

    @property
    def whole(self) -> dict[str, int]:
        return self.__dict__.setdefault("_whole", {})

    def _slowly(self, rest: list[str], first: str) -> int:
        if not first or first[-1].isspace() or any(not x or x[0].isspace() or x[-1].isspace() for x in rest):
            return self._part(" ".join([first, *rest]))
        found, whole = self._part(first), self.whole
        for x in rest:
            got = whole.get(x)
            if got is None:
                got = self._part(" " + x)
                if len(x) < 64:
                    if len(whole) >= MEMORY:
                        whole.clear()
                    whole[x] = got
            found += got
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


_MERGERS: dict[str, PairMerger] = {}


def merger(vocabulary: str) -> PairMerger:
    """The merger of a vocabulary file, one in each Python worker."""
    if vocabulary not in _MERGERS:
        _MERGERS[vocabulary] = PairMerger(vocabulary)
    return _MERGERS[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of the vocabulary file, at the same place on every executor. Null and empty texts have no bytes
    and no tokens. Ids may be null or repeat. Other columns are not read and may have any name. An empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(vocabulary).count
        for batch in batches:
            text = batch.column("text")
            found = [count(text[i].as_py()) for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return small_batches(texts).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
