"""Fill-in-the-middle: texts with their middle moved to the end, as an Arrow-batched pandas UDF.

A text is cut into units, each a word with the white space before it, or white space that ends the text. Two numbers drawn from
the id say after how many units the prefix and the middle end. The ends of all units are kept in one array of 32-bit numbers, so
a very long text costs 4 bytes a unit, and two lookups give the places at which the text is cut.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import small_batches

#: The units of a text, the marks of its parts, and the percentages.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOVED, SUFFIX_FIRST = 50, 80

_UNITS = regex.compile(UNIT)


def unit_ends(text: str) -> array:
    """Where each unit of ``text`` ends, in code points."""
    return array("I", (m.end() for m in _UNITS.finditer(text)))


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits that depend on ``key`` alone."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(key: str, text: str, moved: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    ends = unit_ends(text)
    one, two, form, order = draws(key)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or form % 100 >= moved:
        return len(ends), "plain", None, None, text
    low, high = sorted((one % (len(ends) + 1), two % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    n counts the units of the whole text. form is plain (output is the text), psm or spm; ``moved`` of 100 texts are not plain, and
    ``suffix_first`` of 100 of those are spm. A text that holds a mark stays plain, so every output can be undone. Null texts count
    as empty, which are plain with no units. Draws depend on the id and the seed alone: rows that repeat an id draw the same
    numbers, a null id draws those of the empty string. Texts of any length are cut whole. Other columns are not read and may have
    any name. An empty table gives an empty result.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            rows = [arranged(k, t, moved, suffix_first) for k, t in zip(keys, texts, strict=True)]
            found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    doc_id = F.col(id_col).cast("long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = small_batches(docs).select(doc_id.alias("doc_id"), run(key, text).alias("x"))
    return held.select("doc_id", "x.n", "x.form", "x.prefix_chars", "x.middle_chars", "x.output")


@F.pandas_udf(T.StringType())
def restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The texts that outputs (output, form) were made of."""
    for outputs, forms in batches:
        yield pd.Series([rebuilt(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in ("output_sha256", "restored_sha256")]))
def _digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for outputs, forms in batches:
        rows = [(digest(o), digest(rebuilt(o, f))) for o, f in zip(outputs, forms, strict=True)]
        yield pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])


def digests(output: Column, form: Column) -> Column:
    """A struct of the SHA-256 of the output, and of the text rebuilt from output and form."""
    return _digests(output, form)
