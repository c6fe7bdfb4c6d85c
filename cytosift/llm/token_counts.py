"""Token counts of fields and sections by offset mapping.

Each document is encoded once as a whole. Every token's character span follows from the bytes of the tokens, and the spans
are joined to the sections' intervals by a merge on their sorted ends. A token that crosses a boundary is allocated by an
explicit rule:

* ``first``: to the section that holds its first character;
* ``last``: to the section that holds its last character;
* ``most``: to the section that holds most of its characters, the earlier of equals.

A token that ends inside a character (byte-level tokens may) spans that character. Sections are gapless, so the counts of
a document's sections add up to its tokens. Cases: a null or empty text has one empty section without tokens; a very long text
is encoded whole (runs of white space of any length too, see ``tokens``); of sections that hold equally many characters of a token
the earliest gets it; repeated rows are counted each; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batches, slices
from .tokens import tokens

RULES = ("first", "last", "most")


def sections(text: str) -> list[int]:
    """Ends of the sections (characters): each line with its line end."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def spans(data: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (inclusive) of each token, from the text's UTF-8 bytes and the tokens' lengths in bytes."""
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    end = np.cumsum(token_bytes)
    return char[end - token_bytes], char[end - 1]


def allocate(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens of each that cross into a later section)."""
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
    to = a
    if rule == "last":
        to = b
    elif rule == "most":
        to = a.copy()
        for i in np.flatnonzero(a != b):
            cuts = np.concatenate(([first[i]], ends[a[i] : b[i]], [last[i] + 1]))
            to[i] += int(np.diff(cuts).argmax())
    return np.bincount(to, minlength=len(ends)), np.bincount(a[a != b], minlength=len(ends))


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, start_char, end_char, n_tokens, n_crossing) of every line of every text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "section", "start_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(vocabulary, pattern)
        size = own.sizes()
        for part in slices(batches):
            rows, cols = [], [[] for _ in range(5)]
            for i, x in enumerate(part.column("text").to_pylist()):
                x = x or ""
                ends = np.array(sections(x))
                ids = own(x)
                first, last = spans(np.frombuffer(x.encode(), np.uint8), size[ids]) if len(ids) else (ids.astype(np.int64), ids.astype(np.int64))
                n, crossing = allocate(first, last, ends, rule)
                rows.append(np.full(len(ends), i))
                for c, v in zip(cols, (np.arange(len(ends)), np.concatenate(([0], ends[:-1])), ends, n, crossing), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c), pa.int64()) for c in cols)], names)

    return by_batches(docs.select(docs[key].alias("key"), docs[text].alias("text"))).mapInArrow(run, f"key {kind}, " + ", ".join(f"{x} long" for x in names[1:])).withColumnRenamed("key", key)
