"""Byte-level BPE encoding and decoding of whole texts (method: length-bucketed padded numpy matrices, see ``bpe``).

A narrow transformation: no shuffle, one Arrow stream a task, sub-batches bounded in bytes, a bounded memo of pieces.
Cases: null text counts as empty; an empty text has no ids; a text of one very long piece is merged with a heap; repeated
rows and ties need no care; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import gather, text_encoder
from .common import by_batches, slices


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary, pattern)
        for part in slices(batches):
            ids, at = encoder([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(at.astype(np.int32), ids)], ["key", "ids"])

    return _two(docs, key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary): the bytes of every row's ids; null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_encoder(vocabulary, pattern).bpe
        for part in batches:
            out = [None if x is None else gather(bpe.token_bytes, bpe.token_at, np.array(x, np.int64))[0].tobytes() for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.binary())], ["key", "data"])

    return encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them: (key, n_tokens, ids_sha256, decoded_sha256)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary, pattern)
        bpe = encoder.bpe
        for part in slices(batches):
            ids, at = encoder([x or "" for x in part.column("text").to_pylist()])
            digits, digits_to = gather(bpe.digits, bpe.digits_at, ids)
            data, data_to = gather(bpe.token_bytes, bpe.token_at, ids)
            written, decoded = memoryview(digits), memoryview(data)
            cut, end = digits_to[at], data_to[at]
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(written[cut[i] : max(cut[i], cut[i + 1] - 1)]).hexdigest() for i in range(n)]),
                    pa.array([hashlib.sha256(decoded[end[i] : end[i + 1]]).hexdigest() for i in range(n)]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _two(docs, key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def _two(docs: DataFrame, key: str, text: str) -> DataFrame:
    return by_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")))
