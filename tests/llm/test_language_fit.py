"""Language ID against a plain re-implementation: frequencies, TF-IDF, every step of the fit, calibration, scores."""

import math
import os
from collections import Counter

import numpy as np
import pytest
import xxhash
from cytosift.llm import langid
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MULT = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def plain_counts(text):
    padded, out = f" {text.lower()} ", Counter()
    for order in (1, 2, 3):
        for i in range(len(padded) - order + 1):
            h = 0
            for k in range(order):
                h = (h + ord(padded[i + k]) + k + 1) * MULT[k] % 2**64
            out[h >> 49] += 1
    return out


def plain_values(counts, idf):
    value = {b: (1 + math.log(n)) * idf(b) for b, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in value.values()))
    return {b: x / norm for b, x in value.items()}


def plain_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_fit(rows, per_language):
    """rows (text, lang) -> (languages, idf, weights by (bucket, class), bias, temperature)."""
    languages = sorted({k for _, k in rows})
    frequency = Counter(b for t, _ in rows for b in plain_counts(t))

    def idf(b):
        return math.log((1 + len(rows)) / (1 + frequency[b])) + 1

    order = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() >> 1
    sample = []
    for k in languages:
        sample += [(order(t), k, t) for t in sorted({t for t, own in rows if own == k}, key=order)[:per_language]]
    made = [({**{b: float(np.float32(v)) for b, v in plain_values(plain_counts(t), idf).items()}, -1: 1.0}, languages.index(k)) for _, k, t in sorted(sample)]
    aside = made[::5] if len(made) >= 50 else []
    used = [x for i, x in enumerate(made) if i % 5 or not aside]
    c, z, n = len(languages), {}, {}

    def weight(b, j):
        a, q = z.get((b, j), 0.0), n.get((b, j), 0.0)
        return 0.0 if abs(a) <= langid.L1 else -(a - math.copysign(langid.L1, a)) / ((langid.BETA + math.sqrt(q)) / langid.ALPHA + langid.L2)

    shuffled = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for i in shuffled.permutation(len(used)):
            value, label = used[i]
            w = {(b, j): weight(b, j) for b in value for j in range(c)}
            p = plain_softmax([sum(x * w[b, j] for b, x in value.items()) for j in range(c)])
            for b, x in value.items():
                for j in range(c):
                    g = x * (p[j] - (j == label))
                    before = n.get((b, j), 0.0)
                    z[b, j] = z.get((b, j), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA * w[b, j]
                    n[b, j] = before + g * g
    logits = [([sum(x * weight(b, j) for b, x in value.items()) for j in range(c)], label) for value, label in aside]

    def loss(log_t):
        return -sum(math.log(plain_softmax([x / math.exp(log_t) for x in row])[label] + 1e-12) for row, label in logits) / len(logits)

    best = min(np.arange(-4, 3, 0.001), key=loss) if logits else 0.0
    return languages, idf, weight, math.exp(best)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("per_language", [8, 20])
def test_fit_and_scores_equal_a_plain_implementation(spark, per_language):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 1500")
    train = docs.where(~langid.held_out(F.col("doc_id")))
    rows = [(r.text, r.lang) for r in train.collect() if r.text is not None and r.lang is not None]
    model = langid.fit(train, per_language=per_language)
    languages, idf, weight, temperature = plain_fit(rows, per_language)
    assert model.languages == languages
    buckets = {b for t, _ in rows for b in plain_counts(t)}
    assert max(abs(model.idf[b] - idf(b)) for b in buckets) < 1e-12
    assert max(abs(model.weights[b, j] - weight(b, j)) for b in range(langid.BUCKETS) for j in range(len(languages))) < 1e-9
    assert max(abs(model.bias[j] - weight(-1, j)) for j in range(len(languages))) < 1e-9
    assert abs(math.log(model.temperature) - math.log(temperature)) < 0.002
    for r in langid.identify(docs, model).collect():
        if not langid.has_letter(r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        value = plain_values(plain_counts(r.text), idf)
        p = plain_softmax([(sum(x * weight(b, j) for b, x in value.items()) + weight(-1, j)) / model.temperature for j in range(len(languages))])
        assert abs(r.score - max(p)) < 1e-9 and r.lang_pred == languages[p.index(max(p))]


def test_copies_do_not_thin_the_sample(spark):
    rows = [(f"text number {i % 100} in words", "xx") for i in range(5000)] + [(f"anderer text {i}", "yy") for i in range(30)]
    sampled = []
    docs = spark.createDataFrame(rows, "text string, lang string")
    old = langid.ftrl
    langid.ftrl = lambda used, classes, **more: (sampled.extend(used), old(used, classes, **more))[1]
    try:
        langid.fit(docs, per_language=60)
    finally:
        langid.ftrl = old
    assert len(sampled) == 72  # of 60 and 30 different texts, less the fifth set aside


def test_identify_on_empty_tables_null_keys_and_very_long_texts(spark):
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "the and with " * 5, "xx"), (2, "der und nicht " * 5, "yy"), (None, "the with", None), (None, None, None), (5, "the and " * 300_000, None), (6, "1" * 2_000_000, None)], kind)
    model = langid.fit(docs)
    got = langid.identify(docs.withColumn("held", langid.held_out(F.col("doc_id"))), model).collect()
    assert [r.held for r in got if r.doc_id is None] == [False, False]
    assert [r.lang_pred for r in got] == ["xx", "yy", "xx", "und", "xx", "und"]
    empty = spark.createDataFrame([], kind)
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty).languages == []
