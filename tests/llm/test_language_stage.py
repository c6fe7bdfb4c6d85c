"""What the pipeline's language stage keeps: the score decides where there are letters enough."""

import base64
import random

import corpus_pipeline

SPEECH = {"en": "the of and to in is that with was for", "de": "der die und das nicht ist ein mit auf wir", "fr": "le la les et des est dans que pour une", "es": "el los las y que en por con una del"}


def test_noise_goes_and_short_or_unlabelled_texts_stay(spark):
    r = random.Random(0)
    clean = [(i, " ".join(r.choice(SPEECH[k].split()) for _ in range(60)), k) for i, k in enumerate(list(SPEECH) * 50)]
    noise = [(1000 + i, base64.b64encode(r.randbytes(9000)).decode(), None) for i in range(5)]
    short = [(2000, "x 12 34", None), (2001, "deadbeef 0451", None)]
    empty = [(3000, None, None), (3001, "12 - 34", None)]
    docs = spark.createDataFrame([*clean, *noise, *short, *empty], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x[0] for x in [*clean, *short]}
    unlabelled = corpus_pipeline.language(spark, docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), "")
    assert {x.doc_id for x in unlabelled.collect()} == {x[0] for x in [*clean, *noise, *short]}
