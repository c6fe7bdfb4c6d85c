"""Cases at edges: nulls, empty tables, repeated rows, clashing columns, piece lengths, many sections, many frequent digests."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cytosift.llm import bpe, chat, common, exact_dedup, near_dup, token_counts, topk, warc
from pyspark.sql import functions as F

from .test_text import DOCS, MULTI, ONE, check_packing, table

CLASH = "row long, rank long, shard int, block int, n long, digest string, unit string, known string, root string, m long, key string, length long"


@pytest.mark.parametrize("path", [MULTI, ONE])
def test_pieces_about_the_heaps_edge(path):
    r = random.Random(7)
    ours = bpe.TextEncoder(bpe.RankBPE(bpe.read_ranks(path)), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = []
    for n in (198, 199, 200, 201, 202):
        texts += ["a" * n, " " * n, "=" * n, "".join(r.choice("etaoinshr") for _ in range(n)), "".join(r.choice("éü") for _ in range(n // 2)) + "x" * (n % 2), "1234567890" * (n // 10) + "1" * (n % 10)]
    ids, at = ours(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == theirs.encode_ordinary(text)


def test_a_token_over_many_sections():
    # one token of 9 characters over four sections of 2, 3, 3 and 1 characters, and one within the last
    ends = np.array([2, 5, 8, 12])
    first, last = np.array([0, 9]), np.array([8, 11])
    for rule, want in (("first", [1, 0, 0, 1]), ("last", [0, 0, 0, 2]), ("most", [0, 1, 0, 1])):
        n, crossing = token_counts.allocate(first, last, ends, rule)
        assert n.tolist() == want and crossing.tolist() == [1, 0, 0, 0]


def test_section_tokens_of_empty_tables_and_repeated_rows(spark):
    count = lambda t: token_counts.section_tokens(t, ONE, public_tokenizers.PATTERN)
    assert count(table(spark, [])).count() == 0
    rows = count(table(spark, ["a b\nc", "a b\nc", None, None], [1, 1, None, 2])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.section, r.n_tokens) for r in rows) == [(False, 1, 0, 3), (False, 1, 0, 3), (False, 1, 1, 1), (False, 1, 1, 1), (False, 2, 0, 0), (True, 0, 0, 0)]


def test_more_frequent_digests_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COUNTERS", 8)
    texts = [f"Copy {i % 40}" for i in range(1000)] + [f"lone {i}" for i in range(50)]
    docs = table(spark, texts)
    slim = common.materialize(exact_dedup.digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    assert 0 < exact_dedup.frequent(slim, counters=8, candidates=5).count() <= 5
    got = exact_dedup.exact_groups(docs).collect()
    assert sum(r.kept for r in got) == 90 and {r.group_size for r in got} == {1, 25}
    assert {r.keep_id for r in got if r.doc_id < 1000} == set(range(960, 1000))


def test_chat_of_repeated_ids_and_very_long_texts(spark):
    long = "long text " * 60_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", long), (3, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_packs(frame, ONE, public_tokenizers.PATTERN), ONE, public_tokenizers.PATTERN).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 1), 2: (1, len(long)), 3: (1, 0)}


def test_clashing_columns_are_no_matter(spark):
    docs = table(spark, ["same words in a text here", "same words in a text here", "other", None])
    plain = {r.doc_id: r for r in near_dup.near_duplicates(docs, words=4).collect()}
    for name in CLASH.split(", "):
        if name.split()[0] not in docs.columns:
            docs = docs.withColumn(name.split()[0], F.lit(None).cast(name.split()[1]))
    assert {r.doc_id: r for r in near_dup.near_duplicates(docs, words=4).collect()} == plain
    assert near_dup.near_dedup(docs).columns == docs.columns and exact_dedup.exact_dedup(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(docs.unionByName(docs)).count() == 3
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 0, 0, 0) for i in range(60)], "vec_id long, embedding array<float>, shard int, block int, rank int")
    assert topk.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 10
    pages = spark.createDataFrame([(1, "u", "x", 5, "d")], "page_id long, url string, html string, row int, digest string")
    path = common.new_path(spark, "warc")
    warc.write(pages, path)
    assert warc.captures(spark, path).count() == 1


def test_pipeline_of_nulls_repeated_ids_and_empty_tables(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    base = DOCS.split(", key")[0]
    rows = [(1, "der und nicht eine " * 4, None, None, None), (1, "the and with from " * 4, "en", "s", 1), (None, "les pour dans avec " * 4, "fr", None, None), (2, None, None, None, None), (3, "THE AND with from " * 4, "en", "s", 1), (4, "", "en", "s", 0)]
    for n, given in (("some", rows), ("none", [])):
        folder = str(tmp_path / n)
        spark.createDataFrame(given, base).write.parquet(f"{folder}/documents.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == ([(False, 1), (False, 3), (True, 0)] if given else [])
    texts = [rows[0][1], rows[4][1], rows[2][1]]
    from types import SimpleNamespace

    got = [SimpleNamespace(**x.asDict() | {"doc_id": {1: 0, 3: 1, None: 2}[x.doc_id]}) for x in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()]
    check_packing(got, texts, 1024)
    assert list((tmp_path / "shared").iterdir())


@pytest.mark.parametrize(("master", "given", "works"), [("local[4]", None, True), ("local", None, True), ("spark://host:7077", None, False), ("local-cluster[2,1,1024]", None, False), ("yarn", "hdfs://x/y/", True)])
def test_tables_between_steps_need_a_shared_folder_off_local_mode(master, given, works):
    from types import SimpleNamespace as Some

    session = Some(conf=Some(get=lambda *_: None), sparkContext=Some(getConf=lambda: {"spark.checkpoint.dir": given}, master=master, applicationId="app"))
    if works:
        assert common.shared_dir(session) == "hdfs://x/y" if given else common.shared_dir(session)
        return
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(session)
