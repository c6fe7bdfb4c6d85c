"""Near-dedup, language ID, top-k, chat formatting, WARC and the pipeline, against brute force and planted cases."""

import base64
import gzip
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from cytosift.llm import chat, components, langid, near_dup, topk, warc
from pyspark.sql import functions as F

from .test_text import DOCS, ONE, check_packing

WORDS = [a + b for a in ("an", "be", "co", "du", "el", "fi", "go") for b in ("ra", "st", "th", "um", "ly", "er", "in", "ob")]


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = "edit" + str(r.random())
    return " ".join(words)


def corpus(seed, groups=12, alone=60):
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 200)) for _ in range(alone)]
    for _ in range(groups):
        base = prose(r, r.randint(8, 250))
        texts += [edited(r, base, r.randint(0, max(1, len(base.split()) // 25))) for _ in range(r.randint(2, 14))]
    hot = prose(r, 120)
    texts += [edited(r, hot, r.randint(0, 6)) for _ in range(120)] + [hot.upper()] * 60
    r.shuffle(texts)
    return texts + [None, "", "  \n ", "one", "ONE", "two words", "two  words", prose(r, 9000)]


def brute_components(texts, words, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((top(i), top(j)))
                    root[y] = x
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, "k", "b", "u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize(("seed", "region", "cluster"), [(1, 2048, 4096), (2, 8, 16)])
def test_near_duplicates(spark, seed, region, cluster):
    texts = corpus(seed)
    n, want = brute_components(texts, 4)
    got = sorted(near_dup.near_duplicates(table(spark, texts), words=4, region=region, cluster=cluster).collect())
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(i, n[i], want[i], want[i] == i) for i in range(len(texts))]


def test_near_dedup_of_repeated_and_null_keys(spark):
    r = random.Random(5)
    base = prose(r, 100)
    texts = [base, edited(r, base, 1), base, "other words here now then", None, None]
    docs = table(spark, texts, [3, 3, None, 4, 5, 5])
    kept = near_dup.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [3, 4, 5, 5]
    assert near_dup.near_dedup(docs.limit(0)).count() == 0
    assert near_dup.near_duplicates(docs).count() == 6


def test_exact_components_match_pairs():
    r = np.random.default_rng(0)
    for _ in range(60):
        base = r.choice(10**6, 60, replace=False)
        sets = []
        for _ in range(r.integers(2, 30)):
            own = base.copy()
            k = r.integers(0, 16)
            own[:k] = r.integers(10**6, 10**6 + 40, k)
            sets.append(np.unique(own).astype(np.uint64))
        label = near_dup.exact_components(sets, 80)
        m = len(sets)
        linked = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
        reach = np.array(linked)
        for _ in range(6):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert ((label[:, None] == label[None, :]) == reach).all(), m


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1400)] + [(5, 4), (4, 5), (4, 3)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(101, 161)} | {i: 1000 for i in range(1001, 1400)} | {4: 3, 5: 3}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


LANGS = {"xx": "the and with from they this", "yy": "der und nicht eine mit auf", "zz": "les pour dans été avec être"}


def labelled(r, n):
    return [(i, " ".join(r.choice(LANGS[k].split()) for _ in range(r.randint(3, 40))), k) for i in range(n) for k in [r.choice(sorted(LANGS))]]


def test_language_id(spark):
    rows = labelled(random.Random(0), 900)
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 - 456", "yy"), (902, "", None), (903, "der und eine", None)], "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held), per_language=120)
    assert 0 < model.temperature < 20 and (model.weights == 0).mean() > 0.5
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("held", held), model).collect()}
    test = [x for x in rows if got[x[0]].held]
    assert len(test) > 200 and sum(got[i].lang_pred == k for i, _, k in test) >= 0.99 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "yy"]
    none = langid.identify(docs, langid.fit(docs.where("lang IS NULL AND text = 'x'")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    again = langid.identify(docs.withColumn("score", F.lit("x")), model)
    assert again.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and again.schema["score"].dataType.simpleString() == "double"
    wrong = langid.identify(docs.withColumn("lang", F.lit("xx")), model).where("doc_id < 900")
    assert {r.doc_id: r.lang_pred for r in wrong.collect()} == {i: got[i].lang_pred for i, *_ in rows}  # the label is no input


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    logits = r.normal(0, 1, (4000, 3))
    label = (langid.softmax(logits).cumsum(1) > r.random((4000, 1))).argmax(1)
    assert abs(langid.temperature(logits * 5, label) - 5) < 0.5


def brute_top(rows, k=5):
    good = {}
    cand = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        cand.append((i, w))
        good[i] = min(good.get(i, w), w)
    out = []
    for i, q in good.items():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), j) for j, w in cand if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "block", "leaf"), [(10_000, 4096, 256), (150, 3, 8)])
def test_top_k(spark, shard_rows, block, leaf):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.3, 12).tolist()) for i in range(900)]
    rows += [(i, [0.5] * 12) for i in range(900, 1300)]  # one very common vector
    rows += [(1300, None), (1350, [1.0, None]), (1400, [float("nan")] * 12), (1450, [float("inf")] * 12), (None, [1.0] * 12), (1500, [2.0, 1.0]), (1501, []), (1550, [])]
    rows += [(50, [3.0] * 12), (50, [-3.0] * 12), (100, rows[100][1])]  # repeated ids, with other vectors and the same
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_queries=block, leaf=leaf)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(rows)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()) == brute_top(rows[:3])


def test_top_k_of_large_numbers_is_exact(spark):
    rows = [(i, [1e6 + i, 1.0, -7e5]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    cand = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    for i, q in cand:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in cand if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(x) for x in topk.top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=20).collect()) == sorted(want)


@pytest.mark.parametrize("shard_rows", [1000, 30])
def test_top_k_of_numbers_of_any_size(spark, shard_rows):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 10.0 ** r.integers(0, 19), 3)]) for i in range(300)] + [(300, [1e300, 0.0, 1.0]), (350, [-1e300, 1e17, 3.0]), (400, [1e306, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cand = [(i, [int(y) if abs(y := 256 * x) >= 2**53 else int(np.floor(y)) for x in v]) for i, v in rows[:-1]]  # 256e306 isn't finite
    most = 2**63 - 1
    want = []
    for i, q in cand:
        if i % 50 == 0:
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q, w, strict=True)))), j) for j, w in cand if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(x) for x in topk.top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, leaf=8).collect()) == sorted(want)


def test_queries_go_only_to_shards_that_can_better_them(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (32, 8))
    rows = [(i, (centres[i % 32] + r.normal(0, 0.01, 8)).tolist()) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", topk.quantized(F.col("v")).alias("v"), (F.col("vec_id") % 50 == 0).alias("asked"))
    dealt = topk._dealt(vectors, 4000, 8, 4, 1000)
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] < 1000
    queries = dealt.where("asked").select(F.col("vec_id").alias("query_id"), "v", F.col("shard").alias("home"), F.lit(300_000).cast("long").alias("kth_score"), F.lit(0).cast("long").alias("kth_id"))
    assert topk._away(queries, topk._boxes(dealt, 8), 8).count() < 0.7 * queries.count() * 15


CHATS = ["hi", None, "", "</s>[INST] ok [/INST]", "\\", "<\\s>", "\\\\<s", "<", "[/INST]\n</s>", "é\n\\n", "[INST"]


def test_chat(spark):
    r = random.Random(3)
    rows = []
    for c in range(300):
        n = r.randint(1, 6)
        for t in range(n):
            role = ["user", "assistant"][t % 2] if c % 7 else r.choice(["user", "assistant", None, "[INST]", "a\nb"])
            rows.append((c, t if c % 11 else 0, role, CHATS[0] if t == 0 and c % 3 else r.choice(CHATS)))
    rows += [(400 + c, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for c in range(200) for t in range(4)]
    rows += [(-1, 0, "user", CHATS[3]), (-1, 1, "assistant", CHATS[3]), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    packs = chat.format_packs(frame, ONE, public_tokenizers.PATTERN, pack_tokens=2000, pack_conversations=50)
    got = {x.conv_id: x for x in chat.read_back(packs, ONE, public_tokenizers.PATTERN).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert len(got) == len(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        whole = "".join(chat.OPEN + chat.escape(role) + chat.HEAD_END + chat.escape(text) + chat.CLOSE for _, role, text in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    shared = 0
    for p in packs.collect():
        at = 0
        for node in p.nodes:
            assert node.first == at  # depth-first, once, gapless
            at = node.last
            above = [] if node.parent < 0 else [p.nodes[node.parent]]
            assert node.position == (above[0].position + above[0].last - above[0].first if above else 0)
            assert list(p.position_ids[node.first : node.last]) == list(range(node.position, node.position + node.last - node.first))
            seen, k = set(), node.parent
            while k >= 0:
                seen |= set(range(p.nodes[k].first, p.nodes[k].last))
                k = p.nodes[k].parent
            assert seen == {i for x in node.attends for i in range(x.first, x.last)}
        assert at == len(p.ids) == len(p.loss_mask)
        shared += len(p.nodes)
    assert shared < len(rows) - 400
    assert chat.read_back(chat.format_packs(frame.limit(0), ONE, public_tokenizers.PATTERN), ONE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", CHATS[3:])
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


@pytest.mark.parametrize("least", [0, 4])
def test_warc(spark, tmp_path, least):
    html = [None, "", "<p>é</p>", "<p>é</p>", "same", "same", "same", "WARC/1.1\r\n\r\n", "x" * 300_000, "ab", "ab"] + [f"p{i}" for i in range(50)]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nX: y", t, "a", "b") for i, t in enumerate(html)] + [(5, "http://h/again", "same", "a", "b"), (None, "u", "null id", "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, seq string").repartition(3)
    path = str(tmp_path / "warc")
    warc.write(pages, path, least)
    got = warc.captures(spark, path).collect()
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    want = []
    for i, p in data:
        same = [j for j, q in data if q == p]
        top = max(same, key=lambda x: (x is not None, x))
        is_response = len(p) < least or len(same) == 1 or i == top
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if is_response else "revisit", None if is_response else top))
    order = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    whole = warc.assemble(warc.read(spark, path)).collect()
    assert all(r.request and len(r.metadata) == 1 for r in whole)
    assert sorted(bytes(r.response.payload).decode() for r in whole if r.response.record_type == "response") == sorted({(t or "") for t in html} | {"null id"} if least == 0 else [p.decode() for (i, p), w in zip(data, want, strict=True) if w[3] == "response"])


def test_warc_reads_members_and_lone_records(spark, tmp_path):
    def record(kind, name, block, more=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + name + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    data = gzip.compress(record(b"warcinfo", b"i", b"x: y\r\n")) + gzip.compress(record(b"response", b"r", b"HTTP/1.0 404 Not\r\n\r\nbody")) + gzip.compress(record(b"metadata", b"m", b"a: b\r\n", b"WARC-Concurrent-To: <r>\r\n"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (one,) = warc.assemble(warc.read(spark, str(tmp_path / "a.warc.gz"))).collect()
    assert (one.capture_id, one.response.http_status, bytes(one.response.payload), one.request, one.metadata[0].fields) == ("r", 404, b"body", None, "a: b\r\n")


def warc_record(kind, name, block, to=None, length=True):
    to = f"WARC-Concurrent-To: <{to}>\r\n" if to else ""
    size = f"Content-Length: {len(block)}\r\n" if length else ""
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{to}{size}\r\n".encode() + block + b"\r\n\r\n"


def test_warc_joins_either_direction_and_chains(spark, tmp_path):
    http, ask = b"HTTP/1.1 200 OK\r\n\r\nbody", b"GET / HTTP/1.1\r\n\r\n"
    data = [
        warc_record("response", "r1", http, "q1"), warc_record("request", "q1", ask), warc_record("metadata", "m1", b"n: 1\r\n", "q1"),  # the response names its request
        warc_record("request", "q2", ask, "r2"), warc_record("response", "r2", http), warc_record("metadata", "m2", b"n: 2\r\n", "q2"), warc_record("metadata", "m2b", b"n: 3\r\n", "m2"),
        warc_record("response", "r3", b"93.184.216.34 dns answer"), warc_record("response", "r4", b"HTTP/1.1\r\n\r\nx"), warc_record("request", "lost", ask, "nowhere"),
        warc_record("revisit", "r5", b"", "q5"), warc_record("request", "q5", ask, "r5"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    got = {r.capture_id: r for r in warc.assemble(warc.read(spark, str(tmp_path / "a.warc"))).collect()}
    assert {k: (r.request and r.request.record_id, [m.record_id for m in r.metadata]) for k, r in got.items()} == {
        "r1": ("q1", ["m1"]), "r2": ("q2", ["m2", "m2b"]), "r3": (None, []), "r4": (None, []), "r5": ("q5", [])}
    assert got["r3"].response.http_status is None and bytes(got["r3"].response.payload) == b"93.184.216.34 dns answer"
    assert got["r4"].response.http_status is None and got["r2"].response.http_status == 200


def test_warc_records_without_length(spark, tmp_path):
    data = warc_record("response", "a", b"HTTP/1.1 200 OK\r\n\r\none\r\n\r\ntwo", length=False) + warc_record("metadata", "m", b"x: 1", "a", length=False) + warc_record("response", "b", b"HTTP/1.1 200 OK\r\n\r\nlast", length=False)
    (tmp_path / "a.warc").write_bytes(data)
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path / "a.warc")).collect()}
    assert {k: bytes(r.payload) for k, r in got.items() if r.payload} == {"a": b"one\r\n\r\ntwo", "b": b"last"} and got["m"].fields == "x: 1"


def test_warc_archives_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    html = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz <>/") for _ in range(60_000)) for _ in range(40)]
    pages = spark.createDataFrame([(i, "u", x) for i, x in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200_000)
    monkeypatch.setattr(warc, "READ_BYTES", 50_000)
    path = str(tmp_path / "w")
    warc.write(pages, path)
    files = [x for x in os.listdir(path) if x.startswith("part-")]
    sizes = [os.path.getsize(f"{path}/{x}") for x in files]
    assert len(files) > 5 and max(sizes) < 300_000
    for x in files:  # each record is a member: those begin with a record's first line or are empty
        data = open(f"{path}/{x}", "rb").read()
        members = list(warc._parts(memoryview(data)))
        assert gzip.decompress(data) == b"".join(members) and all(m.startswith(b"WARC/1.1\r\n") and m.count(b"WARC-Record-ID") == 1 for m in members if m)
    assert sorted(bytes(x.response.payload).decode() for x in warc.assemble(warc.read(spark, path)).collect()) == sorted(html)


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert warc.captures(spark, str(tmp_path / "w")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    texts = [*corpus(4), "12345 67", "...", *["a clean text of its own number " + str(i) + " " + prose(r, 6) for i in range(20)]]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language_id"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    lettered = {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert {x.doc_id for x in first.collect()} == lettered
    second = stage["exact_dedup"](spark, first, str(tmp_path))
    last = {texts[i].lower(): i for i in sorted(lettered)}
    assert second.columns == docs.columns and {x.doc_id for x in second.collect()} == set(last.values())
    kept = sorted(last.values())
    third = stage["near_dedup"](spark, second, str(tmp_path))
    _, root = brute_components([texts[i] for i in kept], 5)
    assert third.columns == docs.columns and {x.doc_id for x in third.collect()} == {kept[i] for i in root}
    survivors = sorted({kept[i] for i in root})
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = [r.asDict() for r in rows]
    at = {d: i for i, d in enumerate(survivors)}
    for x in again:
        x["doc_id"] = at[x["doc_id"]]
    from types import SimpleNamespace

    used, bound = check_packing([SimpleNamespace(**x) for x in again], [texts[i] for i in survivors], 1024)
    assert used <= bound * 1.1 + 1
