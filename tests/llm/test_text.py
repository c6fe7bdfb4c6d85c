"""Encoding, packing, token counts, sharding and exact dedup, against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cytosift.llm import bpe, chat, common, encode, exact_dedup, packing, sharding, token_counts, tokens
from tokenizers import Tokenizer

MULTI, ONE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = [chr(c) for c in [*range(0x180), 0x2028, 0x3000, 0x200B, 0x4E2D, 0x1F600, 0x301, 0x660]] + list("   \n\n\t'sdrvm aeiouABZ<|>") * 8
ADDED = tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket string, unit string"


def made(n, seed=0, longest=90):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, longest))) for _ in range(n)]


CASES = [None, "", " ", "A", "a", "the the", "<|endoftext|> x", "one<|endoftext|>two <|endoftext|>", "  <|endoftext|>\n\n<|endoftext|><|endof", "x" * 700, "ab" * 3000, "word " * 4000, "é" * 300, *made(60)]


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, "k", "b", "u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("path", [MULTI, ONE])
def test_matrices_encode_as_the_library(path):
    ours = bpe.TextEncoder(bpe.RankBPE(bpe.read_ranks(path)), public_tokenizers.PATTERN, memo=500)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [x or "" for x in CASES] + made(400, 1)
    for i in range(0, len(texts), 40):
        ids, at = ours(texts[i : i + 40])
        for k, text in enumerate(texts[i : i + 40]):
            assert ids[at[k] : at[k + 1]].tolist() == theirs.encode_ordinary(text)


def test_round_trip(spark):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    docs = table(spark, CASES)
    for r in encode.round_trip(docs, MULTI, public_tokenizers.PATTERN).collect():
        text = CASES[r.doc_id] or ""
        ids = theirs.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = encode.decode(encode.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {i: x or "" for i, x in enumerate(CASES)}
    assert encode.round_trip(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == list(range(len(texts)))
    for i, own in by.items():
        own.sort(key=lambda r: r.piece)
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and 0 < own[0].length <= capacity
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= capacity
    return len(filled), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, capacity):
    texts = CASES + made(150, 2, 400)
    rows = packing.packed_documents(table(spark, texts), ONE, public_tokenizers.PATTERN, 2, capacity, added=ADDED).collect()
    used, bound = check_packing(rows, texts, capacity)
    assert used <= bound * 1.06 + 1
    assert packing.packed_documents(table(spark, []), ONE, public_tokenizers.PATTERN, 2).count() == 0


LONG = 1_100_000
LONGEST = [" " * LONG, "\n" * LONG + "end", "a" * LONG, "go" + "\u3000 " * (LONG // 2) + "\tx", "." * LONG, "x" + " " * LONG + "<|endoftext|>" + "\n" * LONG]


def test_runs_of_any_length_have_the_librarys_ids():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours, short = tokens.Tokens(ONE, public_tokenizers.PATTERN, ADDED), tokens.Tokens(ONE, public_tokenizers.PATTERN, ADDED, long_run=3)
    for text in LONGEST:
        assert ours(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in [x or "" for x in CASES] + made(300, 5):
        assert short(text).tolist() == ours(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_very_long_runs_through_the_operators(spark):
    texts = [LONGEST[1], LONGEST[5], "short"]
    rows = packing.packed_documents(table(spark, texts), ONE, public_tokenizers.PATTERN, 2, added=ADDED).collect()
    check_packing(rows, texts, 1024)
    plain = tokens.Tokens(ONE, public_tokenizers.PATTERN)
    counts = token_counts.section_tokens(table(spark, texts[1:]), ONE, public_tokenizers.PATTERN).groupBy("doc_id").sum("n_tokens").collect()
    assert {i: n for i, n in counts} == {i: len(plain(x)) for i, x in enumerate(texts[1:])}
    said = spark.createDataFrame([(1, 0, "user", texts[1]), (1, 1, "assistant", texts[0])], "conv_id long, turn long, role string, text string")
    (back,) = chat.read_back(chat.format_packs(said, ONE, public_tokenizers.PATTERN), ONE, public_tokenizers.PATTERN).collect()
    assert back.loss_chars == len(texts[0]) and back.turns_sha256 == hashlib.sha256(f"user\n{texts[1]}\nassistant\n{texts[0]}\n".encode()).hexdigest()


def test_numbers_are_gapless_in_groups_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "NUMBERED_ROWS", 7)
    rows = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 0, id % 50) AS g")
    sizes = dict(rows.groupBy("g").count().collect())
    got = {}
    for r in common.numbered(rows, "g", sizes, "id").collect():
        got.setdefault(r.g, []).append(r.rank)
    assert {g: sorted(v) for g, v in got.items()} == {g: list(range(n)) for g, n in sizes.items()}


def test_packing_of_repeated_rows(spark):
    rows = packing.packed_documents(table(spark, ["same text"] * 50, [7] * 50), ONE, public_tokenizers.PATTERN, 2).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length(seed):
    r = np.random.default_rng(seed)
    have = np.bincount(np.minimum(1024, np.maximum(1, r.lognormal(5 + seed / 5, 1, 10 ** (2 + seed % 4)).astype(int))), minlength=1025)
    runs = packing.plan(have)
    got = np.zeros(1025, int)
    for length, first, n, _, _ in runs:
        assert first == got[length]
        got[length] += n
    assert (got[1:] == have[1:]).all()
    used = max(s + n for _, _, n, s, _ in runs)
    assert used <= 1.02 * -(-int((have * np.arange(1025)).sum()) // 1024) + 2


def test_section_tokens(spark):
    texts = CASES + ["one\ntwo\n\nthree", "\n\n", "é\nü" * 40]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ONE), special_tokens={})
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.section_tokens(table(spark, texts), ONE, public_tokenizers.PATTERN, rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, text in enumerate(texts):
            own = sorted(got[i], key=lambda r: r.section)
            text = text or ""
            assert own[0].start_char == 0 and own[-1].end_char == len(text) and all(a.end_char == b.start_char for a, b in zip(own, own[1:], strict=False))
            want = [0] * len(own)
            at = 0
            data = text.encode()
            place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
            for token in library.encode_ordinary(text):
                n = len(library.decode_single_token_bytes(token))
                hold = [next(s for s, r in enumerate(own) if c < r.end_char) for c in sorted(set(place[at : at + n].tolist()))]
                to = {"first": hold[0], "last": hold[-1], "most": max(sorted(set(hold)), key=hold.count)}[rule]
                want[to] += 1
                at += n
            assert [r.n_tokens for r in own] == want


def test_shards(spark):
    texts = CASES + made(300, 3)
    rows = sharding.shard_by_slots(table(spark, texts), 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    load = [0] * 8
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
        load[r.shard] += r["size"]
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    rest = sorted(load)[:-2]  # two texts are longer than a fair share
    assert max(rest) - min(rest) <= 16
    assert sharding.shard_by_slots(table(spark, []), 8).count() == 0


def test_slot_map_versions(spark, tmp_path):
    size = np.random.default_rng(0).integers(0, 1000, 4096)
    first = sharding.SlotMap.initial(4096, 10)
    even = first.rebalanced(size)
    grown = even.grown(size)
    path = str(tmp_path / "map")
    for m in (first, even, grown):
        m.store(spark, path)
    assert [sharding.SlotMap.load(spark, path, v) for v in (0, 1, 2)] == [first, even, grown]
    assert sharding.SlotMap.load(spark, path) == grown
    load = np.bincount(np.array(even.shard), size)
    assert load.max() - load.min() <= 2
    assert sum(a != b for a, b in zip(first.shard, even.shard, strict=True)) < 600  # edited, not made anew
    moved = [b for a, b in zip(even.shard, grown.shard, strict=True) if a != b]
    assert set(moved) == {10}
    load = np.bincount(np.array(grown.shard), size)
    assert load.max() < 1.1 * load.mean() and load.min() > 0.9 * load.mean()


def test_a_stored_map_is_read_edited_and_kept(spark, tmp_path):
    path, texts = str(tmp_path / "map"), made(400, 6)
    run = lambda texts, shards, **more: {r.doc_id: r for r in sharding.shard_by_slots(table(spark, texts, **more), shards, slots=256, store=path).collect()}
    first = run(texts, 24)
    assert sharding.SlotMap.versions(spark, path) == [0, 1]
    again = run(texts, 24)
    assert sharding.SlotMap.versions(spark, path) == [0, 1]  # nothing to edit
    assert {i: (r.shard, r.map_version) for i, r in again.items()} == {i: (r.shard, 1) for i, r in first.items()}
    grown = run(texts, 25)
    moved = {i for i in grown if grown[i].shard != first[i].shard}
    steps = sharding.SlotMap.versions(spark, path)
    assert steps[:3] == [0, 1, 2] and moved and {r.shard for r in grown.values()} <= set(range(25))
    before, after = sharding.SlotMap.load(spark, path, 1), sharding.SlotMap.load(spark, path, 2)
    assert {b for a, b in zip(before.shard, after.shard, strict=True) if a != b} == {24}  # the new shard alone takes slots
    with pytest.raises(ValueError):
        run(texts, 24)  # shards are never taken away
    with pytest.raises(Exception, match="(?i)exist"):
        after.store(spark, path)
    for k in range(25):
        assert sorted(r.slot for r in grown.values() if r.shard == k) == list(range(sum(r.shard == k for r in grown.values())))


def test_shards_of_null_keys_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "NUMBERED_ROWS", 50)
    texts, ids = ["copy"] * 300 + [None] * 100 + made(100, 8), [7] * 300 + [None] * 100 + list(range(100, 200))
    rows = sharding.shard_by_slots(table(spark, texts, ids), 8).collect()
    assert len(rows) == 500 and len({(r.shard, r.slot) for r in rows}) == 500
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert len({r.virtual_slot for r in rows if r.doc_id == 7}) == 1


def brute_groups(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by = {}
    for i, (key, text) in enumerate(rows):
        by.setdefault((text or "").translate(low), []).append((key is not None, key, i))
    return by


def test_exact_groups(spark):
    texts = ["Copy"] * 300 + ["cOPY"] * 100 + ["É", "é", None, "", *made(200, 4, 3)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for text, own in brute_groups(list(enumerate(texts))).items():
        keys = [k for _, k, _ in own]
        for k in keys:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(keys), len(keys), k == max(keys), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_exact_dedup_of_repeated_and_null_keys(spark):
    texts, ids = ["a", "A", "a", "b", "b", None, "", "c"], [1, 1, 1, None, None, 5, 6, None]
    kept = exact_dedup.exact_dedup(table(spark, texts, ids))
    assert kept.columns == table(spark, []).columns
    assert sorted((r.text or "").lower() for r in kept.collect()) == ["", "a", "b", "c"]
    assert sum(r.kept for r in exact_dedup.exact_groups(table(spark, texts, ids)).collect()) == 4


def test_misra_gries_keeps_what_is_frequent():
    from collections import Counter

    r = random.Random(0)
    items = [f"hot{i % 3}" if i % 2 else f"x{r.random()}" for i in range(20_000)]
    summary = exact_dedup.MisraGries(8)
    for i in range(0, len(items), 100):
        summary.add(Counter(items[i : i + 100]))
    assert {"hot0", "hot1", "hot2"} <= set(summary.counts) and len(summary.counts) <= 8
