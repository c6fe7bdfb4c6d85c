"""Chat formatting over a prefix tree.

A turn's node is named by the digest of all turns up to it, so conversations that share initial turns share nodes. The
conversations are sorted by their paths of node names, which is depth-first order, and dealt out by range, so that a first turn
shared by very many conversations lies in many tasks. Each task streams its range into packs: within a pack every node's
tokens are emitted once, with position ids that continue its parent's, and each node lists the token intervals of its
ancestors, which are what it may attend to besides itself. A pack begins its path anew at the root.

The template of a turn is ``<s>[INST] role [/INST]`` newline ``text</s>``. In roles and texts a backslash is doubled, and a
backslash is put after the first character of each control string, so that none is left; `unescape` takes both back.
The loss mask holds the texts of the assistant's turns. Header, text and end are encoded apart, so no token crosses the mask's edge.

Cases: null roles and texts count as empty; turns with one number are ordered by role, then text; repeated rows are turns
each; null conversation ids make one conversation; an empty table gives an empty one; extra columns are not read. A conversation is
one unit of output and is held as a whole; a group of conversations never is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, materialize
from .tokens import tokens

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, HEAD_END, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>"
PACK_TOKENS = 1 << 18
PACK_CONVERSATIONS = 1024
LOSS_ROLE = "assistant"
_control = re.compile("|".join(map(re.escape, CONTROLS)))
_escaped = re.compile(r"\\(\\?)")

_NODE = "struct<parent:int,first:int,last:int,loss_first:int,loss_last:int,position:int,attends:array<struct<first:int,last:int>>>"
PACK = f"pack binary, ids array<int>, position_ids array<int>, loss_mask array<byte>, nodes array<{_NODE}>, conversations array<struct<conv_id:long,leaf:int>>"


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        if not turn.startswith(OPEN):
            raise ValueError("a turn doesn't begin with its mark")
        role, _, text = turn[len(OPEN) :].partition(HEAD_END)
        out.append((unescape(role), unescape(text)))
    return out


def conversations_of(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, path binary, turns array<struct<role, text>>)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for turns in batch.column("turns").to_pylist():
                name, path = b"", []
                for t in turns:
                    name = hashlib.blake2b(name + f"{len(t['role'])} {t['role']}{t['text']}".encode(), digest_size=16).digest()
                    path.append(name)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), batch.column("turns")], ["conv_id", "path", "turns"])

    return by_batches(whole).mapInArrow(run, "conv_id long, path binary, turns array<struct<turn:long,role:string,text:string>>")


class Pack:
    """Tokens and nodes of one pack; conversations are added in depth-first order."""

    def __init__(self, encode, name: bytes):
        self.encode, self.name = encode, name
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.mask: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.stack: list[tuple[bytes, int]] = []  # (node name, node) of the last conversation's path
        self.conversations: list[dict] = []

    def add(self, conv_id: int | None, path: bytes, turns: list[dict]) -> None:
        names = [path[i : i + 16] for i in range(0, len(path), 16)]
        same = 0
        while same < min(len(names), len(self.stack)) and self.stack[same][0] == names[same]:
            same += 1
        del self.stack[same:]
        for name, turn in zip(names[same:], turns[same:], strict=True):
            parent = self.stack[-1][1] if self.stack else -1
            head, text, end = (self.encode(x) for x in (OPEN + escape(turn["role"]) + HEAD_END, escape(turn["text"]), CLOSE))
            first = self.size
            last = first + len(head) + len(text) + len(end)
            above = self.nodes[parent] if parent >= 0 else None
            position = above["position"] + above["last"] - above["first"] if above else 0
            loss = turn["role"] == LOSS_ROLE
            # the ancestors' intervals, joined where they touch
            attends = [dict(x) for x in above["attends"]] if above else []
            if above and attends and attends[-1]["last"] == above["first"]:
                attends[-1]["last"] = above["last"]
            elif above:
                attends.append({"first": above["first"], "last": above["last"]})
            at = first + len(head)
            self.nodes.append({"parent": parent, "first": first, "last": last, "loss_first": at, "loss_last": at + len(text) if loss else at, "position": position, "attends": attends})
            self.stack.append((name, len(self.nodes) - 1))
            self.ids += [head, text, end]
            self.mask += [np.zeros(len(head), np.int8), np.full(len(text), loss, np.int8), np.zeros(len(end), np.int8)]
            self.positions.append(np.arange(position, position + last - first))
            self.size = last
        self.conversations.append({"conv_id": conv_id, "leaf": self.stack[-1][1] if self.stack else -1})

    def batch(self) -> pa.RecordBatch:
        schema = pa.schema({
            "pack": pa.binary(), "ids": pa.list_(pa.int32()), "position_ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.int8()),
            "nodes": pa.list_(pa.struct({**dict.fromkeys(("parent", "first", "last", "loss_first", "loss_last", "position"), pa.int32()), "attends": pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32()}))})),
            "conversations": pa.list_(pa.struct({"conv_id": pa.int64(), "leaf": pa.int32()})),
        })
        joined = [np.concatenate(x).astype(kind) for x, kind in ((self.ids, np.int32), (self.positions, np.int32), (self.mask, np.int8))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([self.name, *joined, self.nodes, self.conversations], schema, strict=True)], schema=schema)


def format_packs(rows: DataFrame, vocabulary: str, pattern: str, pack_tokens: int = PACK_TOKENS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """One row per pack: ids, position_ids, loss_mask, nodes (with the intervals they attend to), conversations (id and leaf node)."""
    convs = materialize(conversations_of(rows), "conversations")  # sorting by range reads them twice
    # a path's first nodes place it; equal ones are told apart by the id, so copies of a conversation are spread too
    ordered = convs.withColumn("near", F.substring("path", 1, 64)).repartitionByRange("near", "conv_id").sortWithinPartitions("path", "conv_id").drop("near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = tokens(vocabulary, pattern), None
        for batch in batches:
            for i in range(batch.num_rows):
                conv_id, path, turns = (batch.column(c)[i].as_py() for c in ("conv_id", "path", "turns"))
                if pack is None or pack.size >= pack_tokens or len(pack.conversations) >= pack_conversations:
                    if pack is not None:
                        yield pack.batch()
                    pack = Pack(encode, hashlib.sha1(path + str(conv_id).encode()).digest())
                pack.add(conv_id, path, turns)
        if pack is not None:
            yield pack.batch()

    return ordered.mapInArrow(run, PACK)


def read_back(packs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Digests of every conversation as its pack has it: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokens(vocabulary, pattern).library.decode_bytes
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mask = (np.array(batch.column(c)[i].values) for c in ("ids", "loss_mask"))
                nodes = batch.column("nodes")[i].as_py()
                text: dict[int, tuple[str, str]] = {}
                out = []
                for conv in batch.column("conversations")[i].as_py():
                    chain, at = [], conv["leaf"]
                    while at >= 0:
                        chain.append(at)
                        at = nodes[at]["parent"]
                    for at in chain:
                        if at not in text:
                            own = ids[nodes[at]["first"] : nodes[at]["last"]]
                            under = own[mask[nodes[at]["first"] : nodes[at]["last"]] == 1]
                            text[at] = decode(own.tolist()).decode(), unescape(decode(under.tolist()).decode())
                    formatted = "".join(text[at][0] for at in reversed(chain))
                    loss = "".join(text[at][1] for at in reversed(chain))
                    turns = parse(formatted)
                    said = "".join(f"{role}\n{x}\n" for role, x in turns)
                    out.append((conv["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names)

    return by_batches(packs).mapInArrow(run, ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))
