"""Byte-level BPE over numpy matrices.

Distinct pre-token pieces are bucketed by length into padded matrices of token ids. In each round every row merges its
leftmost pair of minimum rank; pair ranks come from an open-addressing hash table, rows without a mergeable pair leave
the matrix (compaction), and columns close up to the left. Only the two ranks beside a merge are looked up again.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
#: Piece bytes from which one piece is merged with a heap (same order of merges) in place of a matrix row of its own width.
LONG_PIECE = 200
#: Distinct pieces that a worker remembers before it starts anew.
MEMO = 250_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined token, in an open-addressing table of numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        self.probes = 1
        left_keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        left_ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        step = 0
        while len(left_keys):
            slot = (self._slot(left_keys) + step) & (size - 1)
            free = self.keys[slot] < 0
            slot_free, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slot_free], self.ranks[slot_free] = left_keys[took], left_ranks[took]
            rest = np.ones(len(left_keys), bool)
            rest[took] = False
            left_keys, left_ranks = left_keys[rest], left_ranks[rest]
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none; any shape; ids below 0 are padding."""
        key = (left.astype(np.int64) << 20) | right.astype(np.int64)
        shape, key = key.shape, key.ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        step = 1
        while len(open_) and step < self.probes:
            slot_ = (slot[open_] + step) & ((1 << self.bits) - 1)
            found = self.keys[slot_]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot_[hit]]
            open_ = open_[~hit & (found >= 0)]
            step += 1
        return out.reshape(shape)


class RankBPE:
    """Encodes pieces of bytes by ranks; token ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        n = max(ranks.values()) + 1
        tokens = [b""] * n
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes, self.token_at = packed(tokens)
        self.digits, self.digits_at = packed([b"%d," % i for i in range(n)])

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, offsets: one more than pieces)."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, starts = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(lens)))
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (piece numbers, matrix padded with -1)
        for width in np.unique(lens[(lens > 0) & (lens < LONG_PIECE)]):
            rows = np.flatnonzero(lens == width)
            per = max(1, 2_000_000 // int(width))
            for i in range(0, len(rows), per):
                own = rows[i : i + per]
                ids = self.byte_ids[data[starts[own][:, None] + np.arange(width)]]
                parts += [(own[r], m) for r, m in self._merge(ids)]
        for i in np.flatnonzero(lens >= LONG_PIECE):
            parts.append((np.array([i]), self._merge_long(data[starts[i] : starts[i + 1]])[None, :]))
        for own, m in parts:
            counts[own] = (m >= 0).sum(1)
        at = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(at[-1], np.int32)
        for own, m in parts:
            mask = m >= 0
            out[(at[own][:, None] + np.arange(m.shape[1]))[mask]] = m[mask]
        return out, at

    def _merge(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, ids padded with -1 on the right) of the finished rows."""
        done, rows = [], np.arange(len(ids))
        if ids.shape[1] == 1:
            return [(rows, ids)]
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            j = rank.argmin(1)
            best = rank[np.arange(len(rows)), j]
            over = best == NONE
            if over.any():
                done.append((rows[over], ids[over]))
                keep = ~over
                rows, ids, rank, j, best = rows[keep], ids[keep], rank[keep], j[keep], best[keep]
                if not len(rows):
                    break
            every, width = np.arange(len(rows)), ids.shape[1]
            if width == 2:
                done.append((rows, best[:, None]))
                break
            after = np.arange(width - 1) > j[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[every, j] = best
            rank = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < width - 2)
            if len(left):
                rank[left, j[left] - 1] = self._ranks(ids[left, j[left] - 1], best[left])
            if len(right):
                rank[right, j[right]] = self._ranks(best[right], ids[right, j[right] + 1])
        return done

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(right < 0, NONE, self.pairs(left, np.maximum(right, 0)))

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        ids = self.byte_ids[piece].tolist()
        n = len(ids)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pairs(np.array(ids[:-1]), np.array(ids[1:])).tolist() + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        tokens = self._tokens()
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            gone = follow[i]
            ids[i], ids[gone], follow[i] = r, -1, follow[gone]
            if follow[i] < n:
                before[follow[i]] = i
            for a in (before[i], i):
                if a >= 0:
                    b = follow[a]
                    rank[a] = self.ranks.get(tokens[ids[a]] + tokens[ids[b]], int(NONE)) if b < n else int(NONE)
                    if rank[a] != NONE:
                        heapq.heappush(heap, (rank[a], a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _tokens(self) -> list[bytes]:
        if not hasattr(self, "_token_list"):
            data, at = self.token_bytes.tobytes(), self.token_at
            self._token_list = [data[at[i] : at[i + 1]] for i in range(len(at) - 1)]
        return self._token_list


def packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)


def gather(data: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[at[i]:at[i + 1]] of every i in index, one after another, and their offsets."""
    lens = at[index + 1] - at[index]
    to = np.concatenate(([0], np.cumsum(lens)))
    return data[np.repeat(at[index] - to[:-1], lens) + np.arange(to[-1])], to


class TextEncoder:
    """Splits texts into pieces, encodes each distinct piece once while remembered, and joins the ids."""

    def __init__(self, bpe: RankBPE, pattern: str, memo: int = MEMO):
        self.bpe, self.find, self.limit = bpe, regex.compile(pattern).findall, memo
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets: one more than texts)."""
        pieces: list[str] = []
        bounds = [0]
        for text in texts:
            pieces += self.find(text)
            bounds.append(len(pieces))
        new = set(pieces).difference(self.memo)
        if len(new) + len(self.memo) > self.limit and self.memo:
            self._reset()
            new = set(pieces)
        if new:
            ids, at = self.bpe.encode([x.encode() for x in new])
            n = len(self.memo)
            self.memo.update(zip(new, range(n, n + len(new)), strict=True))
            self.ids, self.at = np.concatenate((self.ids, ids)), np.concatenate((self.at, self.at[-1] + at[1:]))
        index = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        ids, to = gather(self.ids, self.at, index)
        return ids, to[bounds]


@lru_cache(4)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker and vocabulary."""
    return TextEncoder(RankBPE(read_ranks(path)), pattern)
