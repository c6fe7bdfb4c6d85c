"""Token ids of whole texts by a rank file, through the tiktoken library.

The library's pattern engine gives up on a run of about a million white-space characters. Such runs are cut out first and
merged as the one piece that the pattern makes of them: the whole run at the end of a text, else all but its last character,
which goes with what follows. Added tokens (a string and its id) are found before the pattern is applied, as the tokenizers
library does with tokens that are neither normalised nor stripped around; without any, their strings are ordinary text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken

from .bpe import read_ranks

#: White-space characters in a row from which a run is merged apart.
LONG_RUN = 200_000


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    if odd := [x["content"] for x in found if x.get("normalized") or x.get("lstrip") or x.get("rstrip") or x.get("single_word")]:
        raise ValueError(f"added tokens that change what is around them: {odd}")
    return tuple((x["content"], x["id"]) for x in found)


class Tokens:
    """Callable: text -> ids, an array of unsigned 32-bit numbers."""

    def __init__(self, path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), long_run: int = LONG_RUN):
        self.ranks = read_ranks(path)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=dict(added))
        self.marks, self.long_run = tuple(mark for mark, _ in added), long_run
        self.runs = regex.compile(rf"\s{{{long_run},}}").finditer

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < self.long_run:
            return self._plain(text)
        parts, at = [], 0
        for run in self.runs(text):
            whole = run.end() == len(text) or text.startswith(self.marks, run.end())
            stop = run.end() if whole else run.end() - 1
            parts += [self._plain(text[at : run.start()]), np.array(self.library._encode_single_piece(text[run.start() : stop]), np.uint32)]
            at = stop
        parts.append(self._plain(text[at:]))
        return np.concatenate(parts)

    def _plain(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def sizes(self) -> np.ndarray:
        """Bytes of every token."""
        size = np.zeros(self.library.n_vocab, np.int64)
        for token, rank in self.ranks.items():
            size[rank] = len(token)
        for mark in self.marks:
            size[self.library.encode_single_token(mark)] = len(mark.encode())
        return size


@lru_cache(4)
def tokens(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Tokens:
    """One of each for a Python worker."""
    return Tokens(path, pattern, added)
