"""Exact token ids of whole texts from ids of their white-space runs, for public tokenizers whose tokens never cross a run."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Blank and control characters that some libraries take for white space and others do not; texts with one take the careful path.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
DOUBLE_SPACE = re.compile(r"  | \n|\n |\n\n|^[ \n]|[ \n]$")
#: A word of plain Latin letters and the ASCII marks after it, which every pre-tokenizer here cuts apart.
STEM = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?@\\[-`{}~]+)$")


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """A bounded memory of ``make(key)``: when full, the older half of the keys goes unless it is used again."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Letters and digits that every library classes alike, whatever its Unicode version.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: How byte-level tokenizers cut a text before merging: a fixed value of the pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_twin(tokenizer):
    """The same vocabulary and merges for the faster merging library, or None where merges do not stand in the order of ids.

    It merges by id, so it gives the same ids exactly if the i-th merge makes the i-th id after the 256 bytes.
    """
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"].get(token) != 256 + i for i, token in enumerate(made)):
        return None
    value = byte_values()
    special = set(tokenizer.get_added_tokens_decoder())
    ranks = {bytes(value[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
    return tiktoken.Encoding("twin", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteBpeIds:
    """Ids of a byte-level BPE tokenizer whose pre-tokenizer puts one blank before a word and cuts at white space.

    After a non-space character, one blank or line feed and the non-space characters behind it are cut off from the
    rest whatever stands around them, so the ids of a text are those of its runs in turn. Runs repeat, so their ids are
    remembered. Texts with several or unusual spaces in a row are encoded whole. Texts up to Latin letters and without a
    special string go to a twin of the tokenizer that gives the same ids in a third of the time, where there is one.
    """

    def __init__(self, path: str, limit: int = 600_000):
        self.tokenizer = load(path)
        self.memo = Memo(self._make, limit)
        self.twin = merge_twin(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _make(self, key: str) -> bytes:
        # A key is a run without its blank; a run after a line feed has that in front; "\0" marks one with nothing before it.
        if key[0] == "\0":
            return self._encode(key[1:])
        if key[0] == "\n":
            return self._encode("\n") + self.memo["\0" + key[1:]]
        if cut := STEM.match(key):
            return self.memo[cut[1]] + self.memo["\0" + cut[2]]
        return self._encode(" " + key)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if not text:
            return b""
        if self.twin and not BEYOND_LATIN.search(text) and not any(s in text for s in self.special):
            return np.asarray(self.twin.encode_ordinary(text), "<u4").tobytes()
        if ODD_SPACE.search(text) or DOUBLE_SPACE.search(text) or "\0" in text:
            return self._encode(text)
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return b"".join(map(self.memo.__getitem__, keys))


class RunTokenCounts:
    """Token counts by runs between blanks, tabs and line ends, for a tokenizer that drops white space and folds case."""

    SPLIT_ELSEWHERE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    BREAKS = re.compile("[ \t\n\r]+")

    def __init__(self, path: str, limit: int = 600_000):
        self.tokenizer = load(path)
        self.memo = Memo(self._make, limit)

    def _make(self, key: str) -> int:
        if cut := STEM.match(key):
            return self.memo[cut[1].lower()] + self.memo[cut[2]]
        return len(self.tokenizer.encode(key, add_special_tokens=False).ids) if key else 0

    def count(self, text: str) -> int:
        # str.split() also cuts at characters that the tokenizer may take for marks or spaces within a run
        runs = self.BREAKS.split(text) if self.SPLIT_ELSEWHERE.search(text) else text.split()
        return sum(map(self.memo.__getitem__, runs))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpeIds:
    """One for all tasks of a worker, so that what it remembers is of use to the next task."""
    return ByteBpeIds(path)


@lru_cache(maxsize=2)
def run_counts(path: str) -> RunTokenCounts:
    return RunTokenCounts(path)
