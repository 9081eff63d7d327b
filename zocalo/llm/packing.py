"""Packing into sequences by an order-preserving dynamic programme with a monotone queue."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from zocalo.llm.frames import exact
from zocalo.llm.pieces import byte_bpe

WINDOW = 2048
END_ID = 1
#: Cost of a cut, in padded tokens: between documents, after a sentence, elsewhere.
DOCUMENT_CUT, SENTENCE_CUT, OTHER_CUT = 0, 3, 40
#: Tokens that are solved together; all windows but the last are then final and the last is carried on.
BLOCK_TOKENS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def best_cuts(position: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the cuts, 0 and the last included, that minimise padding plus penalties over windows of at most ``window``.

    ``position`` holds the possible cuts in ascending order, from 0 to the end, no two more than ``window`` apart. A
    window pads to ``window`` unless its length is a power of two. With f the least cost up to a cut,
    f(j) = penalty(j) + window - position(j) + min of f(i) + position(i) over the cuts i within reach, so the minimum
    comes from a queue kept in ascending order; exact powers of two from 256 up are tried besides. Equal costs keep the
    earlier window start.
    """
    n, at, pay = len(position), position.tolist(), penalty.tolist()
    exacts = []
    size = window // 2
    while size >= 256:
        found = np.searchsorted(position, position - size)
        exacts.append(np.where(position[np.minimum(found, n - 1)] == position - size, found, -1).tolist())
        size //= 2
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, n):
        p = at[j]
        low = p - window
        while at[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best = value + window - p
        for e in exacts:
            k = e[j]
            if k >= 0 and cost[k] < best:
                best, i = cost[k], k
        best += pay[j]
        cost[j], back[j] = best, i
        value = best + p
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def powers(length: int) -> list[int]:
    """``length`` as descending powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Packs one task's stream of documents in their order; holds about ``block`` tokens and the longest document."""

    def __init__(self, sentence_end: np.ndarray, opens: np.ndarray, prefix: int, window: int = WINDOW, block: int = BLOCK_TOKENS):
        self.sentence_end, self.opens, self.window, self.block = sentence_end, opens, window, block
        self.next_id = prefix << 33
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, tokens, first token here
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((doc_id, len(ids), 0))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            yield self.solve(False)

    def finish(self) -> Iterator[list[tuple]]:
        if self.held:
            yield self.solve(True)

    def _candidates(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.flatnonzero(self.sentence_end[ids[:-1]] & self.opens[ids[1:]]) + 1
        position = np.union1d(np.union1d(after, ends), [0])
        gaps = np.diff(position)
        if (wide := np.flatnonzero(gaps > self.window // 2)).size:  # sentences too long to keep whole can be cut at every 64 tokens
            position = np.union1d(position, np.concatenate([np.arange(position[i], position[i + 1], 64) for i in wide]))
        penalty = np.full(len(position), OTHER_CUT)
        penalty[np.isin(position, after)] = SENTENCE_CUT
        penalty[np.isin(position, ends)] = DOCUMENT_CUT
        return position, penalty

    def solve(self, last: bool) -> list[tuple]:
        ids = np.concatenate(self.parts)
        ends = np.cumsum([n - first for _, n, first in self.docs])
        position, penalty = self._candidates(ids, ends)
        cuts = position[best_cuts(position, penalty, self.window)].tolist()
        if not last and len(cuts) > 2:
            cuts.pop()
        elif last and (tail := cuts[-1] - cuts[-2]) & (tail - 1):
            pieces = powers(tail)
            if (len(pieces) - 1) * OTHER_CUT < self.window - tail:  # cheaper than padding the end of the stream
                cuts[-1:] = (cuts[-2] + np.cumsum(pieces)).tolist()
        done = cuts[-1]
        rows, raw = [], memoryview(ids.astype("<u4", copy=False)).cast("B")
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        edges = sorted({*cuts, *(e for e in ends.tolist() if e < done), done})
        window, doc = 0, 0
        for a, b in zip(edges, edges[1:]):
            while cuts[window + 1] <= a:
                window += 1
            while starts[doc] + self.docs[doc][1] - self.docs[doc][2] <= a:
                doc += 1
            doc_id, total, first = self.docs[doc]
            rows.append((doc_id, first + a - starts[doc], b - a, zlib.crc32(raw[4 * a:4 * b]), total, self.next_id + window, a - cuts[window]))
        self.next_id += len(cuts) - 1
        kept = [(d, n, max(first, first + done - s)) for (d, n, first), s, e in zip(self.docs, starts, ends.tolist()) if e > done]
        self.docs, self.parts, self.held = kept, [ids[done:].copy()], len(ids) - done
        return rows


def token_marks(tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether a sentence may end behind the token, and whether the token may open the next sentence."""
    size = max(tokenizer.get_vocab_size(), END_ID + 1)
    ends, opens = np.zeros(size, bool), np.zeros(size, bool)
    for token, i in tokenizer.get_vocab().items():
        bare = token.rstrip("\"')]»”")
        ends[i] = bare[-1:] in (".", "!", "?", "Ċ") or token.endswith("Ċ")
        opens[i] = token[:1] in ("Ġ", "Ċ")
    opens[END_ID] = True
    return ends, opens


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task tokenizes its own rows and packs them in their order, so nothing is shuffled; it holds about a million
    tokens and the longest document. Sequence ids are the task's number and a count, so a task that runs again after a
    lost executor gives the same rows. Null and empty texts are the end id alone, repeated rows are packed each, an
    empty table gives no pieces, other columns are ignored. A sentence longer than half a window may be cut at every 64
    tokens; only the end of a task's stream may be cut into powers of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer_path)
        packer = Packer(*token_marks(encoder.tokenizer), TaskContext.get().partitionId(), window)
        end = np.asarray([END_ID], "<u4")

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=ARROW)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([np.frombuffer(encoder.ids(text.as_py() or ""), "<u4"), end])
                for rows in packer.add(doc_id, ids):
                    yield batch(rows)
        for rows in packer.finish():
            yield batch(rows)

    return exact(docs, doc_id="doc_id", text="text").mapInArrow(run, SCHEMA)
