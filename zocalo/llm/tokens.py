"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both sides provably agree."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zocalo.llm.frames import exact
from zocalo.llm.pieces import RunTokenCounts

#: Texts above this many characters are encoded in chunks of this size.
CHUNK = 1 << 15
#: First overlap of neighbouring chunks; doubled as long as they have no stable boundary in common.
OVERLAP = 1 << 8
#: Behind one of these every token starts afresh: no token, special string or composed character spans them.
BREAKS = " \t\n\r"
#: Farther than this no special string reaches, and each holds this mark.
SPECIAL_SPAN, SPECIAL_MARK = 16, "|"
LIMIT = 2048

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def encoded(tokenizer, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of text[a:b] and where each token starts in ``text``."""
    found = tokenizer.encode(text[a:b], add_special_tokens=False)
    return np.asarray(found.ids, np.int64), np.asarray([s for s, _ in found.offsets], np.int64) + a


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """L, N or O for a letter, a number or a mark of punctuation that stands for itself in every form; empty for all others.

    Left out are white space, combining marks, parts of Hangul syllables, characters that change length or kind in lower case or in
    composed form, and those that an older character database does not know or classes otherwise.
    """
    group = unicodedata.category(c)[0]
    plain = (unicodedata.ucd_3_2_0.category(c)[0] == group and len(c.lower()) == 1 and unicodedata.category(c.lower())[0] == group
             and unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and not "\u1100" <= c <= "\u11ff" and not c.isspace())
    return {"L": "L", "N": "N", "P": "O", "S": "O"}.get(group, "") if plain else ""


def proven(text: str, p: int) -> bool:
    """Whether the pre-tokenizer cuts before ``text[p]`` whatever stands farther off.

    It does behind white space; on both sides of a number, which is always alone; and between a letter and a mark of punctuation,
    but for the apostrophe that may begin a short form. Near what may be a special string it is not sure.
    """
    if text[p - 1] in BREAKS:
        return True
    a, b = kind(text[p - 1]), kind(text[p])
    if not a or not b or a == b != "N" or a == "O" and text[p - 1] == "'":
        return False
    return SPECIAL_MARK not in text[max(0, p - SPECIAL_SPAN):p + SPECIAL_SPAN]


def splice(text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], low: int, high: int) -> int | None:
    """The last position in (low, high) at which the two encodings may be joined, or None.

    It must start a token in both, be a proven cut (so that what is before cannot change what follows, nor the
    other way round), and from the first such position on, both must give the same tokens up to it.
    """
    common = np.intersect1d(left[1][(left[1] > low) & (left[1] < high)], right[1][(right[1] > low) & (right[1] < high)])
    stable = [p for p in common.tolist() if proven(text, p)]
    if not stable:
        return None
    first, last = stable[0], stable[-1]
    of = lambda e: e[0][(e[1] >= first) & (e[1] < last)]
    return last if np.array_equal(of(left), of(right)) else first


def chunked_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks; holds two chunks at a time unless text without a proven cut joins them.

    Such a stretch is encoded again from its start, each time twice as far, so that all of it costs about twice its length.
    """
    total, start, end = 0, 0, min(chunk, len(text))
    left = encoded(tokenizer, text, start, end)
    while end < len(text):
        cut = next((p for p in range(end - 1, start, -1) if proven(text, p)), start)  # the overlap has to reach over one
        wide = max(overlap, end - cut + overlap)
        while True:
            begin = max(end - wide, start) if cut > start else start
            if begin == start:  # nowhere to splice: the stretch goes on
                until = min(start + max(chunk + end - start, 2 * (end - start)), len(text))
                left = encoded(tokenizer, text, start, until)
                break
            until = min(begin + chunk, len(text)) if begin + chunk > end else min(end + chunk, len(text))
            right = encoded(tokenizer, text, begin, until)
            at = splice(text, left, right, begin, end)
            if at is not None:
                total += int((left[1] < at).sum())
                keep = right[1] >= at
                left, start = (right[0][keep], right[1][keep]), at
                break
            wide *= 2
        end = until
    return total + len(left[0])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens of the whole text, over_limit.

    Texts up to ``chunk`` characters are one chunk, counted run by run with a bounded memory of runs (a run ends at a
    break, which is stable by the same argument); longer ones are encoded in overlapping chunks, also those without any white space. Null counts as empty,
    with 0 tokens; repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = RunTokenCounts(tokenizer_path)
        for b in batches:
            n_bytes, n_tokens = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(runs.count(text) if len(text) <= chunk else chunked_count(runs.tokenizer, text, chunk, overlap))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                                              pa.array([n > limit for n in n_tokens], pa.bool_())], schema=ARROW)

    return exact(docs, doc_id="doc_id", text="text").mapInArrow(run, SCHEMA)
