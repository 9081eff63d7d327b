"""Near-duplicates by SimHash fingerprints, found through Golay-code keys of fingerprint segments."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.llm.components import components
from zocalo.llm.frames import exact, numbered_columns, stored
from zocalo.llm.golay import listed_indices, nearest_index

#: Fingerprints that differ in at most this many bits are linked.
MAX_BITS = 3
#: The 64 bits in three segments that each fit a codeword: first bit and length.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 3
SEED = 42
#: Shingles hashed at once within a text.
SLICE = 1 << 16

_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words between blanks and the five control characters for white space.

    For bytes, ``lower`` and ``split`` know ASCII only, which is just that.
    """
    return text.encode("utf-8", "replace").lower().split()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the ``shingle``-word shingles, repeats included; 0 for a text without a word."""
    w = words(text)
    if not w:
        return 0
    sums, total = np.zeros(64, np.int64), max(len(w) - shingle + 1, 1)
    for a in range(0, total, SLICE):
        part = w[a:a + SLICE + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
        h = np.fromiter(map(_hash, shingles), "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "") for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return exact(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, fp long")


def segment_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which each fingerprint is filed and those under which it looks, one row each (-1: none).

    With at most three differing bits over three segments, either one segment is equal and another differs in at most
    one bit, or each differs in exactly one. A segment within one bit lists the codeword nearest to the other. So a
    fingerprint is filed under (segment i itself, nearest codeword of segment j) for the six ordered pairs and under
    the nearest codewords of segments 0 and 1; it looks under the same with the listed codewords instead.
    """
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near, lists = [nearest_index(p) for p in parts], [listed_indices(p) for p in parts]
    filed, looked = [], []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                head = (np.int64(kind) << np.int64(40)) | (parts[i] << 12)
                filed.append(head | near[j])
                looked.append(np.where(lists[j] < 0, -1, head[:, None] | lists[j]))
                kind += 1
    head = np.int64(kind) << np.int64(40)
    filed.append(head | (near[0] << 12) | near[1])
    pairs = head | (lists[0][:, :, None] << 12) | lists[1][:, None, :]
    looked.append(np.where((lists[0][:, :, None] < 0) | (lists[1][:, None, :] < 0), -1, pairs).reshape(len(fp), -1))
    return np.stack(filed, 1), np.concatenate(looked, 1)


def keyed(prints: DataFrame) -> DataFrame:
    """(key, fp, filed) rows of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0))
            for a in range(0, len(fp), 4096):
                own = fp[a:a + 4096]
                filed, looked = segment_keys(own)
                looked = np.where((looked[:, :, None] == filed[:, None, :]).any(2), -1, looked)  # filed there anyway
                use = looked >= 0
                key = np.concatenate([filed.ravel(), looked[use]])
                who = np.concatenate([np.repeat(own, filed.shape[1]), np.repeat(own, use.sum(1))])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(np.arange(len(key)) < filed.size)],
                                                 names=["key", "fp", "filed"])

    return prints.mapInArrow(run, "key long, fp long, filed boolean")


def run_links(fp: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Enough links among distinct fingerprints to join all that verified links join: at most one per fingerprint.

    Breadth first from any start: what a fingerprint reaches leaves the list, so a dense group is done in one pass.
    """
    left, links = fp.view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= max_bits
            if near.any():
                found = left[near]
                links += [(int(one.view(np.int64)), int(x)) for x in found.view(np.int64)]
                queue.extend(found)
                left = left[~near]
    return links


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that join exactly the fingerprints within ``max_bits`` of each other, directly or by steps.

    Rows are dealt and sorted by key; a task walks through the runs of equal keys. A run without a filed fingerprint or
    with one fingerprint only is passed over. A run's links are a spanning forest, so its size stays linear.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

        def solve(key, fp, filed) -> pa.RecordBatch:
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edges, len(key)))
            has = np.add.reduceat(filed.astype(np.int64), edges) > 0
            two = edges[has & (size == 2)]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits
            found = [np.stack([a[near], b[near]], 1)]
            for start, n in zip(edges[has & (size > 2)].tolist(), size[has & (size > 2)].tolist()):
                if got := run_links(fp[start:start + n], max_bits):
                    found.append(np.array(got, np.int64))
            both = np.unique(np.sort(np.concatenate(found), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            now = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)]
            key, fp, filed = (np.concatenate(x) for x in zip(kept, now))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if last:
                yield solve(key[:last], fp[:last], filed[:last])
            kept = (key[last:], fp[last:], filed[last:])
        if len(kept[0]):
            yield solve(*kept)

    return (keyed(prints).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct())


def grouped(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, first) of each distinct fingerprint: its component and the least (id, row) that carries it.

    ``prints`` has fp and rank, a struct to take the minimum of; exact copies are added up before the shuffle.
    """
    groups = stored(prints.groupBy("fp").agg(F.min("rank").alias("first")), "simhash-groups")
    joined = components(links(groups.select("fp"), max_bits))
    named = groups.join(joined, groups["fp"] == joined["node"], "left")
    return stored(named.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-named")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Exact copies meet in their fingerprint by a pre-aggregated group; only distinct fingerprints are keyed and linked.
    Null and blank texts have fingerprint 0 and link like any other; repeated rows give repeated result rows; a row
    without an id has the smallest id reachable, or null; an empty table gives an empty result; other columns are ignored.
    """
    prints = stored(fingerprints(docs), "simhash-prints")
    named = grouped(prints.select("fp", F.col("doc_id").alias("rank")), max_bits)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    owned = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(owned, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with exactly one row of each component left, one with its smallest id; all columns are kept.

    Rows without an id come after all others; of rows with equal ids the first stored one stays.
    """
    flat, at = numbered_columns(docs)

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t if isinstance(t, str) else "") for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    marked = stored(flat.select("*", hashed(F.col(at["text"])).alias("fp"), F.monotonically_increasing_id().alias("row")), "simhash-docs")
    doc_id = F.col(at["doc_id"])
    named = grouped(marked.select("fp", F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "row").alias("rank")), max_bits)
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return marked.join(chosen, "row", "left_semi").select(*flat.columns).toDF(*docs.columns)
