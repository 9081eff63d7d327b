"""Near copies by b-bit MinHash: bands of minima name candidates, packed low bits estimate them, full sets confirm them."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.llm.components import components
from zocalo.llm.frames import exact, stored
from zocalo.llm.simhash import words

#: Low bits kept of each minimum.
LOW_BITS = 4
#: Standard deviations below the threshold at which an estimate still sends a pair to the full sets: one in 10**9 falls below.
MARGIN = 6.0
#: Rows of a block under a band key and in a cluster, and shingles in a block of a cluster; larger groups are dealt into blocks.
KEY_BLOCK, BLOCK, WEIGHT = 1024, 512, 1 << 17
#: Shingles whose minima are taken at once, and minima taken at once.
SLICE, STRIP = 1 << 12, 32

_hash = functools.partial(xxhash.xxh64_intdigest, seed=43)


class Rule(NamedTuple):
    """What makes two texts near copies, and the bands that find them.

    ``least`` is the least Jaccard similarity in percent of the sets of ``shingle``-word shingles. A pair of similarity s shares
    a band with probability 1 - (1 - s**rows)**bands.
    """

    shingle: int
    least: int
    bands: int
    rows: int

    @property
    def estimate(self) -> float:
        """The least estimate that sends a pair to the full sets."""
        s, blind = self.least / 100, 2.0 ** -LOW_BITS
        p = s + (1 - s) * blind
        return s - MARGIN * (p * (1 - p) / (self.bands * self.rows)) ** 0.5 / (1 - blind)


#: Three-word shingles at 0.85: 32 bands of 6 miss one pair in 4 million at the threshold, fewer above.
DEFAULT = Rule(3, 85, 32, 6)


def shingles(text: str, size: int) -> set[bytes]:
    """The ``size``-word shingles; of a shorter text its words as one, of a text without a word none."""
    w = words(text)
    if len(w) < size:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(size)))))


def similar(x: set, y: set, least: int) -> bool:
    both = len(x & y)
    return bool(both) and 100 * both >= least * (len(x) + len(y) - both)


@functools.lru_cache(maxsize=4)
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(8)
    factors, offsets = (draw.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    return factors | np.uint32(1), offsets


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` permutations over the upper halves of 64-bit hashes."""
    factors, offsets = permutations(count)
    points = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(points), SLICE):
        part = points[None, a:a + SLICE]
        for f in range(0, count, STRIP):
            least[f:f + STRIP] = np.minimum(least[f:f + STRIP], (part * factors[f:f + STRIP, None] + offsets[f:f + STRIP, None]).min(1))
    return least


def planes(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, one plane after the other, 64 minima a word (signed)."""
    padded = np.zeros(-(-len(least) // 64) * 64, np.uint32)
    padded[:len(least)] = least
    bits = (padded[None, :] >> np.arange(LOW_BITS, dtype=np.uint32)[:, None] & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


SKETCH = "row long, doc_id long, n long, digest binary, keys array<long>, bits array<long>"


def sketches(texts: DataFrame, rule: Rule) -> DataFrame:
    """(row, doc_id, n, digest, keys, bits) of (row, doc_id, text): set size, digest of the set, band keys and packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = rule.bands * rule.rows
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                b = batch.slice(a, 1024)
                sizes, digests, keys, bits = [], [], [], []
                for t in b.column(2):
                    own = shingles(t.as_py() or "", rule.shingle)
                    sizes.append(len(own))
                    h = np.fromiter(map(_hash, own), np.uint64, len(own))
                    h.sort()
                    digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    if not len(h):
                        keys.append(None)
                        bits.append(None)
                        continue
                    least = minima(h, width)
                    bands = least.reshape(rule.bands, rule.rows)
                    keys.append([xxhash.xxh64_intdigest(bands[i].tobytes(), i) - (1 << 63) for i in range(rule.bands)])
                    bits.append(planes(least))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n", "digest", "keys", "bits"])

    return texts.mapInArrow(run, SKETCH)


def fitting(rule: Rule, n: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which ``others`` may be similar to one set: sizes allow it, and the collision-corrected count of equal low bits suggests it."""
    width, strip = rule.bands * rule.rows, -(-rule.bands * rule.rows // 64)
    unequal = np.bitwise_count(np.bitwise_or.reduce((others ^ bits).reshape(-1, LOW_BITS, strip), axis=1)).sum(1)
    blind = 2.0 ** -LOW_BITS
    near = (1 - unequal / width - blind) / (1 - blind) >= rule.estimate
    return near & (100 * np.minimum(sizes, n) >= rule.least * np.maximum(sizes, n))


def forest(rows: np.ndarray, sizes: np.ndarray, bits: np.ndarray, side: np.ndarray, rule: Rule, sets: list[set] | None = None) -> list[tuple[int, int]]:
    """Pairs that join all that fitting pairs (with ``sets``: similar ones) join: at most one for each row.

    Breadth first from any row: what a row reaches leaves the list. A row is compared with all rows still in it, so no pair
    between two trees is passed over. ``side`` is 0 for all rows, or 1 and 2 for two blocks of which only pairs across count.
    """
    left, found = np.arange(len(rows)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = fitting(rule, sizes[one], bits[one], sizes[left], bits[left]) & ((side[left] != side[one]) | (side[one] == 0))
            if sets is not None:
                at = np.flatnonzero(near)
                near[at] = [similar(sets[one], sets[i], rule.least) for i in left[at].tolist()]
            if near.any():
                got = left[near]
                found += [(int(rows[one]), int(rows[i])) for i in got]
                queue.extend(got.tolist())
                left = left[~near]
    return found


PAIRS = "a long, b long"


def pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    both.sort(1)
    both = np.unique(both, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def in_cells(rows: DataFrame, group: str, weight: int) -> DataFrame:
    """``rows`` with a column ``cell`` and a ``side``, dealt and sorted by ``group`` and cell.

    A group of up to ``weight`` rows and about ``WEIGHT`` shingles is one cell. A larger one is dealt into blocks of about that by hash,
    and each two of them, and each one, are a cell, so no task holds more than two blocks.
    """
    size = rows.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / weight), F.ceil(F.sum("n") / WEIGHT)).alias("parts"))
    dealt = rows.join(size, group).withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")))
    many = dealt.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    split = many.select(*rows.columns, (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("cell"), side.alias("side"))
    cells = dealt.where("parts = 1").select(*rows.columns, F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side")).union(split)
    return cells.repartition(group, "cell").sortWithinPartitions(group, "cell")


def solved(cells: DataFrame, group: str, rule: Rule, texts: bool) -> DataFrame:
    """The forest of each cell, from rows of (group, cell, side, row, n, bits) and the text, which confirms on full sets if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, found = None, []

        def solve() -> None:
            side, rows, sizes = (np.array(x) for x in list(zip(*held))[:3])
            found.extend(forest(rows, sizes, np.stack([h[3] for h in held]), side, rule, [h[4] for h in held] if texts else None))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            marks = list(zip(columns[group].to_pylist(), columns["cell"].to_pylist()))
            sides, rows, sizes = (columns[x].to_pylist() for x in ("side", "row", "n"))
            bits = columns["bits"].flatten().to_numpy().view(np.uint64).reshape(len(marks), -1)
            for i, mark in enumerate(marks):
                if mark != now:
                    if len(held) > 1:
                        solve()
                    now, held = mark, []
                own = frozenset(map(_hash, shingles(columns["text"][i].as_py() or "", rule.shingle))) if texts else None
                held.append((sides[i], rows[i], sizes[i], bits[i].copy(), own))
            if len(found) > 1 << 14:
                yield pair_batch(found)
                found = []
        if len(held) > 1:
            solve()
        yield pair_batch(found)

    wanted = [group, "cell", "side", "row", "n", "bits"] + (["text"] if texts else [])
    return cells.select(*wanted).mapInArrow(run, PAIRS)


def links(sketch: DataFrame, texts: DataFrame, rule: Rule, group: int | None = None) -> DataFrame:
    """(a, b) links that join exactly what the similar pairs under a common band key join, from distinct sets and (row, text).

    Under each key rows whose sketches fit are joined to clusters; a cluster holds whatever could be linked. Its rows then meet with their
    full sets, in one cell or cell by cell, and give a spanning forest of the similar pairs. No list of pairs is ever made, so
    a dense group costs rows times blocks to move and nothing in links but one for each row. ``group`` is the rows of a block.
    """
    keyed = sketch.select(F.explode("keys").alias("key"), "row")
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    members = stored(keyed.join(shared, "key"), "minhash-members")
    near = solved(in_cells(members.join(sketch.select("row", "n", "bits"), "row"), "key", group or KEY_BLOCK), "key", rule, texts=False)
    joined = components(near.distinct())
    clusters = joined.select(F.col("node").alias("row"), F.col("root").alias("cluster")).union(joined.select("root", "root").distinct())
    rows = clusters.join(sketch.select("row", "n", "bits"), "row").join(texts, "row")
    cells = in_cells(stored(rows, "minhash-rows"), "cluster", group or BLOCK)
    return stored(solved(cells, "cluster", rule, texts=True).distinct(), "minhash-links")


def grouped(sketch: DataFrame, texts: DataFrame, rule: Rule, group: int | None = None) -> DataFrame:
    """(digest, root) of every set that is not empty; root is the least row of its component.

    ``sketch`` is a stored table of ``sketches``, ``texts`` the (row, text) it was made from, with the same row numbers. Equal sets
    meet in their digest by a pre-aggregated group, so exact copies are searched once.
    """
    sets = stored(sketch.where("n > 0").groupBy("digest").agg(F.min("row").alias("node")), "minhash-sets")
    distinct = stored(sketch.select("row", "n", "keys", "bits").join(sets.select(F.col("node").alias("row")), "row", "left_semi"), "minhash-distinct")
    joined = components(links(distinct, texts, rule, group))
    return stored(sets.join(joined, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "minhash-grouped")


def near_duplicates(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Texts are linked if the sets of their word shingles (A-Z lower-cased) reach the rule's similarity; a pair at the threshold is
    looked at with probability 0.9999997, a more similar one with more, and no pair below it is linked. Null and blank texts have an empty
    set, are linked with nothing and are their own component; texts with fewer words than a shingle have their words as
    one. Repeated rows give repeated result rows. A row without an id has the smallest id reachable, or null, and is not kept;
    an empty table gives an empty result; other columns are ignored. ``docs`` must be a table that reads the same twice.
    """
    rows = exact(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(sketches(rows, rule), "minhash-sketch")
    groups = grouped(sketch.select("row", "n", "digest", "keys", "bits"), rows.select("row", "text"), rule)
    per_set = sketch.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first")).join(groups, "digest")
    smallest = per_set.groupBy("root").agg(F.min("first").alias("component_id"))
    named = per_set.join(smallest, "root").select("digest", "component_id")
    full = sketch.where("n > 0").select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id")
    every = full.union(sketch.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
