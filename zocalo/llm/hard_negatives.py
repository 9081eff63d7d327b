"""Hard negatives by a multiway hyperplane tree whose split points keep distance ranges to their sibling subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, stored

#: Anchors are the rows whose id is a multiple of this; positives per anchor, negatives per positive.
ANCHOR_STEP, POSITIVES, NEGATIVES = 100, 5, 5
#: A negative's score reaches at least this part (of 100) of the positive's.
FLOOR_PART = 80
#: Rows of a block, which has a tree of its own, and anchors of a block.
BLOCK, ANCHOR_BLOCK = 4096, 512
#: Split points of the upper level, and rows of the sample from which they are chosen and first floors are taken.
TOP, SAMPLE = 16, 1024
#: Split points of a node within a block, and rows of a leaf.
FAN, LEAF = 8, 128
#: Products of scaled vectors are exact in doubles, and so are keys of a product and a place, below this.
SAFE = 1 << 50
MOST = (1 << 63) - 1
NONE = -(1 << 62)


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * values.astype(float))


def lifted(products: np.ndarray, x: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """Distances of rows, from inner products and squared lengths, once one more component has made all lengths ``top``."""
    more = np.sqrt(np.maximum(top ** 2 - x, 0))[:, None] * np.sqrt(np.maximum(top ** 2 - y, 0))[None, :]
    return np.sqrt(np.maximum(2 * top ** 2 - 2 * (products + more), 0))


def asked_distance(products: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Distances from anchors (whose further component is 0) to lifted rows: larger products are nearer, whatever the row's length."""
    return np.sqrt(np.maximum(q[:, None] + top ** 2 - 2 * products, 0))


def far_apart(rows: np.ndarray, count: int, top: float) -> np.ndarray:
    """Places of up to ``count`` different rows, each the farthest from those before it."""
    size = (rows ** 2).sum(1)
    chosen = [int(np.argmax(size))]
    near = lifted(rows @ rows[chosen].T, size, size[chosen], top)[:, 0]
    while len(chosen) < min(count, len(rows)) and np.nanmax(near, initial=0) > 0:
        chosen.append(int(np.nanargmax(near)))
        near = np.minimum(near, lifted(rows @ rows[chosen[-1:]].T, size, size[chosen[-1:]], top)[:, 0])
    return np.array(chosen)


class Tree:
    """The tree over one block: rows in leaf order, nodes as two flat arrays.

    A node has split points, for each the subtree of the rows nearest to it, and the least and largest distance from each split
    point to the rows of each of the subtrees. Rows that no split point tells apart stay in one leaf.
    """

    def __init__(self, rows: np.ndarray, top: float):
        self.order = np.arange(len(rows))
        self.ints: list[int] = []
        self.ranges: list[float] = []
        self.rows, self.top, self.size = rows, top, (rows ** 2).sum(1)
        self.grow(0, len(rows))

    def grow(self, start: int, end: int) -> int:
        """The number of the node made for a stretch of the order, -1 for a leaf."""
        if end - start <= LEAF:
            return -1
        own = self.order[start:end].copy()
        tried = own[:: max(1, len(own) // (8 * FAN))]
        splits = tried[far_apart(self.rows[tried], FAN, self.top)]
        away = lifted(self.rows[own] @ self.rows[splits].T, self.size[own], self.size[splits], self.top)
        home = np.argmin(away, 1)
        used = np.unique(home)
        if len(used) < 2:
            return -1
        by = np.argsort(home, kind="stable")
        self.order[start:end] = own[by]
        edges = start + np.concatenate([[0], np.cumsum(np.bincount(home, minlength=len(splits))[used])])
        low, high = (np.array([[f(away[home == j, i]) for j in used] for i in range(len(splits))]) for f in (np.min, np.max))
        place, at = len(self.ints), len(self.ranges)
        m, c = len(splits), len(used)
        self.ints += [m, c, at, *splits.tolist(), *edges.tolist(), *[-1] * c]
        self.ranges += [*low.ravel().tolist(), *high.ravel().tolist()]
        for j in range(c):
            self.ints[place + 3 + m + c + 1 + j] = self.grow(int(edges[j]), int(edges[j + 1]))
        return place

    def stored(self) -> tuple[bytes, bytes]:
        """Nodes with split points as places in leaf order, and ranges."""
        where = np.argsort(self.order)
        ints, at = np.array(self.ints, "<i8"), 0
        while at < len(ints):
            m, c = int(ints[at]), int(ints[at + 1])
            ints[at + 3:at + 3 + m] = where[ints[at + 3:at + 3 + m]]
            at += 3 + m + 2 * c + 1
        return ints.tobytes(), np.array(self.ranges, "<f8").tobytes()


class Block:
    """A stored block: rows in leaf order with ids, labels, vectors and the tree."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, vectors: bytes, ints: bytes, ranges: bytes, top: float):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.rows = unpacked(vectors, len(self.ids), dim)
        self.ints, self.ranges, self.top = np.frombuffer(ints, "<i8"), np.frombuffer(ranges, "<f8"), top
        self.sorted = np.sort(self.ids)
        self.tie = len(self.ids) - 1 - np.searchsorted(self.sorted, self.ids)

    def descend(self, asked: np.ndarray, size: np.ndarray, outer, inner, leaf) -> int:
        """Call ``leaf(start, end, alive)`` for the stretches that the bounds leave to each anchor; how many (anchor, row) that are.

        ``outer()`` and ``inner()`` give the radii of each anchor's annulus, as they are by then. A sibling subtree is passed over if from some split point its
        range of distances lies off the ball, or wholly nearer to the anchor than the annulus.
        """
        seen = 0
        stack = [(0 if len(self.ints) else -1, 0, len(self.ids), np.arange(len(asked)))]
        while stack:
            node, start, end, alive = stack.pop()
            if node < 0:
                seen += len(alive) * (end - start)
                leaf(start, end, alive)
                continue
            m, c, at = (int(x) for x in self.ints[node:node + 3])
            tail = self.ints[node + 3:node + 3 + m + 2 * c + 1]
            splits, edges, below = tail[:m], tail[m:m + c + 1], tail[m + c + 1:]
            low, high = (self.ranges[at + k * m * c:at + (k + 1) * m * c].reshape(m, c) for k in (0, 1))
            away = asked_distance(asked[alive] @ self.rows[splits].T, size[alive], self.top)[:, :, None]
            far, near = outer()[alive][:, None, None], inner()[alive][:, None, None]
            out = ((away - far > high) | (away + far < low) | (away + high < near)).any(1)
            for j in range(c):
                if len(left := alive[~out[:, j]]):
                    stack.append((int(below[j]), int(edges[j]), int(edges[j + 1]), left))
        return seen


def packed(vectors: np.ndarray) -> bytes:
    """Single precision where that holds every component, which one leading byte tells."""
    small = not vectors.size or np.abs(vectors).max() < 1 << 24
    return (b"4" if small else b"8") + vectors.astype("<f4" if small else "<f8").tobytes()


def unpacked(data: bytes, count: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[:1] == b"4" else "<f8", offset=1).astype(float).reshape(count, dim)


def products(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond what a double holds they are taken with Python's, and end at the limits of a long."""
    most = [int(np.abs(x).max()) if x.size else 0 for x in (asked, rows)]
    if asked.shape[1] * most[0] * most[1] < SAFE:
        return (asked @ rows.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (asked, rows)]
    return np.clip(whole[0].dot(whole[1].T), -MOST, MOST)


def radius(scores: np.ndarray, size: np.ndarray, top: float, outwards: bool) -> np.ndarray:
    """Distance at which a row has this score, with room for rounding on the safe side."""
    square = size + top ** 2 - 2 * scores.astype(float)
    slack = 1e-9 * (np.sqrt(size) + top) + 1e-9
    found = np.sqrt(np.maximum(square, 0))
    return np.where(np.isnan(found), np.inf, found + slack) if outwards else np.where(np.isnan(found), 0, found - slack)


class Best:
    """The best keys (product, then smaller id) of each anchor and window in one block."""

    def __init__(self, block: Block, low: np.ndarray, high: np.ndarray, keep: int):
        self.block, self.low, self.high, self.keep = block, low, high, keep
        self.wide = len(block.ids)
        self.keys = np.full((*low.shape, keep), NONE, object if low.dtype == object else np.int64)

    def add(self, scores: np.ndarray, allowed: np.ndarray, start: int, end: int, alive: np.ndarray) -> None:
        if scores.dtype == object and self.keys.dtype != object:
            self.keys = self.keys.astype(object)
        none = NONE * self.wide * 8 if self.keys.dtype == object else NONE
        keys = scores * self.wide + self.block.tie[start:end][None, :]
        for w in range(self.low.shape[1]):
            fit = allowed & (scores >= self.low[alive, w][:, None]) & (scores <= self.high[alive, w][:, None])
            at = np.flatnonzero(fit.any(1))
            if len(at):
                both = np.concatenate([self.keys[alive[at], w], np.where(fit[at], keys[at], none)], axis=1)
                self.keys[alive[at], w] = np.sort(both, 1)[:, -self.keep:] if both.dtype == object else np.partition(both, -self.keep, 1)[:, -self.keep:]

    def floors(self) -> np.ndarray:
        """For each anchor the least score that can still get in somewhere."""
        least = self.keys.min(2)
        held = np.where(least > NONE, least // max(self.wide, 1), self.low)
        return np.where(self.low <= self.high, np.maximum(held, self.low), MOST).min(1)

    def found(self) -> Iterator[tuple[int, int, int, int]]:
        """(anchor place, window, id, score)."""
        for q, w, k in zip(*np.nonzero(self.keys > NONE)):
            score, tie = divmod(int(self.keys[q, w, k]), self.wide)
            yield int(q), int(w), int(self.block.sorted[self.wide - 1 - tie]), score


BLOCK_SCHEMA = "dim int, ids binary, labels binary, vectors binary, ints binary, ranges binary, low array<double>, high array<double>"
ASKED_SCHEMA = "dim int, ids binary, labels binary, vectors binary, least binary, most binary, low array<double>, high array<double>, inner array<double>"
FOUND_SCHEMA = "anchor_id long, window long, vec_id long, score long"


class Mining:
    """The index over all rows, and searches with blocks of anchors."""

    def __init__(self, vectors: DataFrame):
        rows = exact(vectors, vec_id="vec_id", embedding="embedding", label="label")
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        label = F.col("label").cast("long")
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
        rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(~odd)
        one = rows.select("vec_id", F.struct(label.alias("label"), "embedding").alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
        self.rows = stored(one.select("vec_id", "row.label", "row.embedding"), "gnat-rows")
        whole = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), F.lit(2.0)))
        self.total, longest = self.rows.agg(F.count("*"), F.max(whole)).first()
        self.top = float(longest or 0) ** 0.5 * (1 + 1e-9)
        sample = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        dims = [len(r["embedding"]) for r in sample]
        self.dim = max(set(dims), key=dims.count) if dims else 0
        sample = [r for r in sample if len(r["embedding"]) == self.dim]
        self.sample = (np.array([r["vec_id"] for r in sample], np.int64), np.array([r["label"] for r in sample], np.int64),
                       scaled(np.array([r["embedding"] for r in sample], float).reshape(len(sample), self.dim)))
        self.splits = self.sample[2][far_apart(self.sample[2], TOP, self.top)] if sample else np.zeros((0, 0))
        self.blocks = stored(self.packed_rows().withColumn("block", F.monotonically_increasing_id()), "gnat-blocks")

    def celled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with dim, the cell of the nearest upper split point, and the part of the cell; dealt by them and sorted."""
        splits, top, dim = self.splits, self.top, self.dim
        size = (splits ** 2).sum(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(b.schema.get_field_index("embedding"))
                dims = [len(v) for v in lists]
                cells = np.full(len(dims), -1)
                at = np.flatnonzero(np.array(dims, int) == dim)
                if len(at) and len(splits):
                    own = scaled(np.array([lists[i].values.to_numpy(zero_copy_only=False) for i in at.tolist()]).reshape(len(at), dim))
                    cells[at] = np.argmin(lifted(own @ splits.T, (own ** 2).sum(1), size, top), 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(cells, pa.int32())], names=[*b.schema.names, "dim", "cell"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        parts = 1 + self.total // (BLOCK * TOP)
        dealt = rows.mapInArrow(run, f"{kinds}, dim int, cell int").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        return dealt.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "vec_id")

    def packed_rows(self) -> DataFrame:
        splits, top, dim = self.splits, self.top, self.dim
        size = (splits ** 2).sum(1)

        def pack(d: int, held: list[tuple]) -> pa.RecordBatch:
            rows = scaled(np.array([h[2] for h in held], float).reshape(len(held), d))
            tree = Tree(rows, top)
            low = high = None
            if d == dim and len(splits):
                away = lifted(rows @ splits.T, tree.size, size, top)
                low, high = away.min(0).tolist(), away.max(0).tolist()
            ints, ranges = tree.stored()
            columns = [d, np.array([h[0] for h in held], "<i8")[tree.order].tobytes(), np.array([h[1] for h in held], "<i8")[tree.order].tobytes(),
                       packed(rows[tree.order]), ints, ranges, low, high]
            return batch_of([columns], BLOCK_KINDS, BLOCK_SCHEMA)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            now = None
            for b in batches:
                for vec_id, label, vector, d, cell in zip(*(c.to_pylist() for c in b.columns)):
                    if (d, cell) != now or len(held) == BLOCK:
                        if held:
                            yield pack(now[0], held)
                        now, held = (d, cell), []
                    held.append((vec_id, label, vector))
            if held:
                yield pack(now[0], held)

        return self.celled(self.rows).select("vec_id", "label", "embedding", "dim", "cell").mapInArrow(run, BLOCK_SCHEMA)

    def asked(self, anchors: DataFrame, keep: int, same: bool) -> DataFrame:
        """Blocks of anchors (vec_id, label, embedding, windows: array of (least, most) scores), with what they may reach from the upper split points.

        Anchors of neighbouring cells share a block. First floors come from the sample, whose rows are rows of the table.
        """
        splits, top, dim = self.splits, self.top, self.dim
        s_ids, s_labels, s_rows = self.sample

        def pack(d: int, held: list[tuple]) -> list:
            ids, labels = np.array([h[0] for h in held], "<i8"), np.array([h[1] for h in held], "<i8")
            rows = scaled(np.array([h[2] for h in held], float).reshape(len(held), d))
            size = (rows ** 2).sum(1)
            width = max(len(h[3]) for h in held)
            least, most = np.full((len(held), width), MOST, np.int64), np.full((len(held), width), -MOST, np.int64)
            for i, h in enumerate(held):
                for w, x in enumerate(h[3]):
                    least[i, w], most[i, w] = x["least"], x["most"]
            if d == dim and len(s_ids) >= keep:
                scores = products(rows, s_rows)
                allowed = (s_ids[None, :] != ids[:, None]) & ((s_labels[None, :] == labels[:, None]) == same)
                for w in range(width):
                    fit = allowed & (scores >= least[:, w:w + 1]) & (scores <= most[:, w:w + 1])
                    kth = np.sort(np.where(fit, scores, -MOST), 1)[:, -keep]
                    least[:, w] = np.where(fit.sum(1) >= keep, kth, least[:, w])
            low = high = inner = None
            if d == dim and len(splits):
                use = (least <= most).any(1)
                away = asked_distance(rows @ splits.T, size, top)
                far = radius(np.where(least <= most, least, MOST).min(1), size, top, True)[:, None]
                near = radius(most.max(1), size, top, False)[:, None]
                low, high, inner = (x.tolist() for x in ((away - far)[use].min(0, initial=np.inf), (away + far)[use].max(0, initial=-np.inf), (near - away)[use].min(0, initial=np.inf)))
            return [d, ids.tobytes(), labels.tobytes(), packed(rows), least.astype("<i8").tobytes(), most.astype("<i8").tobytes(), low, high, inner]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            now = None
            for b in batches:
                for vec_id, label, vector, windows, d in zip(*(c.to_pylist() for c in b.columns)):
                    if d != now or len(held) == ANCHOR_BLOCK:
                        if held:
                            yield batch_of([pack(now, held)], ASKED_KINDS, ASKED_SCHEMA)
                        now, held = d, []
                    if windows:
                        held.append((vec_id, label, vector, windows))
            if held:
                yield batch_of([pack(now, held)], ASKED_KINDS, ASKED_SCHEMA)

        parts = 1 + self.total // (ANCHOR_STEP * ANCHOR_BLOCK)
        dealt = self.celled(anchors).repartitionByRange(parts, "dim", "cell", "vec_id").sortWithinPartitions("dim", "cell", "vec_id")
        packs = dealt.select("vec_id", "label", "embedding", "windows", "dim").mapInArrow(run, ASKED_SCHEMA)
        return stored(packs.withColumn("asked", F.monotonically_increasing_id()), "gnat-asked")

    def reached(self, asked: DataFrame) -> DataFrame:
        """(asked, block) that the ranges to the upper split points do not rule out; only ranges are moved to tell."""
        groups = 1 + self.total // (BLOCK * 64)
        left = asked.select("asked", "dim", "low", "high", "inner", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups).cast("long"))).alias("group"))
        right = self.blocks.select("block", F.col("dim").alias("of"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.pmod(F.xxhash64("block"), F.lit(groups + 1)).alias("own"))
        off = lambda x, y, f: F.exists(F.zip_with(x, y, f), lambda v: v)
        out = off("low", "b_high", lambda q, b: q > b) | off("high", "b_low", lambda q, b: q < b) | off("inner", "b_high", lambda q, b: b < q)
        met = left.join(right, (F.col("dim") == F.col("of")) & (F.col("group") == F.col("own")) & ~F.coalesce(out, F.lit(False)))
        return met.select("asked", "block")

    def search(self, asked: DataFrame, keep: int, same: bool) -> DataFrame:
        """(anchor_id, window, vec_id, score): the ``keep`` best rows of each block and window, of the anchor's label or of others."""
        top = self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row["dim"], row["b_ids"], row["b_labels"], row["b_vectors"], row["ints"], row["ranges"], top)
                    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                    vectors = unpacked(row["vectors"], len(ids), row["dim"])
                    least, most = (np.frombuffer(row[x], "<i8").reshape(len(ids), -1) for x in ("least", "most"))
                    found = mined(block, ids, labels, vectors, least, most, keep, same)
                    yield batch_of([[ids[q], most[q, w], v, s] for q, w, v, s in found], [pa.int64()] * 4, FOUND_SCHEMA)

        right = self.blocks.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vectors").alias("b_vectors"), "ints", "ranges")
        left = asked.select("asked", "dim", "ids", "labels", "vectors", "least", "most")
        return self.reached(asked).join(left, "asked").join(right, "block").drop("asked", "block").mapInArrow(run, FOUND_SCHEMA)


BLOCK_KINDS = [pa.int32(), *[pa.binary()] * 5, *[pa.list_(pa.float64())] * 2]
ASKED_KINDS = [pa.int32(), *[pa.binary()] * 5, *[pa.list_(pa.float64())] * 3]


def batch_of(rows: list[list], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)


def mined(block: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, least: np.ndarray, most: np.ndarray, keep: int, same: bool) -> Iterator[tuple]:
    """(anchor place, window, id, score) of the best of one block; leaves are compared in whole numbers, so the result is exact."""
    size = (vectors ** 2).sum(1)
    best = Best(block, least, most, keep)

    def leaf(start: int, end: int, alive: np.ndarray) -> None:
        scores = products(vectors[alive], block.rows[start:end])
        allowed = (block.ids[None, start:end] != ids[alive, None]) & ((block.labels[None, start:end] == labels[alive, None]) == same)
        best.add(scores, allowed, start, end, alive)

    near = radius(most.max(1, initial=-MOST), size, block.top, False)
    block.descend(vectors, size, lambda: radius(best.floors(), size, block.top, True), lambda: near, leaf)
    yield from best.found()


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, from vec_id, embedding and label.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; the label moves on by one (of ten) where the id is a multiple
    of 7. Components become whole 256ths, rounded down; a score is the inner product, higher first, ties to the smaller id. An
    anchor's positives are its best rows of the same label; for each, the best rows of other labels with 80 to 100 % of
    the positive's score. Scores end at the limits of a long. Of rows with the same id the one with the least (label, vector) counts, so repeated
    rows count once; vectors of different length are never compared; an empty table gives an empty result; other columns are ignored.

    Rows go to cells of upper split points from a sample of 1,024, cells to blocks with a tree each; every row is in a leaf and leaves are
    exact, so the sample only decides how much is passed over. What moves is the blocks that an anchor block reaches.
    """
    mining = Mining(vectors)
    anchors = mining.rows.where(F.col("vec_id") % ANCHOR_STEP == 0)
    window = "array(named_struct('least', {}, 'most', {}))"
    first = anchors.withColumn("windows", F.expr(window.format(f"-{MOST}L", f"{MOST}L")))
    order = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    found = mining.search(mining.asked(first, POSITIVES, True), POSITIVES, True)
    ranked = found.withColumn("rank", F.row_number().over(order("anchor_id"))).where(F.col("rank") <= POSITIVES)
    positives = stored(ranked.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "gnat-positives")
    # the least whole number that is 80 % of the score or more, without leaving a long
    part = F.ceil(F.col("positive_score").cast("decimal(20,0)") * FLOOR_PART / 100).cast("long")
    per = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set(F.struct(part.alias("least"), F.col("positive_score").alias("most"))).alias("windows"))
    again = anchors.join(per, anchors["vec_id"] == per["anchor_id"]).select("vec_id", "label", "embedding", "windows")
    found = mining.search(mining.asked(again, NEGATIVES, False), NEGATIVES, False)
    ranked = found.withColumn("rank", F.row_number().over(order("anchor_id", "window"))).where(F.col("rank") <= NEGATIVES)
    negatives = ranked.select("anchor_id", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
