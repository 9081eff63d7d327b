"""Nearest-neighbour and hybrid retrieval over vector columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zocalo.operators.ranking import best_per_key, top_n_per_key

METRICS = ("l2sq", "cosine")
DISTANCE_DIGITS = 6
#: Documents in a ball within a task, and centres of the balls that documents are dealt by.
BALL, CENTRES = 2048, 64
#: Vectors from which the centres are chosen. Which they are steers the work, never the result.
CENTRE_SAMPLE = 2048
#: Documents of small cells that share one Python call.
PACK = 20_000
#: Room for rounding when a bound is compared with a distance.
SLACK = 1e-9


def _distances(queries: np.ndarray, documents: np.ndarray, metric: str) -> np.ndarray:
    dot = queries @ documents.T
    q2, d2 = (queries ** 2).sum(axis=1)[:, None], (documents ** 2).sum(axis=1)[None, :]
    if metric == "l2sq":
        raw = q2 + d2 - 2 * dot
    else:
        length = np.sqrt(q2 * d2)
        raw = 1 - np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)  # a zero vector is at distance 1 from all
    return np.round(np.maximum(raw, 0.0), DISTANCE_DIGITS)


def _points(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in a space with a triangle inequality: as they are, or by cosine with length one."""
    if metric == "l2sq":
        return vectors
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(points - c, axis=1) for c in centres], axis=1)


def _reach(distance: np.ndarray | float, metric: str, longest: float = 0.0) -> np.ndarray:
    """How far apart points can be that are at most ``distance`` from each other, with room for rounding; zero vectors are the caller's.

    ``longest`` is the squared length of the longest vector, which the rounding of a product grows with.
    """
    square = np.asarray(distance, float) * (1 if metric == "l2sq" else 2)
    return np.sqrt(np.maximum(square, 0) + 10.0 ** -DISTANCE_DIGITS + 1e-13 * longest) * (1 + SLACK) + SLACK


def spread_centres(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the points, each the farthest from those before it."""
    chosen = [0]
    near = _apart(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _apart(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Balls:
    """Documents of one cell in balls around spread-out members, each with its radius."""

    def __init__(self, vectors: np.ndarray, metric: str, size: int = 0):
        points, size = _points(vectors, metric), size or BALL
        self.zero = ~points.any(axis=1) if metric == "cosine" else np.zeros(len(points), bool)
        count = -(-len(points) // size)
        self.centres = spread_centres(points[:: max(1, len(points) // (16 * count))], count) if count > 1 else points[:1]
        away = _apart(points, self.centres)
        home = away.argmin(1)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(len(self.centres) + 1))
        self.members = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.radii = np.array([away[m, i].max(initial=0.0) for i, m in enumerate(self.members)])
        self.open = np.array([bool(self.zero[m].any()) for m in self.members])  # by cosine a zero vector is near to all


def near_in_balls(balls: Balls, vectors: np.ndarray, queries: np.ndarray, k: int, metric: str, allowed=None,
                  within: float | None = None, distinct: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], int]:
    """(query places, document places, distances) of the documents that can be among each query's ``k`` nearest, and how many were compared.

    Balls are visited from the nearest lower bound on; a query leaves a ball out once its ``k``-th distance so far (of different ``distinct`` numbers, if
    given) lies below the ball's bound.  ``allowed(queries, documents)`` masks pairs that do not count.
    """
    points = _points(queries, metric)
    free = ~points.any(axis=1) if metric == "cosine" else np.zeros(len(points), bool)
    bound = np.maximum(_apart(points, balls.centres) - balls.radii[None, :], 0)
    bound[:, balls.open] = 0
    bound[free] = 0
    limit = np.full(len(queries), np.inf if within is None else float(within))
    longest = float(max((queries ** 2).sum(1).max(initial=0), (vectors ** 2).sum(1).max(initial=0))) if metric == "l2sq" else 1.0
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0)) for _ in queries]
    compared = 0
    for ball in np.argsort(bound.min(axis=0), kind="stable").tolist():
        members = balls.members[ball]
        active = np.flatnonzero(bound[:, ball] <= _reach(limit, metric, longest))
        if not len(members) or not len(active):
            continue
        compared += len(members) * len(active)
        table = _distances(queries[active], vectors[members], metric)
        if allowed is not None:
            table[~allowed(active, members)] = np.inf
        table[table > limit[active][:, None]] = np.inf
        if distinct is None and len(members) > k:  # ties with the k-th stay, so that ids decide
            table[table > np.partition(table, k - 1, axis=1)[:, k - 1:k]] = np.inf
        rows, columns = np.nonzero(np.isfinite(table))
        edges = np.searchsorted(rows, np.arange(len(active) + 1))
        for n, query in enumerate(active.tolist()):
            new = columns[edges[n]:edges[n + 1]]
            if not len(new):
                continue
            places, far = (np.concatenate(x) for x in zip(kept[query], (members[new], table[n, new])))
            if distinct is not None:
                by = np.argsort(far, kind="stable")
                firsts = np.sort(np.unique(distinct[places[by]], return_index=True)[1])
                best = far[by][firsts]
            else:
                best = far
            if len(best) >= k:
                limit[query] = min(limit[query], np.partition(best, k - 1)[k - 1])
                keep = far <= limit[query]
                places, far = places[keep], far[keep]
            kept[query] = (places, far)
    return ([np.full(len(p), q) for q, (p, _) in enumerate(kept)], [p for p, _ in kept], [d for _, d in kept], compared)


def _list_codes(lists) -> tuple[np.ndarray, list[frozenset]]:
    """A number for each list by its set of values, and the sets."""
    codes: dict[frozenset, int] = {}
    numbers = [codes.setdefault(frozenset(() if x is None else x), len(codes)) for x in lists]
    return np.array(numbers, int), list(codes)


def _cell_top_k(query_id: str, document_id: str, k: int, metric: str, mask: str | None, group: str | None,
                within: float | None, others: bool, cell: list[str], rows_at_once: int = 256):
    """Worker for a pack of cells: the k nearest documents of its cell for each query of the chunk."""

    def one(documents: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids, asked = documents[document_id].to_numpy(), queries[query_id].to_numpy()
        vectors = np.vstack(documents["_vector"].to_numpy()).astype("float64")
        wanted_vectors = np.vstack(queries["_vector"].to_numpy()).astype("float64")
        distinct = pd.factorize(documents[group])[0] if group else None
        if mask:
            held, held_sets = _list_codes(documents[mask])
            wanted, wanted_sets = _list_codes(queries[mask])
            includes = np.array([[w <= h for h in held_sets] for w in wanted_sets])
        balls = Balls(vectors, metric)
        parts = []
        for start in range(0, len(asked), rows_at_once):
            def allowed(q: np.ndarray, d: np.ndarray, start=start) -> np.ndarray:
                fit = np.ones((len(q), len(d)), bool)
                if mask:
                    fit &= includes[wanted[start + q][:, None], held[d][None, :]]
                if others:
                    fit &= asked[start + q][:, None] != ids[d][None, :]
                return fit

            q, d, far, _ = near_in_balls(balls, vectors, wanted_vectors[start:start + rows_at_once], k, metric, allowed if mask or others else None, within, distinct)
            q, d, far = (np.concatenate(x) for x in (q, d, far))
            order = np.lexsort((ids[d], far, q))
            q, d, far = q[order], d[order], far[order]
            if group:
                firsts = np.sort(np.unique(q * (distinct.max(initial=0) + 2) + distinct[d] + 1, return_index=True)[1])
                q, d, far = q[firsts], d[firsts], far[firsts]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < k
            found = {query_id: asked[start + q[top]], document_id: ids[d[top]], "distance": far[top]}
            parts.append(pd.DataFrame(found | ({group: documents[group].to_numpy()[d[top]]} if group else {})))
        return pd.concat(parts)

    def run(documents: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(documents) and len(queries):
            own = dict(iter(queries.groupby(cell, dropna=False, sort=False))) if cell else {}
            for name, part in documents.groupby(cell, dropna=False, sort=False) if cell else [((), documents)]:
                those = own.get(name) if cell else queries
                if those is not None:
                    found.append(one(part, those))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in (query_id, document_id, "distance", *([group] if group else []))})

    return run


def _dealt(docs: DataFrame, asked: DataFrame, keys: list[str], k: int, metric: str, query_id: str, document_id: str, block: int, chunk: int,
           within: float | None, countable: bool, total: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the ball they lie in (``_block``), and queries once for each ball that may hold one of their nearest, by chunk.

    Balls are hash parts of at most about ``block`` documents around sampled centres. A query has to look no farther than the least distance within which
    balls that lie wholly inside hold ``k`` documents, if any document counts, nor farther than ``within``.
    """
    sample = docs.orderBy(F.xxhash64(document_id), document_id).limit(CENTRE_SAMPLE).select("_vector").collect()
    centres = spread_centres(_points(np.array([r["_vector"] for r in sample], float), metric), CENTRES)
    parts = max(1, -(-2 * total // (block * len(centres))))

    def placed(df: DataFrame, every: bool) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def run(batches):
            for b in batches:
                values = b.column("_vector")
                vectors = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(centres[0])))
                points = _points(vectors, metric)
                away = _apart(points, centres)
                if metric == "cosine":  # zero vectors are at the same distance from all, so they lie in, and look into, every ball
                    away[~points.any(axis=1)] = 0.0 if every else 2.0
                home = pa.array(away.argmin(1), pa.int32())
                far = pa.array(list(away), pa.list_(pa.float64())) if every else pa.array(away.min(1, initial=np.inf), pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, home, far], names=[*b.schema.names, "_home", "_away"])

        return df.mapInArrow(run, f"{kinds}, _home int, _away {'array<double>' if every else 'double'}")

    number = F.col("_home") * F.lit(parts) + F.pmod(F.xxhash64(document_id), F.lit(parts)).cast("int")
    in_balls = placed(docs, False).withColumn("_block", number)
    balls = in_balls.groupBy(*keys, "_block").agg(F.max("_away").alias("_radius"), F.count(F.lit(1)).alias("_size"), F.first("_home").alias("_centre"))
    seen = placed(asked, True)
    looks = seen.select(*keys, query_id, F.posexplode("_away").alias("_centre", "_gap")).join(balls, [*keys, "_centre"])
    low, high = F.greatest(F.col("_gap") - F.col("_radius"), F.lit(0.0)), F.col("_gap") + F.col("_radius")
    limit = F.lit(float(_reach(within, metric)) if within is not None else float("inf"))
    if countable:
        upto = Window.partitionBy(*keys, query_id).orderBy("_high", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*keys, query_id)
        looks = (looks.withColumn("_high", high).withColumn("_held", F.sum("_size").over(upto))
                 .withColumn("_cap", F.min(F.when(F.col("_held") >= k, F.col("_high"))).over(whole)))
        limit = F.least(limit, F.coalesce(F.col("_cap") * (1 + 1e-6) + 1e-3, F.lit(float("inf"))))
    visits = looks.filter(low <= limit).select(*keys, query_id, "_block")
    sized = asked.withColumn("_chunk", F.lit(0))
    return in_balls.drop("_home", "_away"), sized.join(visits, [*keys, query_id])


def nearest(queries: DataFrame, documents: DataFrame, k: int, query_id: str, document_id: str, vector: str = "embedding",
            by: list[str] | None = None, metric: str = "l2sq", mask: str | None = None, group: str | None = None,
            within: float | None = None, others: bool = False, document_block: int = 50_000, query_block: int = 20_000) -> DataFrame:
    """Exact k nearest documents per query: (query, document, distance, position).

    With ``by`` only rows with equal keys are compared; ``mask`` names a list column of
    which the document's must include the query's values; ``group`` keeps only the nearest
    document of each group; ``within`` is the greatest distance to keep; with ``others`` a query never finds its own id. Null vectors take
    no part; by cosine, a zero vector is at distance 1 from all.  Order is by distance (to 6 digits), then document id.

    Up to ``document_block`` documents are one cell. More are dealt to balls around sampled centres, and a query goes only to those balls that its bounds
    do not rule out.  Within a cell documents lie in smaller balls, visited by lower bound until a query's k-th distance stops it. With ``by``
    documents of a key are cut into hash blocks, and the cells of small keys share a Python call. Nothing is broadcast and no
    pair list is written, so a hot key is spread over many tasks.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    keys = list(by or [])
    masks, groups = [mask] if mask else [], [group] if group else []
    docs = documents.select(*keys, document_id, *masks, *groups, F.col(vector).alias("_vector")).filter(F.col("_vector").isNotNull())
    asked = queries.select(*keys, query_id, *masks, F.col(vector).alias("_vector")).filter(F.col("_vector").isNotNull())
    own = lambda column, count: F.pmod(F.xxhash64(column), count).cast("int")
    if keys:
        cells = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
        grid = cells(docs, document_block, "_blocks").join(cells(asked, query_block, "_chunks"), keys)
        # cells of one block and one chunk go to packs by hash, of about ``PACK`` rows; those of a larger key are packs of their own
        small = (F.col("_blocks") == 1) & (F.col("_chunks") == 1)
        packs = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // PACK))
        grid = grid.withColumn("_pack", F.when(small, F.pmod(F.xxhash64(*keys), F.lit(packs))).otherwise(F.xxhash64(*keys))).select(*keys, "_blocks", "_chunks", "_pack")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        docs = docs.join(grid, keys).withColumn("_block", own(document_id, F.col("_blocks"))).withColumn("_chunk", every("_chunks"))
        asked = asked.join(grid, keys).withColumn("_chunk", own(query_id, F.col("_chunks"))).withColumn("_block", every("_blocks"))
        cell = [*keys, "_block", "_chunk"]
        grouping = ["_pack", "_block", "_chunk"]
    else:
        total, wanted = docs.count(), asked.count()
        chunks = max(1, -(-wanted // query_block))
        if total > document_block:
            # a query's own rows do not count, so that many more have to be held
            own_rows = 0 if not others else docs.groupBy(document_id).count().agg(F.max("count")).first()[0] or 0
            docs, asked = _dealt(docs, asked, keys, k + own_rows, metric, query_id, document_id, document_block, query_block, within, not (mask or group), total)
        else:
            docs, asked = docs.withColumn("_block", F.lit(0)), asked.withColumn("_block", F.lit(0))
        docs = docs.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else docs.withColumn("_chunk", F.lit(0))
        asked = asked.withColumn("_chunk", own(query_id, F.lit(chunks)))
        cell, grouping = [], ["_block", "_chunk"]
    placed_docs = docs.select(*grouping, *[c for c in cell if c not in grouping], document_id, *masks, *groups, "_vector")
    placed_queries = asked.select(*grouping, *[c for c in cell if c not in grouping], query_id, *masks, "_vector")
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query_id, queries), *((c, documents) for c in (document_id, *groups)))}
    schema = f"{query_id} {kinds[query_id]}, {document_id} {kinds[document_id]}, distance double" + "".join(f", {c} {kinds[c]}" for c in groups)
    fresh = lambda df: df.toDF(*df.columns)  # fresh column ids: both sides may share a source
    found = (fresh(placed_docs).groupBy(*grouping).cogroup(fresh(placed_queries).groupBy(*grouping))
             .applyInPandas(_cell_top_k(query_id, document_id, k, metric, mask, group, within, others, keys), schema))
    if keys:
        found = found.distinct()  # a query or document listed under several keys may meet twice
    if group:  # each cell gives the nearest of each group there
        found = best_per_key(found, [query_id, group], ["distance", document_id], [document_id, "distance"]).drop(group)
    return top_n_per_key(found, [query_id], [F.col("distance"), F.col(document_id)], k)


def exact_names(queries: DataFrame, catalogue: DataFrame, query_id: str, names: str) -> DataFrame:
    """Catalogue entries named by each query, in the order first named; entries without text are skipped."""
    named = (queries.select(query_id, F.posexplode(names).alias("position", "_n"))
             .withColumn("table", F.trim("_n")).filter(F.col("table") != "")
             .groupBy(query_id, "table").agg(F.min("position").alias("position")))
    entries = catalogue.filter(F.coalesce(F.trim("ddl"), F.lit("")) != "").select("table").distinct()
    return named.join(entries, "table").select(query_id, "table", "position", F.lit(0.0).alias("distance"),
                                               F.lit("exact").alias("source"), F.lit(True).alias("passed_threshold"))


def semantic_names(candidates: DataFrame, query_id: str, table: str, threshold: float) -> DataFrame:
    """Nearest candidates with the flag that says whether they pass the threshold; none is dropped."""
    return candidates.select(query_id, F.col(table).alias("table"), "position", "distance", F.lit("semantic").alias("source"),
                             (F.col("distance") <= threshold).alias("passed_threshold"))


def hybrid(exact: DataFrame, semantic: DataFrame, catalogue: DataFrame, query_id: str) -> DataFrame:
    """Exact matches first, then passing semantic ones not already present that have an entry."""
    entries = catalogue.filter(F.coalesce(F.trim("ddl"), F.lit("")) != "").select("table").distinct()
    passing = semantic.filter("passed_threshold").join(entries, "table", "left_semi")
    both = (exact.withColumn("_rank", F.lit(0)).unionByName(passing.withColumn("_rank", F.lit(1))))
    first = F.min_by(F.struct("_rank", "position", "distance", "source"), F.struct("_rank", "position"))
    return (both.groupBy(query_id, "table").agg(first.alias("_f")).select(query_id, "table", "_f.*"))


def decisions(exact: DataFrame, semantic: DataFrame, query_id: str) -> DataFrame:
    """One row per (query, table) with both distances and the selection decision."""
    e = exact.select(query_id, "table", F.col("position").alias("exact_position"))
    s = semantic.select(query_id, "table", F.col("distance").alias("semantic_distance"), F.col("passed_threshold").alias("_pass"))
    is_exact, passes = F.col("exact_position").isNotNull(), F.coalesce("_pass", F.lit(False))
    decision = (F.when(is_exact & (F.col("semantic_distance").isNull() | passes), "selected")
                .when(is_exact, "selected_by_exact").when(passes, "selected_by_semantic").otherwise("discarded"))
    return e.join(s, [query_id, "table"], "full").withColumn("decision", decision).drop("_pass")


def retrieval_order() -> list[Column]:
    """Exact first in the order named, then by distance, no distance last."""
    return [F.col("exact_position").isNull(), F.col("exact_position"), F.col("semantic_distance").asc_nulls_last(), F.col("table")]
