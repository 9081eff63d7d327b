"""Language-model scores by a probabilistic suffix tree over the UTF-8 bytes of the words, beside a unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, id_remainder, stored
from zocalo.llm.simhash import words

#: Longest context in bytes.
DEPTH = 6
#: Contexts shorter than this are levels of tables; the longer ones that end in the same TOP bytes are worked on where they were dealt.
TOP = 3
#: A context is retained where its count times its divergence from its parent's distribution (in nats) reaches this.
LEAST_GAIN = 10.0
#: Weight of the parent's distribution in a child's, in symbols for each different symbol seen after the child.
SMOOTHING = 1.0
#: Words counted by place instead of being dealt out, and the expected documents of the sample that names them. Which words
#: are chosen decides the route of a count, not its value.
COMMON_WORDS, SAMPLE_ROWS = 1 << 16, 4000
#: Grams whose score every task holds; all others are dealt out by gram. Which they are decides the route of a score, not its value.
COMMON_GRAMS = 1 << 21
#: Bytes worked on at once, states built at once, and grams (of whole endings) whose contexts are worked on at once.
SLICE, CHUNK, PART = 1 << 21, 1 << 12, 1 << 20

START, END = 9, 10  # tab and line feed cannot be part of a word
#: Set in the key of a gram of a text that is not learned from.
HELD_OUT = 1 << 8 * (DEPTH + 1)
SCORES = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word binary, n long, train boolean, gram long, times long"


def canonical(w: list[bytes]) -> bytes:
    """Words joined by one blank, and the end symbol."""
    return b" ".join(w) + b"\n"


def streams(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(bytes, valid, starts, owners) of up to about SLICE bytes: pieces of texts, each behind the DEPTH bytes before it.

    Those before a text are start symbols; they and the repeated bytes are not valid, all others are counted once.
    """
    parts: list[bytes] = []
    starts: list[int] = []
    owners: list[int] = []
    size = 0

    def done():
        data = np.frombuffer(b"".join(parts), np.uint8)
        valid = np.ones(len(data), bool)
        valid[(np.array(starts)[:, None] + np.arange(DEPTH)).ravel()] = False
        return data, valid, list(starts), list(owners)

    for i, text in enumerate(texts):
        padded = bytes([START]) * DEPTH + text
        for a in range(0, len(text), SLICE):
            piece = padded[a:a + DEPTH + SLICE]
            starts.append(size)
            owners.append(i)
            parts.append(piece)
            size += len(piece)
            if size >= SLICE:
                yield done()
                parts.clear()
                starts.clear()
                owners.clear()
                size = 0
    if parts:
        yield done()


def gram_keys(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each valid place as one number."""
    one = data.astype(np.int64)
    two = one[:-1] << 8 | one[1:]
    four = two[:-2] << 16 | two[2:]
    return (four[:-3] << 24 | two[4:-1] << 8 | one[DEPTH:])[valid[DEPTH:]]


@dataclass(frozen=True)
class Tree:
    """The tree as an automaton: the state is the longest kept suffix of what was read."""

    alphabet: np.ndarray  # by byte: its column
    step: np.ndarray  # states x columns -> state
    logp: np.ndarray  # states x columns -> log10 probability

    def symbol_scores(self, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """log10 probability of each byte after those before it; the first DEPTH of ``data`` are context only.

        The bytes are read in parallel lanes; a lane begins DEPTH bytes early, after which its state is right.
        """
        n = len(data) - DEPTH
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        at = np.minimum(np.arange(length + DEPTH)[:, None] + np.arange(lanes)[None, :] * length, len(data) - 1)
        read = self.alphabet[data][at]
        width = self.step.shape[1]
        step, logp = self.step.ravel(), self.logp.ravel()
        out = np.empty((length, lanes), np.float32)
        state = np.zeros(lanes, np.int64)
        for t in range(length + DEPTH):
            place = state * width + read[t]
            if t >= DEPTH:
                out[t - DEPTH] = logp[place]
            state = step[place]
        return np.concatenate([np.zeros(DEPTH), out.T.ravel()[:n].astype(float)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each whole text."""
        total = np.zeros(len(texts))
        for data, valid, starts, owners in streams(texts):
            each = np.where(valid, self.symbol_scores(data), 0.0)
            np.add.at(total, owners, np.add.reduceat(each, starts))
        return total


def build_tree(entries: dict[int, tuple[np.ndarray, np.ndarray]], totals: dict[int, tuple[np.ndarray, np.ndarray]],
               gain: float = LEAST_GAIN, smoothing: float = SMOOTHING) -> Tree:
    """The tree in memory, from, by context length, (context and symbol -> count) and (context -> count), both sorted by key.

    ``gram_scores`` is the same tree as a table, which is what the query runs; this one is what tests hold it against.
    P(s | c) = (n(c, s) + w * P(s | parent)) / (n(c) + w), w being smoothing times the different symbols after c, so each
    distribution sums to 1; the root's parent is even over 256 bytes. A context is kept if it diverges enough from its parent, or is a suffix of one
    that does; prefixes of kept contexts become states too, with the distribution of their longest kept suffix, so
    that the longest suffix is always known.
    """
    used = np.unique(np.concatenate([[START, END], np.asarray(entries.get(0, (np.empty(0, np.int64),))[0], np.int64) & 255]))
    alphabet = np.full(256, len(used), np.int64)  # bytes that the root does not list share a column
    alphabet[used] = np.arange(len(used))
    symbols = np.append(used, next((b for b in range(256) if alphabet[b] == len(used)), END))
    bytes_of = np.append(np.ones(len(used), np.float32), np.float32(256 - len(used)))
    keep: dict[int, np.ndarray] = {0: np.zeros(1, np.int64)}
    dense: dict[int, np.ndarray] = {}

    def distribution(d: int, contexts: np.ndarray, parents: np.ndarray) -> np.ndarray:
        keys, counts = entries.get(d, (np.empty(0, np.int64), np.empty(0)))
        listed = np.zeros((len(contexts), len(symbols)), np.float32)
        if len(contexts) and len(keys):
            row = np.searchsorted(contexts, keys >> 8)
            ok = (row < len(contexts)) & (contexts[np.minimum(row, len(contexts) - 1)] == keys >> 8)
            listed[row[ok], alphabet[keys[ok] & 255]] = counts[ok]
        weight = smoothing * np.maximum((listed > 0).sum(1), 1)[:, None]
        return (listed + weight * parents) / (listed.sum(1)[:, None] + weight)

    dense[0] = distribution(0, keep[0], np.full((1, len(symbols)), 1 / 256, np.float32))
    frequent, gains = {0: keep[0]}, {}
    for d in range(1, DEPTH + 1):
        contexts = np.asarray(totals.get(d, (np.empty(0, np.int64),))[0], np.int64)
        # a parent drops the first (highest) byte; what is frequent has frequent suffixes
        parent = np.searchsorted(frequent[d - 1], contexts & ((1 << 8 * (d - 1)) - 1))
        frequent[d] = contexts
        dense[d] = distribution(d, contexts, dense[d - 1][parent]) if len(contexts) else np.empty((0, len(symbols)), np.float32)
        n = totals[d][1] if d in totals else np.empty(0)
        gain_of = lambda i: (dense[d][i:i + CHUNK] * np.log(dense[d][i:i + CHUNK] / dense[d - 1][parent[i:i + CHUNK]])) @ bytes_of  # noqa: B023, E731
        gains[d] = np.concatenate([gain_of(i) for i in range(0, len(contexts), CHUNK)]) * n if len(contexts) else np.empty(0)
    for d in gains:
        keep[d] = frequent[d][gains[d] >= gain]
    for d in range(DEPTH, 1, -1):
        keep[d - 1] = np.union1d(keep[d - 1], keep[d] & ((1 << 8 * (d - 1)) - 1))
    states = dict(keep)
    for d in range(DEPTH, 1, -1):
        states[d - 1] = np.union1d(states[d - 1], states[d] >> 8)
    first = dict(zip(states, np.concatenate([[0], np.cumsum([len(states[d]) for d in sorted(states)])[:-1]])))

    def longest(keys: np.ndarray, lengths: np.ndarray, within: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest suffix of each key in ``within``, and its place there."""
        length, place = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for d in range(1, DEPTH + 1):
            own = within.get(d, np.empty(0, np.int64))
            if not len(own):
                continue
            suffix = keys & ((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(own, suffix), len(own) - 1)
            hit = (own[at] == suffix) & (lengths >= d)
            length[hit], place[hit] = d, at[hit]
        return length, place

    steps, logs = [], []
    offsets = np.array([first[k] for k in range(DEPTH + 1)])
    # a few thousand states at a time: the working arrays have a row for each state and symbol
    for d, keys in ((d, states[d][i:i + CHUNK]) for d in sorted(states) for i in range(0, len(states[d]), CHUNK)):
        length, place = longest(keys, np.full(len(keys), d), keep)
        p = np.zeros((len(keys), len(symbols)), np.float32)
        for k in np.unique(length):
            rows = length == k
            p[rows] = dense[k][np.searchsorted(frequent[k], keep[k][place[rows]] if k else np.zeros(rows.sum(), np.int64))]
        logs.append(np.log10(p))
        nxt = ((keys[:, None] << 8) | symbols[None, :]).ravel()
        length, place = longest(nxt, np.full(len(nxt), d + 1), states)
        into = (place + offsets[length]).astype(np.int32).reshape(len(keys), len(symbols))
        into[:, -1] = 0  # what the root does not list leads back to it
        steps.append(into)
    return Tree(alphabet, np.concatenate(steps), np.concatenate(logs))


def common_words(rows: DataFrame, total: int, most: int = COMMON_WORDS) -> list[bytes]:
    """The most frequent words of a sample of about SAMPLE_ROWS documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    sample = rows.sample(min(1.0, SAMPLE_ROWS / max(total, 1)), 9).select("text")
    found = sample.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(r["word"]) for r in found.select("word").collect()]


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key, sorted, and the sum of its numbers; runs that are sorted already are merged."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def corpus_counts(rows: DataFrame, common: list[bytes]) -> DataFrame:
    """(kind, key, n): kind 0 counts common words by place (-1: ends), kind 1 the DEPTH + 1 byte grams.

    n is over all training texts, so 0 for a gram of others only. A task adds up its own before anything is moved.
    """
    places = docs_broadcast(rows, {w: i for i, w in enumerate(common)})
    many = len(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tally, ends = places.value, np.zeros(many + 1, np.int64), 0
        keys, counts, pending = [], [], 0
        found: list[int] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))

        def told() -> None:
            tally[:] += np.bincount(np.array(found, np.int64), minlength=many + 1)
            found.clear()

        def out(kind, key, n) -> pa.RecordBatch:
            learned = np.where(key & HELD_OUT, 0, n) if kind else n
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key & (HELD_OUT - 1) if kind else key),
                                               pa.array(learned)], names=["kind", "key", "n"])

        def texts(b: pa.RecordBatch, train: bool) -> Iterator[bytes]:
            for t, own in zip(b.column(0), b.column(1).to_pylist()):
                if own == train:
                    w = words(t.as_py() or "")
                    if train:
                        found.extend([place[x] for x in w if x in place])
                        if len(found) > 1 << 18:
                            told()
                    yield canonical(w)

        for b in batches:
            ends += b.column(1).true_count
            for train in (True, False):
                for data, valid, _, _ in streams(texts(b, train)):
                    own, n = np.unique(gram_keys(data, valid), return_counts=True)
                    keys.append(own if train else own | HELD_OUT)
                    counts.append(n)
                    pending += len(own)
                    if pending > 1 << 22:
                        own, n = merged()
                        keys, counts, pending = [own], [n], len(own)
                        if pending > 1 << 21:
                            yield out(1, own, n)
                            keys, counts, pending = [], [], 0
        own, n = merged()
        yield out(1, own, n)
        told()
        at = np.flatnonzero(tally)
        yield out(0, np.append(at, -1), np.append(tally[at], ends))

    made = rows.select("text", "train").mapInArrow(run, "kind int, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def docs_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def last(column: str, symbols: int):
    """The last ``symbols`` bytes of a key."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * symbols) - 1))


def conditional(key: np.ndarray, n: np.ndarray, parent: np.ndarray, smoothing: float) -> tuple[np.ndarray, ...]:
    """One level, sorted by key: each key's probability after its context, its context's place, and the contexts and their gains.

    What was not seen after a context has one ratio to its parent, so it needs no rows.
    """
    first = np.flatnonzero(np.diff(key >> 8, prepend=-1))
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    total = np.add.reduceat(n, first)
    w = smoothing * np.maximum(np.add.reduceat((n > 0).astype(np.int64), first), 1)
    p = (n + w[place] * parent) / (total + w)[place]
    seen = np.add.reduceat(np.where(n > 0, p, 0.0), first)
    apart = np.add.reduceat(np.where(n > 0, p * np.log(p / parent), 0.0), first)
    return p, place, key[first] >> 8, total * (apart + np.maximum(1 - seen, 0.0) * np.log(w / (total + w)))


def ending_scores(key: np.ndarray, n: np.ndarray, parent: np.ndarray, gain: float, smoothing: float) -> np.ndarray:
    """The probability of each gram after its longest retained context of TOP bytes or more, NaN where there is none.

    The grams are all of those whose contexts have certain TOP last bytes, sorted; ``parent`` is the probability after TOP - 1 bytes.
    """
    keys, counts, parents, up = {DEPTH: key}, {DEPTH: n}, {DEPTH: parent}, {}
    for d in range(DEPTH - 1, TOP - 1, -1):
        keys[d], at, up[d + 1] = np.unique(keys[d + 1] & ((1 << 8 * (d + 1)) - 1), return_index=True, return_inverse=True)
        counts[d], parents[d] = np.bincount(up[d + 1], counts[d + 1]).astype(np.int64), parents[d + 1][at]
    p, place, contexts, kept = {}, {}, {}, {}
    for d in range(TOP, DEPTH + 1):
        p[d], place[d], contexts[d], gains = conditional(keys[d], counts[d], p[d - 1][up[d]] if d > TOP else parents[d], smoothing)
        kept[d] = gains >= gain
    for d in range(DEPTH, TOP, -1):
        kept[d - 1][np.searchsorted(contexts[d - 1], contexts[d][kept[d]] & ((1 << 8 * (d - 1)) - 1))] = True
    found = np.full(len(keys[TOP]), np.nan)
    for d in range(TOP, DEPTH + 1):
        found = np.where(kept[d][place[d]], p[d], found[up[d]] if d > TOP else found)
    return found


def gram_scores(grams: DataFrame, gain: float = LEAST_GAIN, smoothing: float = SMOOTHING) -> DataFrame:
    """(key, n, score): log10 probability of the last byte of each gram after those before it, from (key, n); n may be 0.

    The tree of ``build_tree``, whatever its size: no context is left out for being rare or one of too many. Contexts of less than
    TOP bytes are small tables, one for each length: going down from the root, a gram meets its suffix, which has its parent's
    probability, and the other symbols after its context, which give the divergence. A context and its suffixes share their last bytes,
    so longer ones are dealt out by their last TOP bytes, once, and each such ending goes on by itself. Going up, suffixes of
    retained contexts are retained; a gram takes the probability after the longest retained one.
    """
    counted = {TOP - 1: stored(grams.groupBy(last("key", TOP).alias("k")).agg(F.sum("n").alias("n")), "lm-counted")}
    for d in range(TOP - 2, -1, -1):
        counted[d] = counted[d + 1].groupBy(last("k", d + 1).alias("k")).agg(F.sum("n").alias("n"))
    same = Window.partitionBy("context")
    n, p, parent, total, w = (F.col(x) for x in ("n", "p", "parent", "total", "w"))
    levels, kept = {}, {}
    for d in range(TOP):
        rows = counted[d].withColumn("context", F.shiftright("k", 8))
        if d:
            rows = rows.withColumn("up", last("k", d)).join(levels[d - 1].select(F.col("k").alias("up"), p.alias("parent")), "up")
        else:
            rows = rows.withColumn("parent", F.lit(1 / 256))
        rows = rows.withColumns({"total": F.sum("n").over(same), "w": smoothing * F.greatest(F.count_if(n > 0).over(same), F.lit(1))})
        rows = rows.withColumn("p", (n + w * parent) / (total + w))
        seen = F.sum(F.when(n > 0, p).otherwise(0.0)).over(same)
        apart = F.sum(F.when(n > 0, p * F.log(p / parent)).otherwise(0.0)).over(same)
        levels[d] = stored(rows.select("k", "p", (total * (apart + F.greatest(1 - seen, F.lit(0.0)) * F.log(w / (total + w)))).alias("gain")), "lm-level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(rows: pa.Table) -> pa.RecordBatch:
            order = np.argsort(rows.column("key").to_numpy())
            key, n, parent = (rows.column(x).to_numpy()[order] for x in ("key", "n", "parent"))
            p = ending_scores(key, n, parent, gain, smoothing)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(p, from_pandas=True)], names=["key", "n", "p"])

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held, size = [*held, b], size + b.num_rows
            if size >= PART:
                ending = b.column("ending").to_numpy()
                cut = int(np.searchsorted(ending, ending[-1]))  # the last ending may go on in the next batch
                if cut:
                    yield scored(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                    held, size = [b.slice(cut)], b.num_rows - cut
        if held:
            yield scored(pa.Table.from_batches(held))

    asked = grams.withColumn("up", last("key", TOP)).join(levels[TOP - 1].select(F.col("k").alias("up"), p.alias("parent")), "up")
    asked = asked.select("key", "n", "parent", F.shiftright(last("key", TOP + 1), 8).alias("ending"))
    deep = stored(asked.repartition("ending").sortWithinPartitions("ending").mapInArrow(run, "key long, n long, p double"), "lm-deep")
    longer = deep.where(p.isNotNull()).select(F.shiftright(last("key", TOP), 8).alias("context"))
    for d in range(TOP - 1, 0, -1):
        own = levels[d].where(F.col("gain") >= gain).select(F.shiftright("k", 8).alias("context"))
        kept[d] = longer = stored(longer.select(last("context", d).alias("context")).union(own).distinct(), "lm-kept")
    found = levels[0].select("k", "p")
    for d in range(1, TOP):
        rows = levels[d].select("k", "p", F.shiftright("k", 8).alias("context"), last("k", d).alias("up"))
        rows = rows.join(found.select(F.col("k").alias("up"), p.alias("parent")), "up").join(kept[d].withColumn("own", F.lit(True)), "context", "left")
        found = rows.select("k", F.when(F.col("own"), p).otherwise(parent).alias("p"))
    found = stored(found.select(F.col("k").alias("up"), p.alias("parent")), "lm-found")
    return deep.withColumn("up", last("key", TOP)).join(found, "up").select("key", "n", F.log10(F.coalesce(p, parent)).alias("score"))


def common_grams(scores: DataFrame, most: int = COMMON_GRAMS) -> tuple[int, np.ndarray, np.ndarray]:
    """(least n, keys, scores) of the most frequent grams of (key, n, score), at most ``most``; a last score is that of no key."""
    power = F.floor(F.log2("n") * 8)
    listed = scores.where(F.col("n") > 0).groupBy(power.alias("power")).agg(F.count("*").alias("grams"), F.min("n").alias("least")).collect()
    least, held = 1 << 62, 0
    for r in sorted(listed, key=lambda r: -r["power"]):
        held += r["grams"]
        if held > most:
            break
        least = r["least"]
    found = scores.where(F.col("n") >= least).select("key", "score").toArrow()
    return least, np.asarray(found.column("key"), np.int64), np.append(np.asarray(found.column("score"), float), 0.0)


def text_scores(texts: list[bytes], keys: pd.Index, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sum over each text's grams that are among ``keys``; and all others as arrays of texts, grams and times."""
    total, others = np.zeros(len(texts)), [[], [], []]
    for data, valid, starts, owners in streams(texts):
        owner = np.repeat(owners, np.diff(np.append(starts, len(data))))[valid]
        key = gram_keys(data, valid)
        at = keys.get_indexer(key)
        total += np.bincount(owner, values[at], len(texts))
        rest = at < 0
        own, back = np.unique(key[rest], return_inverse=True)
        pairs, times = np.unique(owner[rest] * len(own) + back, return_counts=True)
        for column, more in zip(others, (pairs // len(own), own[pairs % len(own)], times)):
            column.append(more)
    return total, [np.concatenate(x) if x else np.empty(0, np.int64) for x in others]


def lm_scores(docs: DataFrame, held: int = COMMON_GRAMS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are lower-cased (A-Z), one end counts as a token too. base_score adds log10((c + 1) / (N + V + 1)) over the
    tokens with exact counts of all training documents: those of common words are gathered by place, all other words are dealt
    out by word, once per document. score is the tree's log10 probability of the words, with one blank between them,
    and the end; a symbol's is that of the gram it ends, which every task holds for the ``held`` most frequent grams, while all others
    are dealt out by gram. Null and empty texts are the end alone; repeated rows count and are scored each; with nothing to learn
    from c, N and V are 0 and the tree is even; an empty table gives an empty result; other columns are ignored.
    """
    rows = exact(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", "text", (id_remainder(F.col("doc_id"), 7) != 2).alias("train"), F.monotonically_increasing_id().alias("row_id"))
    common = common_words(rows, rows.count())
    counts = stored(corpus_counts(rows, common), "lm-counts")
    ranked = {r["key"]: r["n"] for r in counts.where("kind = 0").select("key", "n").collect()}
    scored = gram_scores(counts.where("kind = 1").select("key", "n"))
    least, keys, values = common_grams(scored, held)
    model = docs_broadcast(docs, (pd.Index(keys), values, {w: (math.log10(ranked.get(i, 0) + 1), ranked.get(i, 0) > 0) for i, w in enumerate(common)}))
    end_log, end_known = math.log10(ranked.get(-1, 0) + 1), int(ranked.get(-1, 0) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, known_words = model.value
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                ids, row_ids, train = part.column(0).to_pylist(), part.column(3).to_pylist(), part.column(2).to_pylist()
                texts, n_tokens, known, base = [], [], [], []
                rare, rare_row, rare_n, rare_train = [], [], [], []
                for t, row_id, is_train in zip(part.column(1), row_ids, train):
                    w = words(t.as_py() or "")
                    texts.append(canonical(w))
                    n_tokens.append(len(w) + 1)
                    got = [known_words[x] for x in w if x in known_words]
                    known.append(sum(k for _, k in got) + end_known)
                    base.append(math.fsum(v for v, _ in got) + end_log)
                    if len(got) < len(w):
                        other = Counter(x for x in w if x not in known_words)
                        rare += other
                        rare_n += other.values()
                        rare_row += [row_id] * len(other)
                        rare_train += [is_train] * len(other)
                scores, (owner, gram, times) = text_scores(texts, keys, values)
                m = len(ids)
                # a row for the document itself; its "word" is one that no text has, and another for each
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array([not x for x in train], pa.bool_()), pa.array(n_tokens, pa.int64()),
                     pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()),
                     pa.array([b"\n%d" % r for r in row_ids], pa.binary()), pa.array([0] * m, pa.int64()), pa.array([False] * m, pa.bool_()), pa.nulls(m, pa.int64()),
                     pa.array([0] * m, pa.int64())], schema=ROWS)
                k = len(rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rare_row, pa.int64()), *(pa.nulls(k, f.type) for f in list(ROWS)[1:7]), pa.array(rare, pa.binary()),
                     pa.array(rare_n, pa.int64()), pa.array(rare_train, pa.bool_()), pa.nulls(k, pa.int64()), pa.array([0] * k, pa.int64())], schema=ROWS)
                k = len(gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(row_ids, np.int64)[owner]), *(pa.nulls(k, f.type) for f in list(ROWS)[1:8]), pa.array(np.zeros(k, np.int64)),
                     pa.array(np.zeros(k, bool)), pa.array(gram), pa.array(times)], schema=ROWS)

    # a gram's score is a row among the rows that ask for it
    asked = rows.mapInArrow(run, SCORES).withColumn("of_gram", F.lit(None).cast("double"))
    told = scored.where(F.col("n") < least).select(F.col("key").alias("gram"), F.col("score").alias("of_gram"))
    # one number first, as comparing that is cheap; words whose hashes are equal, or equal to a gram, stay apart
    same = Window.partitionBy(F.coalesce("gram", F.xxhash64("word")), "word")
    n_train = F.when(F.col("train"), F.col("n")).otherwise(F.lit(0))
    dealt = asked.unionByName(told, allowMissingColumns=True).withColumns(
        {"c": F.sum(n_train).over(same), "lead": F.min("row_id").over(same), "of_gram": F.max("of_gram").over(same)})
    each = stored(dealt.where(F.col("row_id").isNotNull()).groupBy("row_id").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "known", "base", "score")), F.sum(F.col("times") * F.col("of_gram")).alias("rare_score"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))).alias("rare_known"),
        F.sum(n_train).alias("rare_train"), F.count(F.when((F.col("c") > 0) & (F.col("row_id") == F.col("lead")), 1)).alias("rare_words")), "lm-rows")
    sums = each.agg(F.coalesce(F.sum("rare_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("rare_words"), F.lit(0)).alias("v")).first()
    n = int(sums["n"]) + sum(ranked.values())
    v = int(sums["v"]) + sum(x > 0 for x in ranked.values())
    return each.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("base") + F.col("rare_base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
                       (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))


ROWS = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                  ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("n", pa.int64()), ("train", pa.bool_()),
                  ("gram", pa.int64()), ("times", pa.int64())])
