"""Hard negatives, MinHash near copies and conversation repair against plain versions, with odd rows of every kind."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from zocalo.llm import conversations, hard_negatives, minhash
from zocalo.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11 hard negatives ----------------------------------------------------------------------------------------------------

def plain_negatives(rows):
    """Expected result from (vec_id, vector, label) by looking at every pair, with Python's whole numbers."""
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        own = ((label + 1) % 10 if vec_id % 7 == 0 else label, vector)
        usable[vec_id] = min(usable.get(vec_id, own), own)
    whole = {i: (label, [int(np.floor(256.0 * x)) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in whole.items() if i != a and len(w) == len(v))
        for minus, positive in [x for x in scored if whole[x[1]][0] == label][:5]:
            fit = [x for x in scored if whole[x[1]][0] != label and 80 * -minus <= 100 * -x[0] <= 100 * -minus][:5]
            out += [(a, positive, rank, n, -minus, -m) for rank, (m, n) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, n, "x", 1) for i, v, n in rows], "vec_id long, embedding array<double>, label int, LABEL string, score int")


def test_query_of_hard_negatives(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted_rows(QUERIES["op11_hard_negatives"][0](spark, SMALL)) == plain_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 3) / 8).tolist(), int(rng.integers(0, 3))) for i in range(300)]  # many ties
    rows += [(i, [1.0, 0.5], i % 2) for i in range(1000, 1030)]  # another length, all alike
    rows += [(400, None, 1), (500, [0.1, None, 0.2], 1), (600, [float("nan")] * 3, 1), (700, [float("inf"), 0.0, 0.0], 1), (800, [0.0, 0.0, 0.0], None),
             (None, [1.0, 1.0, 1.0], 1), (900, [0.0, 0.0, 0.0], 2), (1100, [], 1), (1101, [], 2), (1102, [], 1), (1200, [1e5, 3.0, 1e5], 1), (1201, [1e5, 2.0, 1e5], 1),
             (1202, [9e4, 1.0, 1e5], 0)]
    rows += rows[:20] + [(100, [0.5, 0.5, 0.5], 9)]  # repeated rows, and an id with two vectors
    assert sorted_rows(hard_negatives.hard_negatives(vector_table(spark, rows))) == plain_negatives(rows)
    assert hard_negatives.hard_negatives(vector_table(spark, rows).where("false")).count() == 0


def test_hard_negatives_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.05).tolist(), int(rng.integers(0, 4))) for i in range(1500)]
    assert sorted_rows(hard_negatives.hard_negatives(vector_table(spark, rows))) == plain_negatives(rows)


def test_sibling_ranges_pass_rows_over():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 300
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 10)
    top = float(np.sqrt((rows ** 2).sum(1).max()) * (1 + 1e-9))
    tree = hard_negatives.Tree(rows, top)
    ids = np.arange(4000)
    ints, ranges = tree.stored()
    block = hard_negatives.Block(8, ids[tree.order].astype("<i8").tobytes(), np.zeros(4000, "<i8").tobytes(), hard_negatives.packed(rows[tree.order]), ints, ranges, top)
    asked = rows[:50]
    scores = (asked @ rows.T).astype(int)
    own = np.sort(scores, 1)[:, -40]
    least, most = (own * 0.99).astype(np.int64)[:, None], own.astype(np.int64)[:, None]
    size = (asked ** 2).sum(1)
    seen = defaultdict(set)

    def leaf(start, end, alive):
        for q in alive:
            seen[q] |= set(block.ids[start:end].tolist())

    compared = block.descend(asked, size, lambda: hard_negatives.radius(least[:, 0], size, top, True), lambda: hard_negatives.radius(most[:, 0], size, top, False), leaf)
    assert compared < 50 * 4000 / 4
    for q in range(50):  # whatever lies in the annulus has been looked at
        assert set(np.flatnonzero((scores[q] >= least[q]) & (scores[q] <= most[q])).tolist()) <= seen[q]


def test_products_beyond_doubles():
    a = np.array([[2.0 ** 40, 1.0], [2.0 ** 60, 2.0 ** 60]])
    b = np.array([[2.0 ** 20, 3.0], [2.0 ** 60, -(2.0 ** 60)]])
    got = hard_negatives.products(a, b)
    assert got[0, 0] == 2 ** 60 + 3 and got[1, 1] == 0 and got[0, 1] == hard_negatives.MOST


# 12 MinHash near copies -----------------------------------------------------------------------------------------------

def plain_components(texts, size, least):
    sets = []
    for t in texts:
        w = (t or "").encode("utf-8", "replace").lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= least * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(sets))]


def expected_report(rows, size=3, least=85):
    sets, groups = plain_components([t for _, t in rows], size, least)
    smallest = defaultdict(list)
    for (i, _), g in zip(rows, groups):
        smallest[g].append(i)
    first = {g: min((i for i in own if i is not None), default=None) for g, own in smallest.items()}
    return sorted([(i, len(s), first[g], i is not None and i == first[g]) for (i, _), s, g in zip(rows, sets, groups)], key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "other", 1, 2) for i, t in rows], "doc_id long, text string, TEXT string, row long, n long")


def test_query_of_minhash_duplicates(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted_rows(QUERIES["op12_minhash_duplicates"][0](spark, SMALL)) == expected_report(rows)


def test_minhash_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "two one"), (7, "a b c d"), (8, long), (9, long + " more"), (9, long + " more"),
            (None, "a b c d"), (None, "alone here"), (10, "same same same same same"), (11, "same same same"), (12, "Ünï cödé wörds"), (13, "ünï cödé wörds")]
    assert sorted_rows(minhash.near_duplicates(table_of(spark, rows))) == expected_report(rows)
    assert minhash.near_duplicates(table_of(spark, rows).where("false")).count() == 0


def crowd(count, seed, least=1, most=30):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(count):
        w = [f"w{i}" for i in range(300)]
        for i in rng.integers(0, 300, rng.integers(least, most)):
            w[i] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("block", [8, 1000])
def test_crowded_groups_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "KEY_BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(enumerate(crowd(150, 3)))
    expected = expected_report(rows)
    assert 1 < sum(r[3] for r in expected) < 140
    assert sorted_rows(minhash.near_duplicates(table_of(spark, rows))) == expected


def test_estimates_and_bands_reach_the_threshold():
    rng = np.random.default_rng(7)
    rule = minhash.DEFAULT
    low, shared, n = [], 0, 400
    for _ in range(n):  # pairs just at 0.85: 340 shared of 400
        words = [f"v{x}".encode() for x in rng.integers(0, 1 << 60, 400)]
        sets = [set(words[:370]), set(words[:340] + words[370:])]
        hashes = [np.fromiter(map(minhash._hash, s), np.uint64) for s in sets]
        mins = [minhash.minima(h, rule.bands * rule.rows) for h in hashes]
        bands = [m.reshape(rule.bands, rule.rows) for m in mins]
        shared += bool((bands[0] == bands[1]).all(1).any())
        bits = [minhash.planes(m).view(np.uint64) for m in mins]
        low.append(minhash.fitting(rule, 370, bits[0], np.array([370]), bits[1][None])[0])
    assert shared == n and all(low)


# 13 conversation repair -----------------------------------------------------------------------------------------------

def plain_repairs(rows):
    """Expected report of damaged and repaired conversations, by a plain search from the end over (row, role state)."""
    talks = {}
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        own += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return {conv: plain_repair(own) for conv, own in talks.items()}


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        marks.append((role[:1], fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, turn, rest):
            if rest is not None:
                options.append((cost + rest[0], edit + rest[1], ((turn,) if turn else ()) + rest[2]))

        if i < len(rows):
            initial, fault = marks[i]
            add(3, "D", None, best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                late = 1 if fault == "truncated" else 0
                if (state, initial) in follows:
                    add(late, "K", rows[i][1:], best(i + 1, follows[state, initial], 0))
                for role in ("user", "assistant"):
                    if (state, role[0]) in follows:
                        add(2 + late, "R", (role, rows[i][2]), best(i + 1, follows[state, role[0]], 0))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in follows:
                    add(2, "I", (role, ""), best(i, follows[state, role[0]], inserted + 1))
        return min(options, key=lambda o: o[:2], default=None)

    cost, audit, turns = best(0, "", 0)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def talk_table(spark, rows):
    return spark.createDataFrame([(*r, "other", 1) for r in rows], "conv_id long, turn long, role string, text string, ROLE string, pos long")


def report(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_of_conversation_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(QUERIES["op13_conversation_repair"][0](spark, SMALL)) == plain_repairs(rows)


def random_talks(seed, count, longest, first=0):
    """Rows with different turns, so that their order is never open."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = []
    for conv in range(first, first + count):
        turns = rng.choice(3 * longest, int(rng.integers(1, longest)), replace=False).tolist()
        if rng.random() < 0.2:
            turns.append(None)
        rows += [(conv, t, pick(["user", "assistant", "system", "tool", "", None, "ua", "System"]), pick(["Hi.", "Hi", " \n", "", None, "What?  ", "ok!", "é? "])) for t in turns]
    return rows


@pytest.mark.parametrize("bits", [2, 10])
def test_repair_of_odd_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rows = random_talks(bits, 150, 14) + [(None, 1, "user", "q?"), (None, 2, "assistant", "a."), (900, -(1 << 62), "user", "x."), (900, 1 << 62, "assistant", "y.")]
    rows += [(901, t, "user", "same text.") for t in range(40)] + [(902, 5, "user", "the same row.")] * 6 + [(903, 1, "system", "x" * 100_000)]
    assert report(conversations.repair(talk_table(spark, rows))) == plain_repairs(rows)
    assert conversations.repair(talk_table(spark, rows).where("false")).count() == 0


def test_agenda_equals_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        rows = [(i, ["user", "assistant", "system", "x"][int(rng.integers(4))], ["a.", "b", " ", "c!"][int(rng.integers(4))] + str(i) * int(rng.integers(2))) for i in range(int(rng.integers(0, 9)))]
        expected = plain_repair(rows)
        seen, symbols = set(), ""
        for _, role, text in rows:
            code = role[0]
            bare = text.strip()
            if not bare or (role, text) in seen:
                code = dict(zip("suax", "0123"))[code]
            elif bare[-1] not in ".!?":
                code = code.upper()
            seen.add((role, text))
            symbols += code
        ends = [g for g in (conversations.lightest(symbols, conversations.NOTHING)[e] for e in conversations.ENDS) if g]
        assert min(ends) == expected[5:7]


def test_repaired_turns_of_a_long_conversation_are_spread(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 3)
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t}.") for t in range(200)] + [(2, 0, "assistant", "only")]
    turns = conversations.repaired(talk_table(spark, rows)).orderBy("conv_id", "segment", "place").collect()
    roles = "".join(r["role"][0] for r in turns if r["conv_id"] == 1)
    assert re.fullmatch("(s?(ua)+)?", roles) and len({r["segment"] for r in turns}) > 20
    whole = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == 1)
    told = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair_report(talk_table(spark, rows)).collect()}
    assert told[1] == hashlib.sha256(whole.encode()).hexdigest()
