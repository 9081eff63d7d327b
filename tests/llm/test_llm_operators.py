"""Operators of the llm subpackage against plain versions on small tables, with odd rows of every kind."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck
from zocalo.llm import cascade, components, golay, language, mixing, near_copies, neighbours, packing, pieces, pii, quality, simhash, suffix_tree, tokens
from zocalo.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "The first sentence is short. Another follows, with 12 words or so in it!\n" * 400 + "x" * 9000
TEXTS = [None, "", "   \n\t ", "one", "Hello there. General note: mail ann.lee@site.example.org or +1 (517) 555-5141, 10.0.0.1!", LONG,
         "same same same same", "same same same same", "Ünïcödé wörds — and 中文 字符。\x00 \x1c! a", "<|endoftext|> in text", "a  b\n\nc "]
DOC_SCHEMA = "doc_id long, text string, TEXT string, lang string, source string, n_chars long, size long, fp long, row long, target double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blank, long, repeated and strange texts, and columns whose names clash."""
    rows = [(i, t, "other", "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, 1, 2, 3, 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r[1] or "") for r in df.toDF(*[c if i != 2 else "other_text" for i, c in enumerate(df.columns)]).collect()]


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    run, sql = QUERIES[name]
    ok, info = compare(spark, duck(SMALL), name, run, sql, SMALL)
    assert ok, info


def test_all_are_registered():
    assert {re.match(r"op(\d+)_|pipeline", n)[0] for n in QUERIES} == {f"op{i}_" for i in range(1, 14)} | {"pipeline"}


# 1 packing ------------------------------------------------------------------------------------------------------------

def plain_cost(position, penalty, window):
    best = [0] + [math.inf] * (len(position) - 1)
    for j in range(1, len(position)):
        for i in range(j):
            n = position[j] - position[i]
            if n <= window:
                pad = 0 if n & (n - 1) == 0 and n >= 256 else window - n
                best[j] = min(best[j], best[i] + pad + penalty[j])
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(20):
        position = np.concatenate([[0], np.cumsum(rng.integers(1, 200, 150))])
        penalty = rng.choice([0, 3, 40], len(position))
        cuts = packing.best_cuts(position, penalty, 1024)
        at = position[cuts]
        cost = sum(penalty[j] for j in cuts[1:]) + sum(0 if n & (n - 1) == 0 and n >= 256 else 1024 - n for n in np.diff(at).tolist())
        assert at[0] == 0 and at[-1] == position[-1] and np.diff(at).max() <= 1024
        assert cost == plain_cost(position.tolist(), penalty.tolist(), 1024)


def check_packing(rows, texts):
    encoder = pieces.load(BPE)
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
    copies = Counter(texts)
    for (doc_id, text), times in copies.items():
        ids = np.array(encoder.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == times * len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_packing_holds_every_id_once(odd, none, docs):
    check_packing(packing.pack(odd, BPE).collect(), texts_of(odd))
    rows = packing.pack(docs, BPE).collect()
    check_packing(rows, texts_of(docs))
    total = Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in total.values())
    assert padded < 0.02 * sum(total.values())
    assert packing.pack(none, BPE).count() == 0


def test_blocks_carry_over(docs):
    encoder = pieces.byte_bpe(BPE)
    packer = packing.Packer(*packing.token_marks(encoder.tokenizer), 0, block=5000)
    rows = []
    texts = texts_of(docs)[:60]
    for doc_id, text in texts:
        for part in packer.add(doc_id, np.append(np.frombuffer(encoder.ids(text), "<u4"), np.uint32(1))):
            rows += part
    for part in packer.finish():
        rows += part
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_packing([dict(zip(names, r)) for r in rows], texts)


# 2 token counts -------------------------------------------------------------------------------------------------------

ODD_TEXTS = ["a  b", " x", "x ", "a\n\nb", "\n", "a \nb", "don't! \x1cb", "!\x1c! 3.14", "<|endoftext|> hi<|startoftext|>x", "é ́ ΑΣΣ x", "a b\x0b　c",
             "###!! $$\x00 1,2;3", "'s 't 'S we're", "", "中文 字符。好", "İ İx"]


def test_runs_and_chunks_equal_whole_encoding(docs):
    ids, counts = pieces.byte_bpe(BPE), pieces.run_counts(WORD_BPE)
    for text in [t for _, t in texts_of(docs)[:80]] + ODD_TEXTS:
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        n = len(counts.tokenizer.encode(text, add_special_tokens=False).ids)
        assert counts.count(text) == n
        assert tokens.chunked_count(counts.tokenizer, text, 37, 5) == n


def test_runs_equal_whole_encoding_without_the_twin(docs):
    ids = pieces.ByteBpeIds(BPE)
    assert ids.twin is not None
    ids.twin = None
    for text in [t for _, t in texts_of(docs)[:80]] + ODD_TEXTS:
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_widen_where_nothing_is_stable():
    tokenizer = pieces.load(WORD_BPE)
    text = "start " + "abc" * 400 + " end"
    assert tokens.chunked_count(tokenizer, text, 64, 8) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts(odd, none):
    tokenizer = pieces.load(WORD_BPE)
    expected = sorted((i if i is not None else -1, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(odd))
    got = tokens.count_tokens(odd, WORD_BPE, chunk=4096).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert tokens.count_tokens(none, WORD_BPE).count() == 0


# 3 personal data ------------------------------------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_plain_patterns(docs):
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("ab@.-+ 0123456789()%\n١"), 60)) for _ in range(4000)]
    for text in noise + [t for _, t in texts_of(docs)] + ["1.2.3.4.5.6.7.8", "0001.2.3.4", "1.2.3.4@a.b.c@d.e", "a@b@c.d"]:
        assert pii.base_spans(text) == plain_spans(text)


def test_numbers_that_int_refuses():
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS,) * 2), np.zeros((pii.LABELS,) * 2))
    long = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(long) == [(0, 1, len(long))]
    assert pii.base_spans("0" * 5000 + "256.1.1.1") == []
    assert [b for b, _ in pii.all_spans([long, "1.².³.²"], field)] == [[(0, 1, len(long))], []]


def test_repeated_mentions_take_the_label(docs):
    field = pii.training_field(docs)
    text = "card 4284250577320971 and far away 4284.2505.7732.0971; version 10.2.3 of 2024-01-02"
    (base, every), = pii.all_spans([text], field)
    assert [text[a:b] for a, _, b in base] == ["4284250577320971"]
    assert [text[a:b] for a, _, b in every] == ["4284250577320971", "4284.2505.7732.0971"]
    assert pii.masked(text, every) == "card <card> and far away <card>; version 10.2.3 of 2024-01-02"


@pytest.mark.parametrize("bare", [1, 10, 50, 400])
def test_every_repeat_takes_the_label(docs, bare):
    field = pii.training_field(docs)
    repeats = " ".join(["and far away 4284.2505.7732.0971; then"] * bare)
    for text in (f"card 4284250577320971 {repeats}", f"{repeats} card 4284250577320971"):
        (base, every), = pii.all_spans([text], field)
        assert len(base) == 1 and len(every) == 1 + bare and {k for _, k, _ in every} == {2}


def test_message_passing_equals_enumeration():
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=(pii.LABELS,) * 2))
    features = rng.integers(0, 2, (3, pii.FEATURES)).astype(float)
    chain, skip = np.array([[0, 1]]), np.array([[1, 2]])  # without a loop, messages are exact
    p = pii.beliefs(field, features, np.zeros(3, int), chain, skip, rounds=60)
    own = features @ field.node
    z = own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :] + field.chain[:, :, None] + field.skip[None]
    z = np.exp(z - z.max())
    z /= z.sum()
    assert np.allclose(p, [z.sum((1, 2)), z.sum((0, 2)), z.sum((0, 1))], atol=1e-6)


@pytest.mark.parametrize("mentions", [50, 300])
def test_labels_reach_the_end_of_a_long_chain(mentions):
    node = np.zeros((pii.FEATURES, pii.LABELS))
    node[0, 0] = 0.02
    field = pii.Field(node, np.zeros((pii.LABELS,) * 2), 9.0 * np.eye(pii.LABELS))
    features = np.zeros((mentions, pii.FEATURES))
    features[:, 0] = 1
    fixed = np.zeros(mentions, int)
    fixed[0] = 3
    links = np.stack([np.arange(mentions - 1), np.arange(1, mentions)], 1)
    p = pii.beliefs(field, features, fixed, links, links)
    step = np.exp(field.skip)
    ahead, behind = [np.eye(pii.LABELS)[3]], [np.ones(pii.LABELS)]
    for _ in range(mentions - 1):
        ahead.append((ahead[-1] @ step) * np.exp(node[0]))
        behind.append(step @ (behind[-1] * np.exp(node[0])))
        ahead[-1] /= ahead[-1].sum()
        behind[-1] /= behind[-1].sum()
    exact = np.array(ahead) * np.array(behind[::-1])
    assert np.allclose(p, exact / exact.sum(1, keepdims=True), atol=1e-3)
    assert mentions > 50 or p[:, 3].min() > pii.ADD_AT


def test_texts_do_not_change_each_other(docs):
    field = pii.training_field(docs)
    texts = [t for _, t in texts_of(docs)][:40]
    assert pii.all_spans(texts, field) == [pii.all_spans([t], field)[0] for t in texts]


def test_personal_data_rows(odd, none, spark):
    got = pii.find_personal_data(odd).collect()
    assert len(got) == odd.count()
    texts = dict(texts_of(odd))
    for r in got:
        base = plain_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r["spans"].split(","))
    assert pii.find_personal_data(none).count() == 0
    clean = pii.without_personal_data(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert not any(plain_spans(t) for _, t in texts_of(clean))


# 4 quality, 8 language ------------------------------------------------------------------------------------------------

def test_quality_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_classifier"][0](spark, path).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = lambda q: np.mean([r["predicted"] for r in rows if labels[r["doc_id"]] == q])
    assert kept(1) > 0.95 and kept(0) < 0.3


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 0), (3, 1, 0), (4, None, 1), (None, 1, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify_quality(odd, labels).count() == odd.count()
    assert quality.classify_quality(none, labels).count() == 0
    even = quality.classify_quality(odd, labels.where("false")).collect()
    assert len(even) == odd.count() and all(0 <= r["score"] <= 1 for r in even)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language.identify(docs).collect() if r["held_out"]]
    assert np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert language.identify(odd).count() == odd.count()
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.known_language(odd)
    assert kept.columns == odd.columns and {None, 3, 4} - set(r["doc_id"] for r in kept.collect()) <= {None}


def test_rare_languages_are_learned_and_unknown_scripts_go(spark, docs):
    rows = [(i, t, lang) for i, t, lang in docs.select("doc_id", "text", "lang").toLocalIterator() if t and lang]
    rare = [(10_000 + i, f"õhtul läksime järve äärde ja võtsime kaasa {i} õuna ning käsitöö", "et") for i in range(3)]
    unknown = [(20_000 + i, "北京的秋天很美，香山的红叶吸引了许多游客。我们明天去图书馆看书。" * 3, None) for i in range(2)]
    table = spark.createDataFrame(rows + rare + unknown, "doc_id long, text string, lang string")
    # of 4 documents the rare language would have less than a tenth
    assert "et" in language.fit(table, 4).langs
    kept = {r["doc_id"] for r in language.known_language(table).collect()}
    assert not kept & {i for i, _, _ in unknown}
    assert len(kept) >= 0.99 * len(rows)


# 5 mixing, 10 cascade -------------------------------------------------------------------------------------------------

def test_mixing_odd_rows(odd, none):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[2] == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(odd).collect()))
    assert mixing.mix_report(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in texts_of(mixed)) == sum(r["taken"] for r in rows)


def test_targets_share_all_words_by_weight(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1000), (None, 10), ("d", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    # b (weight 2) and null (weight 2) stop at three times their size, d (weight 1) at nothing; a and c have weights 1 and 3
    share = (1111 - 3 - 30) / 4
    assert got == {"a": pytest.approx(share), "b": 3.0, "c": pytest.approx(3 * share), "d": 0.0, None: 30.0}


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {j for i, x in enumerate(windows) if many[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_ones(odd, none, docs):
    for table in (odd, docs):
        expected = sorted((-1 if i is None else i, *plain_measures(t)) for i, t in texts_of(table))
        got = cascade.rule_cascade(table).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:6]) for r in got) == expected
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert cascade.rule_cascade(none).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(docs):
    rules = cascade.default_rules()
    found = [cascade.RuleEstimate(r.name, 1.0 + i, 0.1 if r.name != "symbols" else 0.9) for i, r in enumerate(rules)]
    assert [r.name for r in cascade.ordered(rules, found)][:2] == ["symbols", "few_words"]  # 0.9 in 4 s, 0.1 in 1 s
    assert {e.name for e in cascade.estimate(cascade.measures(docs), rules)} == {r.name for r in rules}


# 6 neighbours ---------------------------------------------------------------------------------------------------------

def plain_nearest(vectors, k, step):
    out = []
    for q, x in vectors:
        if q % step == 0:
            near = sorted((-(float((x * y).sum()) / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in vectors if i != q and len(y) == len(x))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(near[:k])]
    return out


def test_nearest_equal_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    vectors = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(table).collect())
    expected = sorted(plain_nearest(vectors, 5, 50))
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert np.allclose([x[3] for x in got], [x[3] for x in expected], atol=1e-12)


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [-1e-200, 0.0]), (50, [1.0, 1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, query_id int, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.search(table).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 10, -1.0), (50, 1, 9, round(2 / math.sqrt(6), 9))]
    assert neighbours.search(table.where("false")).count() == 0


def test_nearest_of_a_table_with_itself(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    # thrice in one block, so that the repeats of two ids would fill the five places
    thrice = spark.createDataFrame(sorted(rows * 3, key=lambda r: r[0]), "vec_id long, embedding array<double>").coalesce(1)
    expected = sorted(plain_nearest([(i, np.array(v, float)) for i, v in rows], 5, 50))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(thrice).collect())
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert np.allclose([x[3] for x in got], [x[3] for x in expected], atol=1e-12)


def test_tiles_leave_out_only_what_bounds_rule_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    side = lambda a, b: neighbours.Side(16, np.arange(a, b).astype("<i8").tobytes(), x[a:b].astype("<f8").tobytes())
    q, c = side(0, 20), side(20, 300)
    pairs = 0
    for place, at, scores in neighbours.tile(q, c, 5, np.full(20, -np.inf)):
        every = (c.vectors * q.vectors[place]).sum(1) / (c.norm * q.norm[place])
        assert set(np.argsort(-every)[:5]) <= set(at.tolist())
        pairs += len(at)
    assert pairs < 20 * 280 / 4


# 7 near-duplicates ----------------------------------------------------------------------------------------------------

def plain_components(prints, max_bits=3):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return [find(v) for v in prints]


def test_golay_tables():
    nearest, listed = golay.near_errors()
    assert np.bitwise_count(nearest).max() == 3 and (listed >= 0).sum(1).max() == 6
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 5000)
    for bit in range(23):
        assert (golay.listed_indices(words) == golay.nearest_index(words ^ (1 << bit))[:, None]).any(1).all()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 62, 5000)
    y = x.copy()
    for _ in range(3):
        y ^= np.left_shift(np.int64(1), rng.integers(0, 64, len(x)))
    filed, _ = simhash.segment_keys(x)
    _, looked = simhash.segment_keys(y)
    assert (filed[:, :, None] == looked[:, None, :]).any((1, 2)).all()


def plain_fingerprint(text):
    import xxhash
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_equal_brute_force(docs, odd, none):
    for table in (docs, odd):
        ids, prints = zip(*[(i, plain_fingerprint(t)) for i, t in texts_of(table)])
        least = defaultdict(list)
        for i, c in zip(ids, found := plain_components(prints)):
            least[c] += [i] if i is not None else []
        expected = sorted((str(i), f"{p:016x}", str(min(least[c], default=None))) for i, p, c in zip(ids, prints, found))
        got = simhash.near_duplicates(table).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected
        kept = simhash.without_near_duplicates(table)
        assert kept.columns == table.columns and kept.count() == len(set(found))
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0


def test_dense_group_of_fingerprints(spark):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 1 << 62))
    near = {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 500)}
    prints = sorted(near | far)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(table)
    assert edges.count() < 70 * len(near)
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    groups = plain_components(prints)
    by = defaultdict(set)
    for p, g in zip(prints, groups):
        by[g].add(roots.get(p, p))
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(roots.get(i, i) == 0 for i in range(61)) and roots[101] == 100
    assert components.components(edges.where("false")).count() == 0


def plain_copies(texts):
    """Group of each text by the Jaccard similarity of its five-word shingles."""
    sets = []
    for t in texts:
        w = t.encode("utf-8", "replace").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else {()})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_no_near_copies_stay(docs, odd, none):
    for table in (docs, odd):
        ids, texts = zip(*texts_of(table))
        least = defaultdict(list)
        for i, g in zip(ids, plain_copies(texts)):
            least[g].append(math.inf if i is None else i)
        kept = near_copies.without_near_copies(table)
        assert kept.columns == table.columns
        assert sorted(math.inf if r is None else r for r, _ in texts_of(kept)) == sorted(min(x) for x in least.values())
    assert near_copies.without_near_copies(none).count() == 0


@pytest.mark.parametrize("group", [2, 64])
def test_crowded_keys_lose_no_copy(spark, group):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(120):
        w = list(base)
        for i in rng.integers(0, 300, rng.integers(1, 12)):
            w[i] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = {}
    for i, g in enumerate(plain_copies(texts)):
        least.setdefault(g, i)
    assert 1 < len(least) < 60
    assert sorted(r["doc_id"] for r in near_copies.without_near_copies(table, group).collect()) == sorted(least.values())


# 9 language-model scores ----------------------------------------------------------------------------------------------

def test_base_scores_equal_plain_counts(docs, odd, none):
    for table in (docs, odd):
        texts = [(i, t.encode().lower().split() + [b"\n"]) for i, t in texts_of(table)]
        held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
        c = Counter(w for i, x in texts if not held(i) for w in x)
        n, v = sum(c.values()), len(c)
        expected = sorted((str(i), held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for i, x in texts)
        got = suffix_tree.lm_scores(table).collect()
        assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == expected
        assert all(r["score"] < 0 for r in got)
    assert suffix_tree.lm_scores(none).count() == 0


def small_tree(texts, gain=1.0):
    grams = np.concatenate([suffix_tree.gram_keys(d, v) for d, v, _, _ in suffix_tree.streams(texts)])
    u, n = np.unique(grams, return_counts=True)
    entries, totals = {}, {}
    for d in range(suffix_tree.DEPTH + 1):
        k, at = np.unique(u & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        entries[d] = (k, np.bincount(at, n))
        own, at = np.unique(k >> 8, return_inverse=True)
        totals[d] = (own, np.bincount(at, entries[d][1]))
    return suffix_tree.build_tree(entries, totals, gain)


def test_tree_scores_equal_a_plain_walk(docs):
    texts = [suffix_tree.canonical(simhash.words(t)) for _, t in texts_of(docs)[:60]]
    tree = small_tree(texts)
    assert np.allclose((10.0 ** tree.logp[:, :-1]).sum(1) + 10.0 ** tree.logp[:, -1] * (tree.alphabet == len(tree.logp[0]) - 1).sum(), 1, atol=1e-3)
    for text in texts[:20] + [b"\n", b"zz\xff\n"]:
        state, total = 0, 0.0
        for b in bytes([9]) * suffix_tree.DEPTH:
            state = tree.step[state, tree.alphabet[b]]
        for b in text:
            total += float(tree.logp[state, tree.alphabet[b]])
            state = tree.step[state, tree.alphabet[b]]
        assert tree.scores([text])[0] == pytest.approx(total, abs=1e-3)
    assert np.allclose(tree.scores(texts), [tree.scores([t])[0] for t in texts])


def test_contexts_need_divergence():
    same = small_tree([b"ab" * 200 + b"\n"] * 3, gain=1e12)
    assert len(same.step) == 1
    assert small_tree([b"ab" * 200 + b"\n"] * 3).scores([b"abab\n"])[0] > same.scores([b"abab\n"])[0]


# pipeline -------------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frame, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SMALL)
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        seen[name] = frame
        if name != "packing":
            assert frame.columns == docs.columns
    assert seen["near_duplicates"].count() == len(set(plain_copies([t for _, t in texts_of(seen["language"])])))
    assert not any(plain_spans(t) for _, t in texts_of(seen["personal_data"]))
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_report(seen["personal_data"]).collect()}
    counts = Counter(i for i, _ in texts_of(seen["mixing"]))
    assert all(counts[i] * size == n for (i, size), n in taken.items())
    check_packing(seen["packing"].collect(), texts_of(seen["mixing"]))
