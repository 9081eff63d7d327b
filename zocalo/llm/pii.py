"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to other mentions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, numbered_columns, unit_hash

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans. Digit runs are taken from their start, which finds the same matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: About how many documents the weights are fitted on, change (in nats) below which a message rests, belief from which a span is added.
TRAIN_ROWS, SETTLED, ADD_AT = 2000, 1e-5, 0.9
#: Documents with linked base spans are sought among so many times as many, since few have any.
LINKED_SHARE = 8
#: Longest text, in characters, that the field is fitted on; spans are sought in whole texts.
TRAIN_CHARS = 1 << 18
#: Share of labelled mentions whose validity is hidden in training, so that context and repeats get weight too.
HIDDEN = 0.3
LABELS = len(KINDS) + 1  # 0: none
#: Agreement along skip links before anything is learned, and how strongly it is held on to, in links.
AGREE, SKIP_PRIOR = 5.0, 0.02
WORDS = 32  # buckets of the word in front
FEATURES = 22 + WORDS
VALIDITY = (1, 2, 3, 4)

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @, from where the last match ended, and a domain behind it."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; offsets in code points, ends exclusive."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])+")
_EDGE = "()[]{}<>\"'.,;:!?"


@dataclass
class Mentions:
    """The tokens of one text that could be personal data: base spans, and all other tokens with a digit or @."""

    spans: list[tuple[int, int]]
    kinds: list[int]  # label of a base span, 0 for others
    features: np.ndarray  # mentions x FEATURES, 0 and 1
    links: list[tuple[int, int]]  # repeated or similar mentions


def mentions(text: str, base: list[tuple[int, int, int]]) -> Mentions:
    """Base spans cover what they touch; of spans that overlap, the first is the mention. Work is linear in the text.

    A mention is linked to the one before with the same key, and to the first base span of each kind with that key, before or
    behind it: so it hears of a base span at first hand, whatever the number of mentions between.
    """
    nodes: list[tuple[int, int, int]] = []
    end = -1
    for a, kind, b in base:
        if a >= end:
            nodes.append((a, b, kind + 1))
            end = b
    taken, cursor, free, i = sorted(nodes), 0, [], 0
    covered = [(a, b) for a, _, b in base]
    while m := _MARK.search(text, cursor):
        p = m.start()
        while i < len(covered) and covered[i][1] <= p:
            i += 1
        if i < len(covered) and covered[i][0] <= p:
            cursor = covered[i][1]
            continue
        low = max(cursor, max((text.rfind(c, cursor, p) for c in " \n\t\r")) + 1)
        space = _SPACE.search(text, p)
        high = space.start() if space else len(text)
        number = _NUMBER.match(text, p - 1 if p > low and text[p - 1] in "+(" else p)
        if number and not any(c.isalpha() or c == "@" for c in text[low:high]):
            low, high = number.start(), max(number.end(), p + 1)
        if i < len(covered):
            high = min(high, covered[i][0])
        while low < p and text[low] in _EDGE and text[low] != "(":
            low += 1
        while high > p + 1 and (text[high - 1] in _EDGE or text[high - 1].isspace()):
            high -= 1
        free.append((low, high, 0))
        cursor = max(high, p + 1)
    nodes = sorted(taken + free)
    features = np.zeros((len(nodes), FEATURES), np.float32)
    links: list[tuple[int, int]] = []
    last: dict[tuple[str, str], int] = {}
    same: dict[tuple[str, str], list[int]] = {}
    for n, (a, b, _) in enumerate(nodes):
        own = text[a:b]
        digits = _NOT_DIGIT.sub("", own)
        lower = own.lower()
        letters = any(c.isalpha() for c in own)
        size = len(digits)
        row = features[n]
        row[0] = 1
        row[1] = "@" in own and "." in own[own.find("@") + 1:]
        row[2] = own.count(".") == 3 and not letters and all(p.isdecimal() and len(p) < 4 and int(p) <= 255 for p in own.split("."))
        row[3] = not letters and 12 <= size <= 19 and luhn(digits)
        row[4] = own[:1] == "+" and 9 <= size <= 15
        row[5], row[6], row[7] = "@" in own, letters, "." in own
        row[8 + (0 if size == 0 else 1 if size < 4 else 2 if size < 9 else 3 if size < 12 else 4 if size < 20 else 5)] = 1
        row[14], row[15], row[16], row[17] = "-" in own, " " in own, "(" in own, own[:1] == "+"
        row[18], row[19], row[20], row[21] = "=" in own, "/" in own, "_" in own, b - a > 24
        before = text[max(0, a - 24):a].split()
        word = before[-1].lower().strip(_EDGE) if before else ""
        row[22 + sum(word.encode()) % WORDS] = 1
        keys = []
        if size >= 7 and not letters:
            keys += [("all digits", digits), ("last digits", digits[-10:])]
        if letters or "@" in own:
            keys.append(("token", lower))
            local = lower.split("@")[0]
            if len(local) >= 4:
                keys.append(("name", local))
        for key in keys:
            if (k := last.get(key)) is not None and (k, n) not in links[-2:]:
                links.append((k, n))
            last[key] = n
            same.setdefault(key, []).append(n)
    made = set(links)
    for places in same.values():
        anchors: dict[int, int] = {}
        for n in places:
            if nodes[n][2]:
                anchors.setdefault(nodes[n][2], n)
        for n in places if anchors else ():
            for k in anchors.values():
                link = (min(k, n), max(k, n))
                if k != n and link not in made:
                    made.add(link)
                    links.append(link)
    return Mentions([(a, b) for a, b, _ in nodes], [k for _, _, k in nodes], features, links)


@dataclass(frozen=True)
class Field:
    """Weights of the random field: per feature and label, and per pair of labels along the chain and along skip links."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(texts: list[Mentions]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, chain edges and skip edges of several texts as one graph without edges between texts."""
    features = np.concatenate([m.features for m in texts]) if texts else np.zeros((0, FEATURES), np.float32)
    labels = np.array([k for m in texts for k in m.kinds], np.int64)
    chain, skip, first = [], [], 0
    for m in texts:
        n = len(m.spans)
        chain += [(i, i + 1) for i in range(first, first + n - 1)]
        skip += [(first + a, first + b) for a, b in m.links]
        first += n
    pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return features, labels, pairs(chain), pairs(skip)


def beliefs(field: Field, features: np.ndarray, fixed: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Probability of each label for each mention by loopy message passing; mentions with a label > 0 in ``fixed`` keep it.

    Messages are damped by half and passed until none changes by SETTLED, however long the chains of links are; a round works
    only on messages that still move or whose senders heard something new. Loops need not settle: without ``rounds``, the
    messages of a text end after rounds in proportion to its mentions, beyond what any path through it takes. Memory is linear in
    mentions and links.
    """
    own = features @ field.node
    own[fixed > 0] = -50.0
    own[fixed > 0, fixed[fixed > 0]] = 0.0
    sources = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    targets = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    back = np.concatenate([np.arange(len(chain)) + len(chain), np.arange(len(chain)), np.arange(len(skip)) + 2 * len(chain) + len(skip),
                           np.arange(len(skip)) + 2 * len(chain)])
    pair = np.stack([field.chain, field.chain.T, field.skip, field.skip.T])
    kind = np.repeat(np.arange(4), [len(chain), len(chain), len(skip), len(skip)])
    # mentions that follow each other along the chain are one text
    begins = np.ones(len(own), bool)
    begins[chain[:, 1]] = False
    text = np.cumsum(begins) - 1
    last = 100 + 6 * np.bincount(text)[text[sources]] if rounds is None else np.full(len(sources), rounds)
    message = np.zeros((len(sources), LABELS))
    sent = message.copy()  # as it was when its target last took notice
    total = own.copy()
    live, done = np.arange(len(sources)), 0
    while len(live := live[last[live] > done]):
        old = message[live]
        out = total[sources[live]] - message[back[live]]
        new = out[:, :, None] + pair[kind[live]]
        top = new.max(1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        moving = np.abs(new - old).max(1) >= SETTLED
        message[live] = np.where(moving[:, None], 0.5 * old + 0.5 * new, new)
        np.add.at(total, targets[live], message[live] - old)
        told = live[np.abs(message[live] - sent[live]).max(1) >= SETTLED]
        sent[told] = message[told]
        heard = np.zeros(len(own), bool)
        heard[targets[told]] = True
        again = heard[sources]
        again[live[moving]] = True
        live, done = np.flatnonzero(again), done + 1
    z = np.exp(total - total.max(1, keepdims=True)) if len(total) else total
    return z / z.sum(1, keepdims=True) if len(z) else z


def fit(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300, rate: float = 0.5,
        prior: float = 1e-3, seed: int = 0) -> Field:
    """Weights by gradient ascent of the pseudo-likelihood, with a weak Gaussian prior (around agreement along skip links).

    Base spans are the labels. Of every two linked ones, one (by lot) is dressed as a mention without a label, drawn from all those, as if
    it were not written as its pattern asks: its form then speaks against its label and only its links speak for it, which is
    what skip potentials have to outweigh. Of the others a share loses the features that say a pattern is complete. A mention without a
    label that is linked to a base span is what the field is there to judge: it is no evidence that links mean nothing, so it
    counts as unobserved.
    """
    rng = np.random.default_rng(seed)
    x = features.astype(float)
    linked = skip[(labels[skip] > 0).all(1)] if len(skip) else skip
    veiled = np.unique(linked[np.arange(len(linked)), rng.integers(0, 2, len(linked))]) if len(linked) else np.empty(0, np.int64)
    plain = np.flatnonzero(labels == 0)
    if len(plain):
        x[veiled] = x[rng.choice(plain, len(veiled))]
    hide = np.flatnonzero((labels > 0) & (rng.random(len(labels)) < HIDDEN))
    x[hide[:, None], list(VALIDITY)] = 0
    seen = np.ones(len(labels), bool)
    if len(skip):
        told = (labels[skip] > 0).any(1)
        ends = np.unique(skip[told])
        seen[ends[labels[ends] == 0]] = False
    agree = AGREE * np.eye(LABELS)
    field = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), agree.copy()]
    truth = np.eye(LABELS)[labels]
    weight = max(len(labels), 1)
    for _ in range(steps if len(labels) else 0):
        z = x @ field[0]
        for edges, w in ((chain, field[1]), (skip, field[2])):
            np.add.at(z, edges[:, 1], w[labels[edges[:, 0]]])
            np.add.at(z, edges[:, 0], w.T[labels[edges[:, 1]]])
        p = np.exp(z - z.max(1, keepdims=True))
        error = np.where(seen[:, None], truth - p / p.sum(1, keepdims=True), 0)
        # the skip weights go by the evidence of their own few links, not by that of all mentions
        sizes = (weight, weight, max(4 * len(linked), 1))
        moves = [x.T @ error - prior * weight * field[0]]
        for edges, w, mean, least in ((chain, field[1], 0.0, prior * weight), (skip, field[2], agree, SKIP_PRIOR)):
            g = np.zeros_like(w)
            np.add.at(g, labels[edges[:, 0]], error[edges[:, 1]])
            np.add.at(g.T, labels[edges[:, 1]], error[edges[:, 0]])
            moves.append(g - least * (w - mean))
        for w, g, size in zip(field, moves, sizes):
            w += rate * g / size
    return Field(*field)


def training_field(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Field:
    """Fitted on about ``rows`` documents with a digit or @ (those whose id's hash is below a threshold) of up to ``chars`` characters, and those
    of ``LINKED_SHARE`` times as many that hold linked base spans: documented bounds.
    """
    texts = exact(docs, doc_id="doc_id", text="text")
    share = min(1.0, rows / max(texts.count(), 1))
    draw = unit_hash(F.coalesce("doc_id", F.lit(0)), seed=3)
    sample = texts.where(draw < LINKED_SHARE * share).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= chars)).select("doc_id", "text", (draw < share).alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, t, drawn in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                m = mentions(t.as_py(), base_spans(t.as_py()))
                if not drawn and not any(m.kinds[i] and m.kinds[j] for i, j in m.links):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()], pa.int64()), pa.array([np.packbits(m.features.astype(bool)).tobytes()], pa.binary()),
                     pa.array([m.kinds], pa.list_(pa.int32())), pa.array([[i for e in m.links for i in e]], pa.list_(pa.int32()))],
                    names=["doc_id", "features", "kinds", "links"])

    found = sorted(sample.mapInArrow(run, "doc_id long, features binary, kinds array<int>, links array<int>").collect(),
                   key=lambda r: (r["doc_id"] or 0, bytes(r["features"])))
    parts = []
    for r in found:
        n = len(r["kinds"])
        bits = np.unpackbits(np.frombuffer(bytes(r["features"]), np.uint8))[:n * FEATURES].reshape(n, FEATURES)
        parts.append(Mentions([(0, 0)] * n, list(r["kinds"]), bits.astype(np.float32), list(zip(r["links"][::2], r["links"][1::2]))))
    return fit(*graph(parts))


def all_spans(texts: list[str], field: Field, add_at: float = ADD_AT) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    # A text without another mention beside its base spans has nothing to add.
    found = [mentions(t, b) if b or _MARK.search(t) else Mentions([], [], np.zeros((0, FEATURES), np.float32), []) for t, b in zip(texts, base)]
    features, fixed, chain, skip = graph(found)
    p = beliefs(field, features, fixed, chain, skip)
    out, first = [], 0
    for b, m in zip(base, found):
        own = p[first:first + len(m.spans)]
        first += len(m.spans)
        more = [(a, int(row.argmax()) - 1, e) for (a, e), kind, row in zip(m.spans, m.kinds, own) if not kind and row[0] < 0.5 and row.max() >= add_at]
        out.append((b, sorted(b + more)))
    return out


def find_personal_data(docs: DataFrame, train_rows: int = TRAIN_ROWS, add_at: float = ADD_AT) -> DataFrame:
    """One row per document: doc_id, counts of the base spans by kind, base_sha256, spans (base and added ones).

    Base spans come from the fixed patterns and always stay. Every other token with a digit or @ is a mention that the
    random field may give a kind: from its form, from the mentions beside it and, along skip links, from distant mentions of
    the same digits or name. Links join each mention to the one before with the same key and to the first base span of each
    kind with it, so they are linear in number.
    Null counts as empty: no spans, the digest of empty text. Repeated rows are judged each; an empty table gives an
    empty result; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(training_field(docs, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                spans = all_spans([t.as_py() or "" for t in part.column(1)], field.value, add_at)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in spans], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *counts, pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in spans]),
                     pa.array([written(every) for _, every in spans], pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return exact(docs, doc_id="doc_id", text="text").mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span as its kind in angle brackets; spans that overlap become one, of the first one's kind."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def without_personal_data(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents with every span of personal data masked; n_chars follows the new text, all other columns stay.

    Null texts stay null and blank ones as they are; spans that overlap become one; repeated rows are masked each; an empty table stays
    empty; columns whose names clash are kept.
    """
    field = docs.sparkSession.sparkContext.broadcast(training_field(docs, train_rows))
    flat, at = numbered_columns(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own = [t if isinstance(t, str) else "" for t in texts]
        new = []
        for a in range(0, len(own), 256):
            part = own[a:a + 256]
            new += [masked(t, s) for t, (_, s) in zip(part, all_spans(part, field.value))]
        return pd.Series([n if isinstance(t, str) else None for n, t in zip(new, texts)], dtype=object)

    text = at["text"]
    made = flat.withColumn(text, clean(F.col(text)))
    if "n_chars" in at:
        made = made.withColumn(at["n_chars"], F.length(text).cast(flat.schema[at["n_chars"]].dataType))
    return made.toDF(*docs.columns)
