"""Conversation structure repair: edits as weighted deductions, their lightest derivation found by an agenda."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, stored

#: Rows of a conversation that one agenda works on; the tables of longer conversations' segments are chained.
SEGMENT_BITS = 10
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What stands before: nothing, a system turn, an open user turn, a whole pair. A repaired conversation ends in the first or the last.
NOTHING, SYSTEM, OPEN, PAIR = range(4)
ENDS = (NOTHING, PAIR)
#: White space that does not make a text.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
NAMES = {"u": "user", "a": "assistant"}


def after(state: int, initial: str) -> int | None:
    """The state once a turn with this role initial has been added, or None where it may not follow."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return OPEN if state != OPEN else None
    return PAIR if initial == "a" and state == OPEN else None


def wanted(state: int) -> str:
    """The initial of the one role that an inserted or renamed turn can have here."""
    return "a" if state == OPEN else "u"


def lightest(symbols: str, start: int) -> list[tuple[int, str] | None]:
    """For each end state the least (cost, audit) that takes a run of rows from state ``start`` there; None where nothing does.

    Items are (rows used, state). The axiom is (0, start); from an item and a row's edit (keep, rename, delete) follows an item with one row more,
    from an item and an insertion one with as many. A consequence adds to the cost and appends to the audit, so it never comes
    before its premise in (cost, audit) order, and it keeps the order of two derivations of the same item: at equal cost neither audit is
    a beginning of the other, as the rows used are equal and each insertion costs. So what is popped is final, and each end state
    is done when it is popped. ``symbols`` has one letter a row: its role initial (x for any other), upper-case if the text is
    truncated, or a digit in place of s, u, a, x if the row must go.
    """
    done: set[tuple[int, int]] = set()
    goals: list[tuple[int, str] | None] = [None] * 4
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        needed = after(state, wanted(state))
        if (i, needed) not in done:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, needed))
        if i == len(symbols):
            goals[state] = (cost, audit)
            continue
        mark = symbols[i]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        if not mark.isdigit():
            price = cost + (TRUNCATED if mark.isupper() else 0)
            kept = after(state, mark.lower())
            if kept is not None:
                heapq.heappush(agenda, (price + KEEP, audit + "K", i + 1, kept))
            heapq.heappush(agenda, (price + REROLE, audit + "R", i + 1, needed))
    return goals


@lru_cache(maxsize=1 << 16)
def transitions(symbols: str) -> tuple:
    """``lightest`` of every start state."""
    return tuple(tuple(lightest(symbols, start)) for start in range(4))


class Chain:
    """Running lightest derivations over the segments of one conversation; audits are kept as shared lists of pieces."""

    def __init__(self):
        self.best: dict[int, tuple[int, tuple | None]] = {NOTHING: (0, None)}

    @staticmethod
    def smaller(x: tuple, y: tuple) -> bool:
        """Whether the audit of node ``x`` comes before that of ``y``; both are read back to where they part."""
        left, right = [], []
        while x is not y:
            for side, node in ((left, x), (right, y)):
                if node is not None:
                    side.append(node[1])
            x, y = (n and n[0] for n in (x, y))
        return "".join(reversed(left)) < "".join(reversed(right))

    def add(self, segment: int, costs: list, audits: list) -> None:
        following: dict[int, tuple[int, tuple]] = {}
        for state, (cost, node) in self.best.items():
            for end in range(4):
                more, audit = costs[4 * state + end], audits[4 * state + end]
                if more is None:
                    continue
                one = (cost + more, (node, audit, segment, state, more))
                held = following.get(end)
                if held is None or one[0] < held[0] or one[0] == held[0] and self.smaller(one[1], held[1]):
                    following[end] = one
        self.best = following

    def pieces(self) -> list[tuple[int, str, int, int]]:
        """(segment, audit, start state, cost) of the lightest whole derivation, in order."""
        ends = [self.best[e] for e in ENDS if e in self.best]
        least = ends[0]
        for other in ends[1:]:
            if other[0] < least[0] or other[0] == least[0] and self.smaller(other[1], least[1]):
                least = other
        node, out = least[1], []
        while node is not None:
            out.append((node[2], node[1], node[3], node[4]))
            node = node[0]
        return out[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as a noisy source would give them: by a hash of ``conv_id:turn`` rows are lost, emptied, stripped of
    sentence ends, repeated or given to the user. A null role or text is one blank; so is a null in what is hashed."""
    rows = exact(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the order of all conversations, written to the shared folder.

    Ranges of (conv_id, turn, hash of role and text) are dealt to tasks, so a very long conversation is spread over many; equal rows
    are told apart by their first place, so they can be spread too. Places rise with the order and are not dense.
    """
    keyed = rows.select("*", F.xxhash64("role", "text").alias("draw"), F.monotonically_increasing_id().alias("copy"))
    dealt = keyed.repartitionByRange("conv_id", "turn", "draw", "copy").sortWithinPartitions("conv_id", "turn", "draw", "role", "text")
    return stored(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "talk-rows")


def segment(pos: str = "pos") -> Column:
    return F.shiftright(pos, SEGMENT_BITS)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, symbol, blank, duplicate, truncated) of ordered rows; a row's first fault counts."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    seen = rows.select("conv_id", "pos", "turn", code.alias("code"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), digest.alias("digest"))
    firsts = seen.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    told = seen.drop("digest").join(firsts, "pos", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    goes = F.col("blank") | F.col("duplicate")
    truncated = ~goes & F.col("open")
    symbol = F.when(goes, F.translate("code", "suax", "0123")).when(truncated, F.upper("code")).otherwise(F.col("code"))
    return told.select("conv_id", "pos", "turn", symbol.alias("symbol"), "blank", "duplicate", truncated.alias("truncated"))


LEGAL = {"su", "ua", "au"}
PLAIN = str.maketrans("SUAX0123", "suaxsuax")
TABLE = "conv_id long, segment long, symbols string, costs array<long>, audits array<string>"
PIECE = "conv_id long, segment long, audit string, start long, cost long, illegal long"


def plans(symbols: DataFrame) -> DataFrame:
    """Per segment the piece of the conversation's lightest derivation: audit, state before, cost, and illegal neighbours up to its last row.

    Segments are solved where they lie, from every state; then each conversation's tables are chained in order.
    """
    runs = symbols.groupBy("conv_id", segment().alias("segment")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("list"))
    runs = runs.select("conv_id", "segment", F.concat_ws("", F.transform("list", lambda x: x["symbol"])).alias("symbols"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                flat = [[x for goals in transitions(s) for x in goals] for s in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([[x and x[0] for x in f] for f in flat], pa.list_(pa.int64())), pa.array([[x and x[1] for x in f] for f in flat], pa.list_(pa.string()))],
                    names=["conv_id", "segment", "symbols", "costs", "audits"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state, illegal, last = object(), None, {}, ""

        def finish() -> None:
            if state is not None:
                out.extend((now, seg, audit, start, cost, illegal[seg]) for seg, audit, start, cost in state.pieces())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "segment", "audit", "start", "cost", "illegal"])

        for b in batches:
            for conv, seg, text, costs, audits in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != now:
                    finish()
                    now, state, illegal, last = conv, Chain(), {}, ""
                state.add(seg, costs, audits)
                plain = last + text.translate(PLAIN)
                illegal[seg] = sum(plain[i:i + 2] not in LEGAL for i in range(len(plain) - 1))
                last = plain[-1]
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        finish()
        yield batch_of(out)

    solved = runs.mapInArrow(solve, TABLE)
    return stored(solved.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(chain, PIECE), "talk-pieces")


class Walk:
    """Applies pieces to rows as both come by in order: yields (edit, turn, role, text) of the repaired turns."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, NOTHING

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial = wanted(self.state)
            self.at, self.state = self.at + 1, after(self.state, initial)
            yield "I", None, NAMES[initial], ""

    def piece(self, audit: str, start: int) -> Iterator[tuple]:
        """What the piece before still inserts at its end."""
        yield from self.inserted()
        self.audit, self.at, self.state = audit, 0, start

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        initial = role[0] if edit == "K" else wanted(self.state)
        self.state = after(self.state, initial)
        yield edit, turn, role if edit == "K" else NAMES[initial], text


def mixed(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows and pieces in one table; sorted by pos and kind, each piece comes before the rows it is about."""
    given = rows.select("conv_id", segment().alias("segment"), "pos", F.lit(1).alias("kind"), "turn", "role", "text")
    told = pieces.select("conv_id", "segment", F.shiftleft("segment", SEGMENT_BITS).alias("pos"), F.lit(0).alias("kind"), F.col("start").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return given.union(told)


def walked(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """(conv_id, segment, new, turns) for each row that comes by; ``new`` marks the first of a conversation, or of a segment.

    A last entry (None, None, True, turns) has what is inserted at the very end.
    """
    now, walk, owner = None, Walk(), (None, None)
    for b in batches:
        for conv, seg, _, kind, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            mark = (conv,) if whole else (conv, seg)
            if mark != now:
                if now is not None:
                    yield *owner, False, list(walk.inserted())
                now, walk = mark, Walk()
                yield conv, seg, True, []
            owner = (conv, seg)
            yield conv, seg, False, list(walk.piece(text, turn) if kind == 0 else walk.row(turn, role, text))
    if now is not None:
        yield *owner, False, list(walk.inserted())


REPAIRED = "conv_id long, segment long, place long, edit string, turn long, role string, text string"


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, segment and place (their order), edit (Keep, Rerole or Insert as K, R, I), turn, role, text.

    ``conversations`` has conv_id, turn, role and text without nulls in role and text. See ``repair_report`` for the rules. Each segment of a
    conversation is a task's group of its own, so a very long conversation is spread.
    """
    rows = ordered(exact(conversations, conv_id="conv_id", turn="turn", role="role", text="text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place = 0
        for conv, seg, new, turns in walked(batches, whole=False):
            place = 0 if new else place
            for edit, turn, role, text in turns:
                out.append((conv, seg, place, edit, turn, role, text))
                place += 1
            if len(out) >= 1024:
                yield repaired_batch(out)
                out = []
        yield repaired_batch(out)

    dealt = mixed(rows, plans(marked(rows))).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "pos", "kind")
    return dealt.mapInArrow(run, REPAIRED)


def repaired_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "segment", "place", "edit", "turn", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)


def digests(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, sha256) over the repaired ``role:text`` lines; a digest is taken in order, so each conversation streams through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints = [], []
        own, first = None, True
        for conv, _, new, turns in walked(batches, whole=True):
            if new:
                if own is not None:
                    prints.append(own.hexdigest())
                ids.append(conv)
                own, first = hashlib.sha256(), True
            for _, _, role, text in turns:
                own.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "replace"))
                first = False
            if len(prints) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:4096], pa.int64()), pa.array(prints[:4096])], names=["conv_id", "sha"])
                ids, prints = ids[4096:], prints[4096:]
        if own is not None:
            prints.append(own.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.string())], names=["conv_id", "sha"])

    dealt = mixed(rows, pieces).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return dealt.mapInArrow(run, "conv_id long, sha string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EMPTY = hashlib.sha256(b"").hexdigest()


def repair_report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, and rows of one turn by a hash of role and text, repeated rows side by side. A row's
    first fault counts: blank, duplicate (role and text seen before in the conversation), truncated (no sentence end). Edits: Keep 0,
    Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go), Insert an empty turn 2; a truncated row that stays adds 1. The
    cheapest edits give role initials ``(s?(ua)+)?``; of several the one with the least audit counts. ``ids`` has the conversations
    to report, whether they have rows or not (default: those that have). A null conv_id is a conversation of its own. Very long texts
    and conversations are streamed; columns beyond the four are ignored; an empty table gives an empty result.
    """
    rows = ordered(exact(conversations, conv_id="conv_id", turn="turn", role="role", text="text"))
    symbols = stored(marked(rows), "talk-marks")
    pieces = plans(symbols)
    zero = F.lit(0).cast("long")
    flag = lambda c: F.sum(F.col(c).cast("long"))
    part = lambda df, **has: df.select(
        "conv_id", *[has.get(c, zero).alias(c) for c in COUNTS], has.get("piece", F.lit(None).cast("struct<segment:long,audit:string>")).alias("piece"),
        has.get("sha", F.lit(None).cast("string")).alias("sha"))
    turns = symbols.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.max("turn").cast("decimal(38,0)").alias("high"), F.min("turn").cast("decimal(38,0)").alias("low"), F.count("*").alias("n"))
    gaps = F.least(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    faults = symbols.groupBy("conv_id").agg(flag("blank").alias("blank"), flag("duplicate").alias("duplicate"), flag("truncated").alias("truncated"))
    parts = [part(exact(ids if ids is not None else conversations, conv_id="conv_id").select(F.col("conv_id").cast("long").alias("conv_id"))),
             part(turns, gaps=gaps), part(faults, blank=F.col("blank"), duplicate=F.col("duplicate"), truncated=F.col("truncated")),
             part(pieces, cost=F.col("cost"), illegal=F.col("illegal"), piece=F.struct("segment", "audit")), part(digests(rows, pieces), sha=F.col("sha"))]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    told = every.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.sort_array(F.collect_list("piece")).alias("list"), F.max("sha").alias("sha"))
    return told.select("conv_id", *COUNTS, F.concat_ws("", F.transform("list", lambda x: x["audit"])).alias("audit"), F.coalesce("sha", F.lit(EMPTY)).alias("repaired_sha256"))


def repair(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged rows, for every conversation of the given table."""
    return repair_report(damaged(conversations), conversations)
