"""Conversation repair: the cheapest edits that give legal roles, by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored

# Costs of edits, and what a truncated row adds when it stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
LEGAL = ("su", "ua", "au")
# States after a row's role initial: nothing yet, system, user, assistant; a whole conversation ends in one of ENDS.
STATES, ENDS = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
BACK = {(1, "s"): (0,), (2, "u"): (0, 1, 3), (3, "a"): (2,)}
# Rows of a conversation that are searched as one piece; least and most rows that one range of the order holds.
BLOCK, SMALL_RANGE, RANGE = 512, 1024, 400_000

Way = tuple[int, str]


def _row_edits(kind: int, initial: str) -> list[tuple[str, int, str]]:
    """``(letter, cost, initial afterwards)`` of the edits that keep a row."""
    if kind in (BLANK, DUPLICATE):
        return []
    extra = TRUNCATED if kind == CUT else 0
    return [("K", extra, initial)] + [("R", REROLE + extra, to) for to in "ua" if to != initial]


def cheapest(kinds: list[int], initials: list[str], start: int, goals: tuple[int, ...]) -> Way | None:
    """Least cost and, among the cheapest, ASCII-least audit of edits that lead from ``start`` to one of ``goals``.

    Nodes are (rows done, state). A forward heap from the start and a reverse heap from the goals settle nodes in turn;
    each is ordered by cost, then rows done, then audit, so that a node settles with its least audit (a free Keep always
    does one more row). They stop when their least costs together exceed the best meeting; by then every cheapest path
    has an edge or node whose ends both have settled, and the least concatenated audit over all such crossings is taken.
    Two cheapest audits of one node never begin with one another, so least parts make a least whole.
    """
    n = len(kinds)
    edits = [_row_edits(k, c) for k, c in zip(kinds, initials)]

    def onward(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        for to in "ua":
            if (q, to) in STEP:
                yield "I", INSERT, i, STEP[q, to]
        if i < n:
            yield "D", DELETE, i + 1, q
            for letter, cost, to in edits[i]:
                if (q, to) in STEP:
                    yield letter, cost, i + 1, STEP[q, to]

    def backward(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        for to in "ua":
            for p in BACK.get((q, to), ()):
                yield "I", INSERT, i, p
        if i > 0:
            yield "D", DELETE, i - 1, q
            for letter, cost, to in edits[i - 1]:
                for p in BACK.get((q, to), ()):
                    yield letter, cost, i - 1, p

    ahead, behind = [(0, 0, "", start)], [(0, 0, "", q) for q in goals]
    heapq.heapify(behind)
    from_start: dict[tuple[int, int], Way] = {}
    to_goal: dict[tuple[int, int], Way] = {}
    best = math.inf

    def settle(heap: list, own: dict, other: dict, forward: bool) -> None:
        nonlocal best
        cost, done, audit, q = heapq.heappop(heap)
        i = done if forward else n - done
        if (i, q) in own:
            return
        own[i, q] = cost, audit
        if (i, q) in other:
            best = min(best, cost + other[i, q][0])
        for letter, price, j, p in onward(i, q) if forward else backward(i, q):
            if (j, p) in other:
                best = min(best, cost + price + other[j, p][0])
            if (j, p) not in own:
                heapq.heappush(heap, (cost + price, j, audit + letter, p) if forward else (cost + price, n - j, letter + audit, p))

    settle(ahead, from_start, to_goal, True)
    for _ in goals:
        settle(behind, to_goal, from_start, False)
    while ahead or behind:
        near, far = ahead[0][0] if ahead else math.inf, behind[0][0] if behind else math.inf
        if near + far > best:
            break
        if near <= far:
            settle(ahead, from_start, to_goal, True)
        else:
            settle(behind, to_goal, from_start, False)
    if best == math.inf:
        return None
    audits = [a + to_goal[x][1] for x, (c, a) in from_start.items() if x in to_goal and c + to_goal[x][0] == best]
    for (i, q), (c, a) in from_start.items():
        for letter, price, j, p in onward(i, q):
            if (j, p) in to_goal and c + price + to_goal[j, p][0] == best:
                audits.append(a + letter + to_goal[j, p][1])
    return int(best), min(audits)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with faults put in by crc32 of ``conv:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it a user's.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")), F.lit(20))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), fault.alias("fault"))
    broken = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return own.where("fault <> 0").select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                                          broken.alias("text"), copies.alias("_copy")).drop("_copy")


def in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv (string), turn, role, text, digest, kind, ord, part``, stored: every row with its place in one order.

    The order is conversation, turn (nulls first), role, digest of role and text; equal rows are told apart by where they
    were read. It is cut into as many ranges as the session shuffles into, or more so that none holds much over ``RANGE``
    rows; a very long conversation, or one row repeated very often, spreads over many ranges.
    """
    name = F.coalesce(F.col(role).cast("string"), F.lit(" "))
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    said = rows.select(F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), name.alias("role"), body.alias("text"))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    kind = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~ended, CUT).otherwise(FINE)
    own = stored(said.select("*", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("digest"), kind.alias("kind"),
                             F.monotonically_increasing_id().alias("read")), "turns")
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "read"]
    n = own.count()
    ranges = max(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SMALL_RANGE), n // RANGE, 1)
    placed = own.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return stored(placed.drop("read").withColumns({"ord": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "turns")


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, bool, list[tuple[int, int, str]]]]:
    """``(conv, whole, [(ord, kind, initial)])`` in order; the first and last conversation of a range may go on elsewhere.

    A conversation comes in pieces of ``BLOCK`` rows; it is whole if it is one piece that cannot go on elsewhere.
    """
    now, held, pieces, edge = None, [], 0, True
    for batch in batches:
        for part, conv, at, kind, initial in zip(*(batch[c].tolist() for c in ("part", "conv", "ord", "kind", "initial"))):
            conv = conv if isinstance(conv, str) else None
            if held and (part, conv) != now:
                last = part != now[0]
                yield now[1], not (edge or last or pieces), held
                held, pieces, edge = [], 0, last
            elif len(held) == BLOCK:
                yield now[1], False, held
                held, pieces = [], pieces + 1
            now = part, conv
            held.append((at, kind, initial))
    if held:
        yield now[1], False, held


WAYS = "conv string, ord long, n long, head string, tail string, illegal long, blank long, duplicate long, truncated long, costs array<long>, audits array<string>"
FOUND = "conv string, illegal long, blank long, duplicate long, truncated long, cost long, audit string"
COUNTS = ("illegal", "blank", "duplicate", "truncated")


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for conv, whole, rows in _segments(batches):
        kinds, initials = [r[1] for r in rows], [r[2] for r in rows]
        if whole:
            ways = [cheapest(kinds, initials, 0, ENDS)]
        else:
            ways = [cheapest(kinds, initials, q, (p,)) for q in range(STATES) for p in range(STATES)]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        out.append((conv, rows[0][0], len(rows), initials[0], initials[-1], illegal, *(kinds.count(k) for k in (BLANK, DUPLICATE, CUT)),
                    [w and w[0] for w in ways], [w and w[1] for w in ways]))
        if len(out) >= 1024:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WAYS.split(", ")])
            out = []
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WAYS.split(", ")])


def _chained(pieces: pd.DataFrame) -> pd.DataFrame:
    """The cheapest way through all pieces of one conversation."""
    pieces = pieces.sort_values("ord")
    reached: dict[int, Way] = {0: (0, "")}
    for costs, audits in zip(pieces["costs"], pieces["audits"]):
        now: dict[int, Way] = {}
        for q, (cost, audit) in reached.items():
            for p in range(STATES):
                step = costs[q * STATES + p]
                if not pd.isna(step):
                    way = cost + int(step), audit + audits[q * STATES + p]
                    now[p] = min(now.get(p, way), way)
        reached = now
    cost, audit = min(reached[q] for q in ENDS if q in reached)
    borders = sum(a + b not in LEGAL for a, b in zip(pieces["tail"], pieces["head"].iloc[1:]))
    sums = [int(pieces[c].sum()) + (borders if c == "illegal" else 0) for c in COUNTS]
    conv = pieces["conv"].iloc[0]
    return pd.DataFrame([(conv if isinstance(conv, str) else None, *sums, cost, audit)], columns=[c.split()[0] for c in FOUND.split(", ")])


def audits(ordered: DataFrame) -> DataFrame:
    """:data:`FOUND`: faults, least cost and audit per conversation of :func:`in_order`.

    A row is a duplicate if it is not the first of its conversation, role and text; firsts are one aggregation and meet
    the rows again by place, so no frequent text gathers rows. Conversations inside one range are searched as they pass;
    pieces of others are searched from every state to every state, and the pieces of a conversation are chained.
    """
    codes = ordered.select("part", "conv", "ord", "kind", "digest", F.substring("role", 1, 1).alias("initial"))
    firsts = codes.where(F.col("kind") != BLANK).groupBy("conv", "digest").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    kind = F.when((F.col("kind") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("kind"))
    known = codes.drop("digest").join(firsts, "ord", "left").select("part", "conv", "ord", kind.alias("kind"), "initial")
    parts = (ordered.agg(F.max("part")).first()[0] or 0) + 1
    ways = stored(known.repartition(parts, "part").sortWithinPartitions("part", "ord").mapInPandas(_searched, WAYS), "ways")
    single = F.size("costs") == 1
    whole = ways.where(single).select("conv", *COUNTS, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    return stored(whole.union(ways.where(~single).groupBy("conv").applyInPandas(_chained, FOUND)), "audits")


def _replayed(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its rows, in order."""
    rows = ordered.select("conv", "ord", "role", "text").union(
        found.select("conv", F.lit(-1).cast("long").alias("ord"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return rows.repartition("conv").sortWithinPartitions("conv", "ord")


class _Edited:
    """Applies the audit of one conversation to its rows as they pass."""

    def __init__(self, conv: str | None, audit: str) -> None:
        self.conv, self.audit, self.at, self.state = conv, audit, 0, 0

    def _needed(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _placed(self, letter: str, role: str, text: str) -> tuple[str, str, str]:
        self.state = STEP[self.state, role[0]]
        return letter, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield self._placed("I", self._needed(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._placed(letter, role if letter == "K" else self._needed(), text)


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Edited, tuple[str, str, str] | None]]:
    """Every conversation's repaired rows as ``letter, role, text``; ``None`` marks the end of one."""
    now = None
    for batch in batches:
        for conv, at, role, text in zip(*(batch[c].tolist() for c in ("conv", "ord", "role", "text"))):
            if at < 0:
                if now is not None:
                    yield from ((now, x) for x in now.inserted())
                    yield now, None
                now = _Edited(conv if isinstance(conv, str) else None, text)
            else:
                yield from ((now, x) for x in now.row(role, text))
    if now is not None:
        yield from ((now, x) for x in now.inserted())
        yield now, None


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv (string), place, edit, role, text``: the repaired conversations, their rows numbered from 0.

    See :func:`report` for what is repaired and how rows are ordered. A conversation repaired to nothing has no rows.
    """
    ordered = in_order(rows, conv, turn, role, text)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place = [], 0
        for now, edit in _edits(batches):
            if edit is None:
                place = 0
                continue
            out.append((now.conv, place, *edit))
            place += 1
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])

    return _replayed(ordered, audits(ordered)).mapInPandas(work, "conv string, place long, edit string, role string, text string")


def report(rows: DataFrame, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation named in ``conversations``.

    Rows go by turn, nulls first; equal turns by role, then by digest of role and text; null roles and texts are one
    space. Gaps are turn numbers left out between the least and the greatest. Faults are counted per row, the first of
    blank, duplicate, truncated; ``illegal`` counts adjacent role initials other than su, ua, au. The repair is the
    cheapest one to roles ``(s?(ua)+)?``, ties by the least audit. A null conversation is one conversation; one without
    rows gets zeros, an empty audit and the hash of nothing; empty tables give an empty result. Further columns are not
    read. Searching spreads over ranges of rows whatever a conversation's length; the digest of a conversation is serial
    by its definition, so its rows pass through one task as a stream.
    """
    ordered = in_order(rows, conv, turn, role, text)
    found = audits(ordered)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, digest, begun = [], hashlib.sha256(), False
        for now, edit in _edits(batches):
            if edit is None:
                out.append((now.conv, digest.hexdigest()))
                digest, begun = hashlib.sha256(), False
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
                    out = []
            else:
                digest.update((("\n" if begun else "") + f"{edit[1]}:{edit[2]}").encode())
                begun = True
        if out:
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])

    digests = _replayed(ordered, found).mapInPandas(work, "conv string, repaired_sha256 string")
    spread = ordered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    keyed = {name: df.withColumnRenamed("conv", f"_{name}") for name, df in (("found", found), ("digest", digests), ("gap", spread))}
    out = conversations.select(F.col(conv)).distinct().withColumn("_key", F.col(conv).cast("string"))
    for name, df in keyed.items():
        out = out.join(df, F.col("_key").eqNullSafe(F.col(f"_{name}")), "left")

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long").alias(name)

    nothing = hashlib.sha256().hexdigest()
    return out.select(conv, *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
