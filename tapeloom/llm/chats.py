"""Chat formatting: reversible templates and budgeted, turn-aligned windows with masked repeats."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Tokens of a window, those of them for repeated history, and turns whose sums are formed together.
BUDGET, HISTORY, BLOCK = 1024, 256, 1024


@dataclass(frozen=True)
class Template:
    """A turn is ``begin role middle text end``.

    In roles and texts the escape character doubles and every control string gets one after its first character, so no
    control string survives in them; a role's line ends are escaped too. Dropping each escape and keeping what follows
    gives the text back.
    """

    begin: str = "<|turn|>"
    middle: str = "\n"
    end: str = "<|end|>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>",
                                 "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def guard(self, text: str) -> str:
        e = self.escape
        out = text.replace(e, e + e)
        for control in self.controls:
            out = out.replace(control, control[0] + e + control[1:])
        return out

    def guard_role(self, role: str) -> str:
        return self.guard(role).replace("\n", self.escape + "\n")

    def unguard(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The formatted turn and where its text begins and ends in it."""
        head = self.begin + self.guard_role(role) + self.middle
        body = self.guard(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """The roles and texts of a formatted window."""
        e = re.escape(self.escape)
        own = re.compile(re.escape(self.begin) + f"((?:{e}.|[^{e}\n])*){re.escape(self.middle)}(.*?){re.escape(self.end)}", re.S)
        return [(self.unguard(m[1]), self.unguard(m[2])) for m in own.finditer(formatted)]


_ENCODING: dict[str, tiktoken.Encoding] = {}


def _encoding(blob: bytes) -> tiktoken.Encoding:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _ENCODING:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        _ENCODING[key] = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[key]


def count_tokens(encoding: tiktoken.Encoding, text: str, piece: int = 100_000) -> int:
    """Tokens of a text; very long ones in pieces, which may add a token per piece."""
    return sum(len(encoding.encode_ordinary(text[i: i + piece])) for i in range(0, len(text), piece))


def formatted_turns(rows: DataFrame, template: Template, ranks: bytes, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, formatted, begin, stop, tokens`` per turn; null roles and texts are empty."""
    blob = rows.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(blob.value)
        for batch in batches:
            made = [template.turn(r, t) for r, t in zip(batch["role"], batch["text"])]
            batch["formatted"], batch["begin"], batch["stop"] = (list(x) for x in zip(*made)) if made else ([], [], [])
            batch["tokens"] = [count_tokens(encoding, f) for f in batch["formatted"]]
            yield batch

    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = own.schema["conv"].dataType.simpleString()
    return own.mapInPandas(work, f"conv {kind}, turn long, role string, text string, formatted string, begin int, stop int, tokens long")


def windows(rows: DataFrame, template: Template = Template(), budget: int = BUDGET, history: int = HISTORY,
            ranks: bytes | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, window, n_turns, n_repeated, n_tokens, formatted, loss``: training windows of each conversation.

    Turns go by ``turn``, then role and text (null turns first; repeated rows are turns of their own). Prefix sums of
    turn tokens are cut into spans of what ``budget`` leaves after the leading system turn and ``history``: turns that
    lie inside one span share a window, and a turn that straddles a border has a window of its own, so windows are runs
    of whole turns. A window repeats before its fresh turns the leading system turn and as many of the turns just before
    as ``history`` tokens, and what is left of the budget, hold. No window exceeds ``budget`` tokens, but for one whose
    only fresh turn is larger than what the system turn leaves: that turn is kept whole, with the system turn and without
    history. ``loss`` lists the code point spans of fresh assistant texts in ``formatted``; repeated turns are masked, so
    each assistant text is a target once. Turns are formatted and counted once and stored. Prefix sums are formed per
    block of turn numbers and over block totals, so a very long conversation is not sorted in one task. Other columns are
    not read; an empty table gives an empty result.
    """
    if ranks is None:
        with open(RANKS, "rb") as file:
            ranks = file.read()
    made = stored(formatted_turns(rows, template, ranks, conv, turn, role, text), "formatted-turns").withColumn(
        "block", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK))
    per_block = made.groupBy("conv", "block").agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("turns"), F.min(F.struct("turn", "role", "text", "tokens")).alias("head"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("head").over(whole)
    shifts = per_block.select(
        F.col("conv").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("_sum"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("_turns"),
        F.when(first["role"] == "system", first["tokens"]).alias("system_tokens"),
        F.when(first["role"] == "system", first["text"]).alias("system_text"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn(
        "_ord", F.count(F.lit(1)).over(inside)).join(shifts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    runs = placed.select(
        "conv", "role", "formatted", "begin", "stop", "tokens", "system_text", "system_tokens",
        (F.col("_before") + F.col("_sum")).alias("before"), (F.col("_ord") + F.col("_turns")).alias("ord"))
    system = F.coalesce("system_tokens", F.lit(0))
    span = F.greatest(F.lit(budget - history) - system, F.lit(1))

    def cell(tokens: Column) -> Column:
        return F.floor(tokens / span)

    # Spans have even numbers; a turn that straddles the end of one has the odd number after it.
    end = F.greatest(F.col("before") + F.col("tokens") - 1, F.col("before"))
    runs = runs.withColumn("window", 2 * cell(F.col("before")) + F.when(cell(F.col("before")) < cell(end), 1).otherwise(0))
    # Only a turn of at most ``history`` tokens can be repeated, and only in a window that begins within them.
    last = F.when(F.col("tokens") <= history, 2 * cell(F.col("before") + history) + 1).otherwise(F.col("window"))
    copies = runs.withColumn("at", F.explode(F.sequence("window", last)))
    starts = runs.groupBy("conv", "window").agg(F.min("before").alias("from"), F.min("ord").alias("from_ord"), F.sum("tokens").alias("_fresh")).select(
        F.col("conv").alias("_c"), F.col("window").alias("_w"), "from", "from_ord", "_fresh")
    left = F.least(F.lit(history), F.lit(budget) - system - F.col("_fresh"))
    held = copies.join(starts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_w"))).where(
        (F.col("window") == F.col("at")) | ((F.col("ord") > 0) | F.col("system_text").isNull()) & (F.col("from") - F.col("before") <= left))
    fresh = F.col("window") == F.col("at")
    turns = held.groupBy("conv", "at").agg(
        F.sort_array(F.collect_list(F.struct("ord", "role", "formatted", "begin", "stop", "tokens", fresh.alias("fresh")))).alias("turns"),
        F.min("from_ord").alias("from_ord"), F.first("system_text").alias("system_text"), F.first("system_tokens").alias("system_tokens"))

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                text_, loss, repeated, tokens = [], [], 0, 0
                at = 0
                if row.from_ord > 0 and row.system_text is not None:
                    head = template.turn("system", row.system_text)[0]
                    text_.append(head)
                    at, repeated, tokens = len(head), 1, int(row.system_tokens)
                for t in row.turns:
                    if t["fresh"] and t["role"] == "assistant":
                        loss.append([at + t["begin"], at + t["stop"]])
                    repeated += not t["fresh"]
                    tokens += t["tokens"]
                    text_.append(t["formatted"])
                    at += len(t["formatted"])
                out.append((row.conv, row.at, repeated + sum(t["fresh"] for t in row.turns), repeated, tokens, "".join(text_), loss))
            yield pd.DataFrame(out, columns=["conv", "window", "n_turns", "n_repeated", "n_tokens", "formatted", "loss"])

    kind = rows.schema[conv].dataType.simpleString()
    return turns.mapInPandas(assemble, f"conv {kind}, window long, n_turns long, n_repeated long, n_tokens long, formatted string, loss array<array<int>>")


def read_back(made: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from its windows alone: ``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Windows pass in order and feed running digests, so memory is bounded by one window. A digest over a conversation is
    serial by nature, its windows meet in one task.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def row(s: dict) -> dict:
            return {"conv": s["conv"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"],
                    "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["formatted"]}

        for batch in batches:
            out = []
            for r in batch.itertuples():
                conv = None if pd.isna(r.conv) else r.conv
                if state is None or conv != now:
                    if state is not None:
                        out.append(row(state))
                    now, state = conv, {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, text in template.turns(r.formatted)[r.n_repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for a, b in r.loss:
                    target = template.unguard(r.formatted[a:b])
                    state["chars"] += len(target)
                    state["loss"].update(target.encode())
                state["formatted"] += len(r.formatted)
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame([row(state)])

    kind = made.schema["conv"].dataType.simpleString()
    ordered = made.repartition("conv").sortWithinPartitions("conv", "window").select("conv", "window", "n_repeated", "formatted", "loss")
    return ordered.mapInPandas(work, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
