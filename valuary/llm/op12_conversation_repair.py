"""Conversation structure repair: the cheapest edits that turn a conversation into system? (user assistant)+, or nothing.

Rows are repartitioned by conversation once; everything else is sorting inside the partitions and streaming.
A window over equal (role, text) marks repeats. Rows then pass twice through `mapInPandas`, in turn order:

* backwards, carrying the cost-to-go of the four states (start, after system, after user, after assistant) from
  batch to batch, and leaving with each row one byte, the best move in each state (the back pointers);
* forwards, carrying only the state, following those moves.

A batch boundary may cut a conversation anywhere. What a worker holds doesn't grow with a conversation: back
pointers travel as a column of the rows, and Spark's sorter spills them to disk where they don't fit. One
conversation is one task's stream (its digest is a sequential hash), in bounded memory. Among the cheapest edits
those with the ASCII-least initials win: each choice, made at the front of a suffix whose cost is known, leads to
one state only, so taking the least letter at every step is exact.

Defined results: a null role or text is one space (so such a text is blank, such a role must be changed or
go); null turns come first; a null conv_id is a conversation; rows of one turn are ordered by role, then text;
a repeated row is a duplicate of the earlier one; an empty role has no initial and is never legal; further
columns are ignored; an empty table gives an empty result; a very long text passes as one value of its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.registry import query, table
from valuary.llm.words import BLANKS, NOT_BLANK

# What an edit costs, and what a kept truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAULTS = ("", "blank", "duplicate", "truncated")
NEVER = 10**15
# States: nothing written yet, after system, after user, after assistant; the role that edits write next in each.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_TURN = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MOVES = "DIKR"
END_COST = (0, 2 * INSERT, INSERT, 0)
END_INSERTS = (0, 2, 1, 0)

EDIT_SCHEMA = "conv string, edit string, role string, text string, turn long, had_turn boolean, had string, fault string"


def conversation_rows(rows: DataFrame) -> DataFrame:
    """One row per row of `rows` (conv_id, turn, role, text), together by conversation: conv (text), turn, role,
    text, nth (its place among the conversation's rows of that role and text) and fault."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    df = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).repartition("conv")
    same = Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("text").rlike(NOT_BLANK), "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?]{BLANKS}*\z"), "truncated")
        .otherwise("")
    )
    return df.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)


def in_order(df: DataFrame, backwards: bool = False) -> DataFrame:
    """Sorted by conversation and turn inside the partitions; the order is total but for equal rows."""
    ways = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("nth")]
    if backwards:
        ways = [F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")]
    return df.sortWithinPartitions("conv", *ways)


def step_back(costs: tuple, initial: str, fault: str) -> tuple[tuple, int]:
    """Cost-to-go in each state before a row, and the moves there (two bits a state), from those after it."""
    must_go = fault in ("blank", "duplicate")
    extra = TRUNCATED if fault == "truncated" else 0
    best = []
    for state in range(4):
        options = [(DELETE + costs[state], 0)]
        if not must_go:
            kept = KEEPS.get(initial, {}).get(state)
            if kept is not None:
                options.append((extra + costs[kept], 2))
            options.append((REROLE + extra + costs[AFTER_TURN[state]], 3))
        best.append(min(options))
    out, moves = [], 0
    for state in range(4):
        one = AFTER_TURN[state]
        cost = min(best[state][0], INSERT + best[one][0], 2 * INSERT + best[AFTER_TURN[one]][0])
        out.append(cost)
    for state in range(4):
        own, move = best[state]
        inserted = INSERT + out[AFTER_TURN[state]] == out[state]
        if own != out[state] or (inserted and move > 1):
            move = 1
        moves |= move << (2 * state)
    return tuple(out), moves


def back_pointers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in descending order with their moves; the cost-to-go goes from batch to batch."""
    known: dict = {}
    conv, costs = object(), END_COST
    for batch in batches:
        moves = []
        for key, role, fault in zip(batch["conv"], batch["role"], batch["fault"]):
            if key != conv:
                conv, costs = key, END_COST
            at = (costs, role[:1], fault)
            found = known.get(at)
            if found is None:
                found = known[at] = step_back(*at)
                least = min(found[0])
                # Only differences matter, so few cases exist.
                found = known[at] = (tuple(c - least for c in found[0]), found[1])
            costs = found[0]
            moves.append(found[1])
        yield batch.assign(moves=pd.Series(moves, index=batch.index, dtype="int16"))


def edits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in ascending order with their moves to one row per edit; the state goes from batch to batch."""
    conv, state, begun = None, START, False

    def closing():
        """The inserts behind a conversation's last row."""
        at = state
        for _ in range(END_INSERTS[state]):
            at = AFTER_TURN[at]
            yield (conv, "I", ROLE_OF[at], "", 0, False, "", "")

    for batch in batches:
        out = []
        for key, role, text, turn, fault, moves in zip(
            batch["conv"], batch["role"], batch["text"], batch["turn"], batch["fault"], batch["moves"]
        ):
            if not begun or key != conv:
                out.extend(closing())
                conv, state, begun = key, START, True
            move = moves >> (2 * state) & 3
            while move == 1:
                state = AFTER_TURN[state]
                out.append((key, "I", ROLE_OF[state], "", 0, False, "", ""))
                move = moves >> (2 * state) & 3
            if move == 0:
                said = (None, None)
            elif move == 2:
                state = KEEPS[role[:1]][state]
                said = (role, text)
            else:
                state = AFTER_TURN[state]
                said = (ROLE_OF[state], text)
            known = turn != ""
            out.append((key, MOVES[move], *said, int(turn) if known else 0, known, role, fault))
        yield _edit_frame(out)
    yield _edit_frame(list(closing()))


def _edit_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in EDIT_SCHEMA.split(", ")])
    return frame.astype({"turn": "int64", "had_turn": "bool"})


REPORT_SCHEMA = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Report:
    """What is known of one conversation so far."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self, conv):
        self.conv, self.audit, self.hash = conv, [], hashlib.sha256()
        self.faults = dict.fromkeys(FAULTS, 0)
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = self.written = 0

    def add(self, edit, role, text, turn, had_turn, had, fault):
        self.audit.append(edit)
        if edit != "D":
            self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.written = 1
        if edit == "I":
            self.cost += INSERT
            return
        self.faults[fault] += 1
        self.cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
        if self.before is not None and self.before + had[:1] not in self.LEGAL:
            self.illegal += 1
        self.before = had[:1]
        if had_turn:
            if turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        faults = [self.faults[f] for f in FAULTS[1:]]
        return (self.conv, gaps, *faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def reports(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits in order to one row per conversation."""
    names = [c.split(" ")[0] for c in REPORT_SCHEMA.split(", ")]
    now = None
    for batch in batches:
        done = []
        for conv, *edit in batch.itertuples(index=False, name=None):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = Report(conv)
            now.add(*edit)
        yield pd.DataFrame(done, columns=names)
    yield pd.DataFrame([now.row()] if now else [], columns=names)


def _planned(rows: DataFrame) -> DataFrame:
    """Rows in order with the moves that the backward pass left; turns as text, empty for null."""
    df = conversation_rows(rows)
    schema = "conv string, turn long, role string, text string, nth int, fault string, moves smallint"
    # As text a null turn stays apart from the numbers in pandas.
    back = in_order(df, backwards=True).withColumn("turn", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    moved = back.mapInPandas(back_pointers, schema.replace("turn long", "turn string"))
    numeric = F.expr("try_cast(nullif(turn, '') as bigint)")
    ordered = in_order(moved.withColumn("turn", numeric))
    return ordered.withColumn("turn", F.coalesce(F.col("turn").cast("string"), F.lit("")))


def repair(rows: DataFrame) -> DataFrame:
    """One row per edit, in order inside the partitions: conv (conv_id as text), edit (K, R, D or I), the role and
    text it writes (null for D), the turn, role (`had`) and fault of the row it edits."""
    return _planned(rows).mapInPandas(edits, EDIT_SCHEMA)


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows`: its faults, the cost and initials of the edits, the repaired text's hash."""
    return _planned(rows).mapInPandas(lambda batches: reports(edits(batches)), REPORT_SCHEMA)


def damage(rows: DataFrame) -> DataFrame:
    """The rows as the query damages them, by the crc32 of `conv_id:turn` modulo 20; nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text: Column = F.when(F.col("_kind") == 1, "").when(
        F.col("_kind") == 2, F.regexp_replace(said("text"), "[.!?]", "")
    ).otherwise(said("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(said("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return (
        rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where("_kind <> 0")
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
    )


@query("op12_conversation_repair", sql.CONVERSATION_REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = report(damage(rows))
    every = rows.select("conv_id", F.col("conv_id").cast("string").alias("_conv")).distinct()
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col("conv")), "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
