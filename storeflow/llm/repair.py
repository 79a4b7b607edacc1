"""Conversation structure repair by depth-first branch-and-bound.

Rows of a conversation, in order of turn (nulls first; then by role and text, as UTF-8 bytes), are edited so that the
initials of their roles read `(s?(ua)+)?`: keep (K), rerole to user or assistant (R), delete (D), insert a user or
assistant row without text (I). Of the cheapest edits those with the ASCII-least audit, the string of their initials, win.

A row's first fault counts: blank (no character but 0x20 and 0x09 to 0x0D), duplicate (role and text seen earlier in the
conversation), truncated (the last such character is none of `.!?`). Blank and duplicate rows must go; a truncated row
that stays costs extra.

`search` walks nodes (rows done, grammar state) with an explicit stack. It leaves a branch when its cost and a bound of
the rows to come, which lets the end be anywhere and knows no audits, exceed the incumbent's (or equal it with a greater
audit), and when a prefix that came to the same node was at least as cheap and small. Edits cost something or use up a row, so the order of two
prefixes of one node never turns.

`repair` sorts rows over ranges, so that a conversation of any length spreads over many tasks, and cuts it into pieces of
at most PIECE_ROWS rows and about PIECE_BYTES bytes. A conversation that is one piece inside a range is solved where it is.
Of others each piece is searched from every state to every state, and one task joins these by conversation; it holds
about 17 bytes a row of it, never its texts. Equal rows meet in one task, which streams them.

Defined results: a null role or text is one space; a null conv_id is a conversation; an empty role has no initial and
cannot be kept; other columns are ignored; an empty table gives no rows; repeated rows are duplicates.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import shared_dir, small_batches

PIECE_ROWS = 512
PIECE_BYTES = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
FITS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FILLER = ["user", "user", "assistant", "user"]
FILLED = [USER, USER, ASSISTANT, USER]
LETTERS = "sua-"
SOUND, TRUNCATED, DOOMED = range(3)


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Damaged rows (conv_id, turn, role, text): a fifth of them, by crc32 of `conv_id:turn`, is dropped, emptied, unpunctuated, repeated or given to the user."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20
    made = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_now = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    made = made.select("conv_id", "turn", role_now.alias("role"), text_now.alias("text"), F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)).alias("copies"))
    return made.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def bounds(codes: bytes, costs: Costs) -> list[list[int]]:
    """For each place and state, what the rows from there cost at least, wherever the end may be; audits are not looked at."""
    row = [0] * 4
    out = [row]
    for code in reversed(codes):
        letter, fault = divmod(code, 3)
        extra = costs.truncated * (fault == TRUNCATED)
        after, row = row, []
        for state in STATES:
            x = costs.delete + after[state]
            if fault != DOOMED:
                x = min(x, extra + costs.rerole + after[FILLED[state]])
                kept = FITS.get((state, LETTERS[letter]))
                x = x if kept is None else min(x, extra + after[kept])
            row.append(x)
        row = [min(x, costs.insert + row[FILLED[state]]) for state, x in enumerate(row)]
        out.append(row)
    return out[::-1]


def search(codes: bytes, start: int, ends: tuple[int, ...], costs: Costs, fewest: list | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) from `start` to one of `ends`; each code is 3 * letter + fault. fewest, if given, gets the number of nodes opened."""
    n, ahead = len(codes), bounds(codes, costs)
    best_cost, best_audit, opened = None, "", 0
    least: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best_cost is not None and (cost + ahead[i][state] > best_cost or cost + ahead[i][state] == best_cost and audit > best_audit[: len(audit)]):
            continue
        known = least.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        least[i, state] = (cost, audit)
        opened += 1
        if i == n and state in ends and (best_cost is None or (cost, audit) < (best_cost, best_audit)):
            best_cost, best_audit = cost, audit
        filled = FILLED[state]
        then = [(costs.insert, "I", i, filled)]
        if i < n:
            letter, fault = divmod(codes[i], 3)
            then.append((costs.delete, "D", i + 1, state))
            if fault != DOOMED:
                extra = costs.truncated * (fault == TRUNCATED)
                then.append((extra + costs.rerole, "R", i + 1, filled))
                kept = FITS.get((state, LETTERS[letter]))
                if kept is not None:
                    then.append((extra, "K", i + 1, kept))
        for step, edit, j, to in sorted(then, key=lambda x: (x[0] + ahead[x[2]][x[3]], x[1]), reverse=True):  # the most hopeful on top
            stack.append((j, to, cost + step, audit + edit))
    if fewest is not None:
        fewest.append(opened)
    return None if best_cost is None else (best_cost, best_audit)


@lru_cache(maxsize=1 << 16)
def solve(codes: bytes, costs: Costs) -> tuple[int, str]:
    return search(codes, NOTHING, ENDS, costs)


@lru_cache(maxsize=1 << 12)
def ways(codes: bytes, costs: Costs) -> list:
    """For each state before and each after, the least (cost, audit) of a piece, or None."""
    return [[search(codes, s, (t,), costs) for t in STATES] for s in STATES]


def chain(pieces: list[list], ends: tuple[int, ...] = ENDS) -> tuple[int, str]:
    """The least (cost, audit) through the ways of all pieces; what all live audits share is put aside."""
    live, done = {NOTHING: (0, "")}, []
    for table in pieces:
        then = {}
        for s, (cost, audit) in live.items():
            for t, way in enumerate(table[s]):
                if way is not None and (t not in then or (cost + way[0], audit + way[1]) < then[t]):
                    then[t] = (cost + way[0], audit + way[1])
        shared = os.path.commonprefix([a for _, a in then.values()])
        done.append(shared)
        live = {t: (c, a[len(shared) :]) for t, (c, a) in then.items()}
    cost, audit = min(live[t] for t in ends if t in live)
    return cost, "".join(done) + audit


def cut_audit(audit: str, rows: int) -> int:
    """How many edits belong to the first `rows` rows and what is inserted before each."""
    at = 0
    while rows:
        rows -= audit[at] != "I"
        at += 1
    return at


def apply(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[dict], int]:
    """Repaired rows, and the state after them."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            out.append({"role": roles[i], "text": texts[i]})
            state = FITS[state, roles[i][:1]]
        elif edit != "D":
            out.append({"role": FILLER[state], "text": "" if edit == "I" else texts[i]})
            state = FILLED[state]
        i += edit != "I"
    return out, state


def follow(audit: str, state: int, codes: bytes) -> int:
    """The state after a piece."""
    i = 0
    for edit in audit:
        if edit == "K":
            state = FITS[state, LETTERS[codes[i] // 3]]
        elif edit != "D":
            state = FILLED[state]
        i += edit != "I"
    return state


class Piece:
    """Rows of one conversation that follow each other, and what is counted of them."""

    def __init__(self):
        self.roles, self.texts, self.codes, self.bytes = [], [], bytearray(), 0
        self.n = dict.fromkeys(COUNTS, 0)
        self.least = self.first_turn = self.last_turn = None

    def add(self, turn, role, text, blank, truncated, duplicate):
        fault = DOOMED if blank or duplicate else TRUNCATED if truncated else SOUND
        if fault:
            self.n["blank" if blank else "duplicate" if duplicate else "truncated"] += 1
        if self.roles:
            self.n["illegal"] += self.roles[-1][:1] + role[:1] not in LEGAL
        if turn is not None and turn != self.last_turn:
            self.n["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.last_turn = turn
        self.codes.append(3 * (LETTERS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + fault)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(role) + len(text)


COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]
_PARTS = "whole boolean, range int, at int, codes binary, roles array<string>, texts array<string>, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>"


def _assemble(costs: Costs, piece_rows: int, piece_bytes: int, schema: pa.Schema):
    def run(batches):
        from pyspark import TaskContext

        part, at, out, size = TaskContext.get().partitionId(), 0, [], 0
        key, piece, before, convs = None, None, None, 0

        def close(last: bool, ends: bool):
            """last: nothing follows in this task; ends: the conversation has no more rows here."""
            nonlocal at
            whole = ends and not last and convs > 1 and not piece.cut
            row = {"k": key, "whole": whole, "range": part, "at": at, "first_turn": piece.first_turn, "last_turn": piece.last_turn, **piece.n}
            if whole:
                cost, audit = solve(bytes(piece.codes), costs)
                row |= {"cost": cost, "audit": audit, "repaired": apply(audit, NOTHING, piece.roles, piece.texts)[0]}
            else:
                row |= {"codes": bytes(piece.codes), "roles": piece.roles, "texts": piece.texts}
            at += 1
            out.append(row)

        for b in batches:
            for k, turn, role, text, blank, truncated, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if piece is None or k != key:
                    if piece is not None:
                        close(False, True)
                    key, piece, before, convs = k, Piece(), None, convs + 1
                    piece.cut = False
                elif len(piece.roles) >= piece_rows or piece.bytes >= piece_bytes:
                    close(False, False)
                    piece = Piece()
                    piece.cut = True
                piece.add(turn, role, text, blank, truncated, again or before == (turn, role, text))
                before = (turn, role, text)
                size += len(text)
                if out and (len(out) >= 2000 or size >= piece_bytes):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if piece is not None:
            close(True, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def faults(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(k, turn, role, text, blank, truncated, again): again tells that an earlier turn of the conversation has this role and text."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    r = rows.select(F.col(f"`{conv_id}`").alias("k"), F.col(f"`{turn}`").cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    when: Column = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    r = r.select("*", same.alias("same"), when.alias("when"))
    firsts = r.groupBy(F.col("k").alias("k1"), F.col("same").alias("s1")).agg(F.min("when").alias("first"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    joined = r.join(firsts, F.col("k").eqNullSafe(F.col("k1")) & (F.col("same") == F.col("s1")))
    return joined.select("k", "turn", "role", "text", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"), (F.col("when") > F.col("first")).alias("again"))


def repair(rows: DataFrame, *, costs: Costs = Costs(), piece_rows=PIECE_ROWS, piece_bytes=PIECE_BYTES, **names) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired rows) of all conversations that have rows.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces.
    repaired: conv_id, piece (from 0), pieces, repaired (an array of role and text); the pieces in order make the conversation.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    root = shared_dir(spark, "repair")
    order = ["k", "turn", "role", "text"]
    found = small_batches(faults(rows, **names))
    kind = found.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), *T._parse_datatype_string(_PARTS).fields])
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_assemble(costs, piece_rows, piece_bytes, to_arrow_schema(schema)), schema).write.parquet(f"{root}/pieces")
    pieces = spark.read.parquet(f"{root}/pieces")
    whole, parts = pieces.where("whole"), pieces.where("not whole")

    def join_pieces(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["range"], r["at"]))
        total = {c: sum(r[c] for r in rows) for c in COUNTS}
        seen = [t for r in rows for t in (r["first_turn"], r["last_turn"]) if t is not None]
        for a, b in zip(rows, rows[1:]):
            total["illegal"] += illegal_pair(a["last_role"], b["first_role"])
            total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
        cost, audit = chain([ways(r["codes"], costs) for r in rows])
        state, at, out = NOTHING, 0, []
        for i, r in enumerate(rows):
            mine = audit[at:] if i == len(rows) - 1 else audit[at : at + cut_audit(audit[at:], len(r["codes"]))]
            out.append({"k": r["k"], "range": r["range"], "at": r["at"], "piece": i, "pieces": len(rows), "state": state, "part_audit": mine, "whole_audit": audit if not i else None, "cost": cost, "first_turn": min(seen, default=None), "last_turn": max(seen, default=None), **total})
            state, at = follow(mine, state, r["codes"]), at + len(mine)
        return pa.Table.from_pylist(out, joined_schema)

    joined_type = T.StructType([T.StructField("k", kind), *T._parse_datatype_string("range int, at int, piece int, pieces int, state int, part_audit string, whole_audit string, cost bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint").fields])
    joined_schema = to_arrow_schema(joined_type)
    slim = parts.select("k", "range", "at", "codes", "first_turn", "last_turn", *COUNTS, F.col("roles")[0].alias("first_role"), F.element_at("roles", -1).alias("last_role"))
    slim.groupBy("k").applyInArrow(join_pieces, joined_type).write.parquet(f"{root}/joined")
    joined = spark.read.parquet(f"{root}/joined")

    done_type = T.StructType([T.StructField("k", kind), *T._parse_datatype_string("piece int, pieces int, repaired array<struct<role:string,text:string>>").fields])
    done_schema = to_arrow_schema(done_type)

    def edit(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([{"k": r["k"], "piece": r["piece"], "pieces": r["pieces"], "repaired": apply(r["part_audit"], r["state"], r["roles"], r["texts"])[0]}], done_schema)

    texts = parts.select("range", "at", "roles", "texts").join(joined.select("k", "range", "at", "piece", "pieces", "state", "part_audit"), ["range", "at"])
    edited = texts.mapInArrow(edit, done_type)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    facts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    conversations = whole.select(F.col("k").alias("conv_id"), gaps, *facts, "audit", F.lit(1).alias("pieces")).unionByName(joined.where("piece = 0").select(F.col("k").alias("conv_id"), gaps, *facts, F.col("whole_audit").alias("audit"), "pieces"))
    repaired = whole.select(F.col("k").alias("conv_id"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "repaired").unionByName(edited.withColumnRenamed("k", "conv_id"))
    return conversations, repaired


def illegal_pair(a: str, b: str) -> int:
    return int(a[:1] + b[:1] not in LEGAL)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text`, joined by line feeds; conversations of more than one piece are streamed piece by piece."""
    lines = F.concat_ws("\n", F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])))
    text = repaired.select("conv_id", "piece", "pieces", lines.alias("t"), F.size("repaired").alias("n"))
    kind = repaired.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("sha256", T.StringType())])

    def run(batches):
        key, held, begun = None, None, False
        for b in batches:
            keys, shas = [], []
            for k, piece, t, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if not piece:
                    if held is not None:
                        keys.append(key)
                        shas.append(held.hexdigest())
                    key, held, begun = k, hashlib.sha256(), False
                if n:
                    held.update(("\n" * begun + t).encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa_kind), pa.array(shas, pa.string())], names=["conv_id", "sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa_kind), pa.array([held.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)
    long = text.where("pieces > 1").select("conv_id", "piece", "t", "n").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema)
    return text.where("pieces = 1").select("conv_id", F.sha2("t", 256).alias("sha256")).unionByName(long)
