"""Chat formatting: turns with typed parts become one marked-up text with a loss mask, and are read back exactly.

A turn's content is a list of typed parts (text, image, audio, document). A visitor flattens it in order: text stays
text, any other part becomes a numbered placeholder `<|kind:n|>`; the attachment's reference and the number of tokens it
expands to are recorded beside it. A part expands by its own `tokens` where given, else by its kind's fixed count.

The template writes a turn as

    ### role:
    content</turn>

Inside roles and contents a backslash doubles, `#` becomes `\\#` and every `<` becomes `\\l`, so neither marker nor a
placeholder can be forged, not even by parts that follow each other: the reader undoes this exactly. In a role a line
end becomes `\\n`. The loss mask covers the contents of the chosen roles, without markers.

Each turn is formatted where it is; conversations are assembled by a sort within partitions and streamed turn by turn,
so a conversation of any length needs one turn of memory.

Defined results: a null text is empty; a null role is an empty role; turns with equal numbers are ordered by their
formatted form; a null conv_id is a conversation of its own; an unknown part kind is a placeholder of that kind with 0 tokens.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that an attachment expands to where the part doesn't say.
EXPANDS = {"image": 256, "audio": 375, "document": 1024}
PARTS = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"

_ESCAPE = [("\\", "\\\\"), ("#", "\\#"), ("<", "\\l")]
_NAMED = {"n": "\n", "l": "<"}
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\n]*):\n(.*?)</turn>\n", re.S)
_SLOT = re.compile(r"<\|([^|]*):(\d+)\|>")


def escape(text: str) -> str:
    for a, b in _ESCAPE:
        text = text.replace(a, b)
    return text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _NAMED.get(m[1], m[1]), text)


class Visitor:
    """Flattens one turn's parts; afterwards `text` is the content, `attachments` what its placeholders stand for."""

    def __init__(self):
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_attachment)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_attachment(self, part: dict) -> None:
        kind, n = part["kind"], len(self.attachments) + 1
        tokens = part.get("tokens")
        self.out.append(f"<|{escape(kind).replace(':', ';').replace('|', '!')}:{n}|>")
        self.attachments.append({"number": n, "kind": kind, "ref": part.get("ref"), "tokens": EXPANDS.get(kind, 0) if tokens is None else tokens})

    @property
    def text(self) -> str:
        return "".join(self.out)


def format_turn(role: str, parts: list[dict | None]) -> tuple[str, int, int, list[dict]]:
    """(segment, start and end of the content in it, attachments)."""
    v = Visitor()
    for p in parts:
        v.visit(p)
    head = "### " + escape(role).replace("\n", "\\n") + ":\n"
    return head + v.text + "</turn>\n", len(head), len(head) + len(v.text), v.attachments


def format_turns(turns: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text", parts=None, loss_roles=("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, segment, loss_start, loss_end (code points in the segment; equal: no loss), attachments, expanded_tokens.

    `parts` names a column of PARTS; without it the text column is a single text part.
    """
    content = F.col(parts).cast(PARTS) if parts else F.array(F.struct(F.lit("text").alias("kind"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))
    picked = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    schema = T.StructType([picked.schema["conv_id"], picked.schema["turn"]] + T._parse_datatype_string("segment string, loss_start bigint, loss_end bigint, attachments array<struct<number:bigint,kind:string,ref:string,tokens:bigint>>, expanded_tokens bigint").fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        for b in batches:
            rows = [format_turn(r, p or []) for r, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            loss = [r in loss_roles for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] if k else 0 for x, k in zip(rows, loss, strict=True)], pa.int64()),
                    pa.array([x[2] if k else 0 for x, k in zip(rows, loss, strict=True)], pa.int64()), pa.array([x[3] for x in rows], made.field("attachments").type), pa.array([sum(a["tokens"] for a in x[3]) for x in rows], pa.int64()),
                ],
                names=schema.names,
            )

    return picked.mapInArrow(run, schema)


def read_segment(segment: str) -> tuple[str, str]:
    """(role, content still escaped) of one formatted turn."""
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), m[2]


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted turns alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Partitions are sorted by conversation and turn and streamed; digests grow turn by turn. A placeholder is read as itself.
    """
    ordered = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    schema = T.StructType([ordered.schema["conv_id"]] + T._parse_datatype_string("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields)

    def run(batches):
        key, state = None, None

        def close():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            done = []
            for k, segment, lo, hi in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if state is None or k != key:
                    if state is not None:
                        done.append(close())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_segment(segment)
                text, loss = unescape(content), unescape(segment[lo:hi])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if done:
                yield _rows(done, schema)
        if state is not None:
            yield _rows([close()], schema)

    return ordered.mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)
