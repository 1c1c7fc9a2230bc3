"""Chat formatting with typed content parts.

A turn is a role and an ordered array of parts (text, image, audio, document). A visitor walks the parts of each turn
and writes text escaped, and one placeholder for each attachment; it records the attachment's place, reference and
expanded token count, and the character spans under the loss mask (text parts of ``loss_roles``).

A formatted turn is ``### role: body</turn>`` and a line feed. A conversation is its turns' pieces in order, so a
conversation of any length is formatted and read as a stream of rows and never held whole. Its rows pass through one task,
since a digest is sequential by nature.
Escapes are reversible: ``\\`` comes before each ``\\``, ``###``, ``</turn>``, ``<|`` of a text and, in roles, ``:``.

Cases: a null role, text or part list is empty; a null reference or size is empty or 0; a part of unknown type is
written as a ``file`` placeholder of one token; equal turns of a conversation are ordered by role and text; a null
conversation id is one conversation; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
_TEXT = re.compile(r"\\|###|</turn>|<\|")
_ROLE = re.compile(r"\\|###|</turn>|<\||:")
_BACK = re.compile(r"\\(\\|###|</turn>|<\||:)")
#: What a reader meets: an escape, a placeholder, or the end of the role or the turn.
_BODY_END = re.compile(r"\\(?:\\|###|</turn>|<\|)|</turn>\n")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|<\||:)|: ")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "conv_id long, turn long, seq long, role string, formatted string, loss array<struct<start:int,end:int>>,"
    " attachments array<struct<type:string,ref:string,start:int,end:int,n_tokens:int>>"
)


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def expanded_tokens(part: dict) -> int:
    """Tokens that the attachment's placeholder stands for: 28-pixel image patches, 25 a second of audio, 512 a page."""
    kind = part.get("type")
    if kind == "image":
        return max(1, -(-(part.get("width") or 0) // 28) * -(-(part.get("height") or 0) // 28))
    if kind == "audio":
        return max(1, round((part.get("seconds") or 0.0) * 25))
    if kind == "document":
        return max(1, 512 * (part.get("pages") or 0))
    return 1


class Visitor:
    """Flattens one turn; start and end of spans count characters of the turn's piece."""

    def __init__(self, role: str, loss: bool):
        self.out = [OPEN, _ROLE.sub(lambda m: "\\" + m[0], role), ": "]
        self.at = sum(map(len, self.out))
        self.loss, self.spans, self.attachments = loss, [], []
        self.pending: list[str] = []  # text parts side by side are escaped as one, so none of their joints reads as a control string

    def write(self, s: str) -> tuple[int, int]:
        self.out.append(s)
        self.at += len(s)
        return self.at - len(s), self.at

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            self.pending.append(part.get("text") or "")
            return
        self.flush()
        kind = kind if kind in ("image", "audio", "document") else "file"
        n = expanded_tokens(part)
        start, end = self.write(f"<|{kind}:{len(self.attachments)}:{n}|>")
        self.attachments.append({"type": kind, "ref": part.get("ref") or "", "start": start, "end": end, "n_tokens": n})

    def flush(self) -> None:
        start, end = self.write(escape("".join(self.pending)))
        self.pending.clear()
        if self.loss and end > start:
            self.spans.append({"start": start, "end": end})

    def close(self) -> str:
        self.flush()
        self.write(CLOSE)
        return "".join(self.out)


def with_parts(conversations: DataFrame, text: str = "text") -> DataFrame:
    """Plain rows (a text for each turn) as turns with one text part."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))),
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> one formatted row for each turn, sorted within conversations.

    Rows are dealt by conversation and sorted on the executors' disks; ``seq`` counts a conversation's turns from 0.
    """
    rows = (
        turns.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.to_json("parts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, schema = object(), 0, None
        for b in batches:
            out = {n: [] for n in ("conv_id", "turn", "seq", "role", "formatted", "loss", "attachments")}
            for conv, turn, role, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seq = seq + 1 if conv == last else 0
                last = conv
                v = Visitor(role, role in loss_roles)
                for p in parts:
                    if p is not None:
                        v.visit(p)
                for n, x in zip(out, (conv, turn, seq, role, v.close(), v.spans, v.attachments), strict=True):
                    out[n].append(x)
            schema = schema or pa.schema(
                [
                    ("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
                    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ("attachments", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32())]))),
                ]
            )
            yield pa.RecordBatch.from_pydict(out, schema)

    return rows.mapInArrow(run, FORMATTED)


def parse(piece: str) -> Iterator[tuple[str, str]]:
    """(role, body still escaped) of each turn of formatted text, by its control strings alone."""
    at = 0
    while at < len(piece):
        if not piece.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        begin = at = at + len(OPEN)
        while (m := _ROLE_END.search(piece, at))[0] != ": ":
            at = m.end()
        role, begin = unescape(piece[begin : m.start()]), m.end()
        at = begin
        while (m := _BODY_END.search(piece, at))[0] != CLOSE:
            at = m.end()
        yield role, piece[begin : m.start()]
        at = m.end()


def digests(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """Read formatted turns back: one row for each conversation with digests of its turns and of the masked text.
    dealt: formatted comes straight from format_turns, whose rows lie together and in order; else they are dealt anew.

    Turns are taken from the formatted text by its control strings, never from the columns beside it. Hashes are
    updated turn by turn, so memory doesn't grow with a conversation.
    """
    rows = formatted.select("conv_id", "seq", "formatted", "loss")
    rows = rows if dealt else rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(s):
            return (s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["length"])

        state = None
        for b in batches:
            done = []
            for conv, seq, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != state["conv"]:
                    if state is not None:
                        done.append(row(state))
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
                for role, body in parse(text):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{unescape(body)}\n".encode())
                for s in spans:
                    masked = unescape(text[s["start"] : s["end"]])
                    state["chars"] += len(masked)
                    state["loss"].update(masked.encode())
                state["length"] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(state), types, strict=True)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Of conversations with the trap of the registered query.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(regexp_replace(role, '(\\|###|</turn>|<\||:)', '#\1', 'g'))
              + length(regexp_replace(text, '(\\|###|</turn>|<\|)', '#\1', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
