"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. ``Flattener`` visits the parts in order and
writes one segment of text per turn: texts escaped, attachments as placeholders, with
a record of every attachment (kind, reference, place in the segment, tokens it expands
to). The template of a turn is::

    ### role: content</turn>\n

Control strings cannot appear inside a role or text: ``\\`` becomes ``\\\\``, ``#`` becomes
``\\#``, ``:`` in a role becomes ``\\:``, ``</`` becomes ``<\\/`` and ``<|`` becomes ``<\\|``.
Dropping each escaping backslash gives the text back.

Segments are made wherever the rows lie. A conversation's segments are then read in
turn order as a stream, so a conversation of any length is handled in the memory of
one Arrow batch; its digests need all its text in order, so it cannot be split further.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,at:int,tokens:int>>, expanded_tokens long"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 576


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Flattener:
    """Visitor over typed parts; ``pieces`` and ``attachments`` hold what it has written."""

    pieces: list = field(default_factory=list)
    attachments: list = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_unknown)(part)

    def write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil((part.get(k) or 1) / PATCH)) for k in ("width", "height"))
        self.attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self.attach(part, 1)

    def attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self.write(f"<|{escape(part['kind'])}:{len(self.attachments) - 1}|>")


def flatten_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict]]:
    """Segment, loss span within it (empty unless an assistant speaks), attachments."""
    role = role or ""
    out = Flattener()
    out.write(f"{OPEN}{escape_role(role)}{MIDDLE}")
    start = out.length
    for part in parts or ():
        out.visit(part)
    end = out.length if role == "assistant" else start
    out.write(CLOSE)
    return "".join(out.pieces), start, end, out.attachments


def segments(turns: DataFrame) -> DataFrame:
    """Formatted segments, one per row of ``turns`` (conv_id, turn, role, text or parts).

    A column ``parts`` (array of typed parts) is used where it is present and not null;
    else ``text`` is the one text part, a null text being empty. Null roles are empty
    roles. Other columns are ignored. An empty table gives an empty table.
    """
    if "parts" in turns.columns:
        text = F.col("text") if "text" in turns.columns else F.lit(None).cast("string")
        turns = turns.select("conv_id", "turn", "role", text.alias("text"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    else:
        turns = turns.select("conv_id", "turn", "role", "text", F.lit(None).cast(f"array<{PART}>").alias("parts"))

    attachment = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())]))

    def run(batches):
        for b in batches:
            made = []
            for role, text, parts in zip(b["role"].to_pylist(), b["text"].to_pylist(), b["parts"].to_pylist(), strict=True):
                made.append((role or "", *flatten_turn(role, [{"kind": "text", "text": text}] if parts is None else parts)))
            roles, segs, starts, ends, atts = zip(*made, strict=True) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"].cast(pa.int64()), b["turn"].cast(pa.int64()), pa.array(roles, pa.string()), pa.array(segs, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(atts, attachment), pa.array([sum(a["tokens"] for a in x) for x in atts], pa.int64())],
                ["conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return turns.mapInArrow(run, SEGMENT)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)


class ReadBack:
    """Parses a conversation's formatted text, fed in pieces, and digests what it says."""

    def __init__(self, conv_id):
        self.conv_id, self.rest = conv_id, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, segment: str, loss_start: int, loss_end: int) -> None:
        masked = unescape(segment[loss_start:loss_end])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(segment)
        self.rest += segment
        at = 0
        while found := _TURN.match(self.rest, at):
            self.turns.update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
            self.n_turns += 1
            at = found.end()
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id}: formatted text does not end with a turn")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted segments.

    Turns with equal numbers are taken in order of role, then segment; null turn
    numbers come first and null ids form one conversation. Repeated rows are repeated
    turns.
    """

    def run(batches):
        now, done = None, []
        for b in batches:
            columns = (b[c].to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))
            for conv_id, segment, start, end in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = ReadBack(conv_id)
                now.feed(segment, start, end)
            if len(done) >= 1000:
                yield _digest_batch(done)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield _digest_batch(done)

    rows = formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
    rows = rows.repartition(common.partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return rows.mapInArrow(run, DIGEST)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


TRAP = r"\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digests`` of all ``conversations`` and of one more, -7, whose texts look like markup. Null texts
    and roles are empty, repeated rows repeated turns; without conversations -7 is the only one.
    These rows carry text alone: attachments and their token counts are columns of ``segments``."""
    talks = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], talks.schema)
    return digests(segments(talks.unionByName(trap)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/'), '<|', '<\|')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + n + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
