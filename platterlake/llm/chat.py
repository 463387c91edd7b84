"""Chat formatting: conversations rebuilt from their event logs, then rendered with a template.

Template: each turn is `### `, the role, `: `, the text, `</turn>` and a line feed. In roles and texts a
backslash goes before each backslash, `#`, `<` and `:`, so no mark of the template can stand inside a text,
and taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_SPECIAL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BODY = r"((?:[^\\#<:]|\\.)*)"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_TURN = re.compile(rf"### {_BODY}: {_BODY}</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold_events(events: Iterable[dict]) -> list[tuple[str, str]]:
    """(role, text) of the final messages, from events in order.

    `message` adds a message. `delta` adds its text to the newest message of its turn, or starts one. `edit`
    puts its text in the place of that message's. `regenerate` empties that message, so that the deltas after
    it stream the new answer; its own text, if any, is the start. Unknown kinds count as `message`.
    """
    messages: list[list] = []
    newest: dict = {}
    for e in events:
        kind, turn, text = e["kind"], e["turn"], e["text"] or ""
        if kind in ("delta", "edit", "regenerate") and turn in newest:
            m = messages[newest[turn]]
            m[1] = m[1] + [text] if kind == "delta" else [text]
            m[0] = m[0] or e["role"]
        else:
            newest[turn] = len(messages)
            messages.append([e["role"], [text]])
    return [(role or "", "".join(parts)) for role, parts in messages]


def render(messages: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[dict]]:
    """The formatted text and the [start, stop) code-point spans of it that the loss covers."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role == loss_role:
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(
    events: DataFrame,
    conv_col: str = "conv_id",
    seq_col: str = "turn",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    kind_col: str | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: (conv_id, formatted string, loss array<struct<start, stop>>).

    Events are gathered by conversation (the lists are built before the shuffle too), sorted by sequence,
    then role and text where it ties, null sequence last, and folded. Without `kind_col` each row is a
    message. Null text or role: empty. Null conversation id: a conversation of its own. Repeated rows: a turn
    each. Ids of any type pass as they are. A conversation, being one text, is folded in the task that returns it.
    Empty table: no rows. Other columns are ignored.
    """
    kind = F.coalesce(F.col(kind_col), F.lit("message")) if kind_col else F.lit("message")
    event = F.struct(
        F.col(seq_col).isNull().alias("last"),
        F.col(seq_col).alias("seq"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        kind.alias("kind"),
        F.col(turn_col).alias("turn"),
    )
    logs = events.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(event)).alias("log"))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(fold_events(log), loss_role) for log in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], _SPANS)], ["conv_id", "formatted", "loss"])

    kind_of_id = logs.schema["conv_id"].dataType.simpleString()
    return logs.mapInArrow(formatted, f"conv_id {kind_of_id}, formatted string, loss array<struct<start: bigint, stop: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and their loss spans say."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                said = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), _sha(said), len(text)))
            found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind_of_id = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(digests, f"conv_id {kind_of_id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def hard_case(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    said = r"\### Assistant: </turn> ok"
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<:]', '..', 'g'))
            + length('### : </turn>') + 1 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
