"""Chat formatting: where each turn of a rendered conversation lies, found by rendering prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import rows_out, slices

Turn = tuple[str, str]  # role, text
#: ``render(turns, opening)`` gives the whole text of the turns; with ``opening``, a role, also the
#: beginning of one more turn, up to where its text would start.
Template = Callable[[list[Turn], str | None], str]

CONTROL = re.compile(r"\\|<(?=/?turn>)|###(?= )")
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and every control string of the template."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    """A role ends at the first colon, so colons are escaped too."""
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn], opening: str | None = None) -> str:
    """``<turn>### role: text</turn>`` per line, with texts and roles escaped."""
    out = [f"<turn>### {escape_role(role)}: {escape(text)}</turn>\n" for role, text in turns]
    if opening is not None:
        out.append(f"<turn>### {escape_role(opening)}: ")
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that :func:`turn_template` made."""
    found = re.findall(r"<turn>### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/?turn>))*)</turn>\n", formatted, re.S)
    return [(unescape(role), unescape(text)) for role, text in found]


def spans(turns: list[Turn], template: Template, additive: bool = False) -> tuple[str, list[tuple[int, int]] | None]:
    """The rendered conversation and each text's (start, end) in it; None where there are none.

    The template is a black box. Every prefix is rendered; what a prefix adds to the one before it is
    the new turn. A rendered opening of that turn tells where its text starts, a rendering with an
    empty text how much closes it. A prefix that does not begin with the one before it shows that the
    template rewrites history: turns then have no fixed place, and the spans are None.

    All prefixes together take time with the square of the turns. ``additive`` is the caller's word
    that the template renders a turn alike wherever it stands: turns are then rendered one by one, and
    must add up to the whole.
    """
    whole = template(turns, None)
    found, at, previous = [], 0, template([], None)
    at = len(previous)
    parts = [previous]
    for i, (role, text) in enumerate(turns):
        context = [] if additive else turns[:i]
        before = template([], None) if additive else previous
        now = template([*context, (role, text)], None)
        opened = template(context, role)
        emptied = template([*context, (role, "")], None)
        if not (now.startswith(opened) and opened.startswith(before) and emptied.startswith(opened)):
            return whole, None
        closing = emptied[len(opened) :]
        if not now.endswith(closing) or len(now) < len(opened) + len(closing):
            return whole, None
        added = len(now) - len(before)
        found.append((at + len(opened) - len(before), at + added - len(closing)))
        at += added
        if additive:
            parts.append(now[len(before) :])
        previous = now
    return whole, found if whole == ("".join(parts) if additive else previous) else None


FIELDS = {
    "conv_id": pa.int64(), "formatted": pa.string(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()),
    "roles": pa.list_(pa.string()), "rewrites_history": pa.bool_(),
}
SCHEMA = "conv_id long, formatted string, starts array<long>, ends array<long>, roles array<string>, rewrites_history boolean"


def format_chats(conversations: DataFrame, template: Template = turn_template, additive: bool = False) -> DataFrame:
    """One row per conversation: its formatted text and the code-point span of each turn's text.

    Rows are ordered by turn, equal or null turns by role and text (nulls first). Null texts and
    roles count as empty; rows with a null conv_id form one conversation; repeated rows are turns of
    their own; an empty table gives no rows; other columns are not read. A template that rewrites
    history, after however many turns, has ``rewrites_history`` true and null spans. One conversation
    is one string and is rendered by one task, all of its prefixes, so time grows with the square of
    its turns; a template declared ``additive`` is rendered turn by turn, see :func:`spans`.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    grouped = grouped.select("conv_id", F.transform("said", lambda s: s["role"]).alias("roles"), F.transform("said", lambda s: s["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in FIELDS}
            for conv_id, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                formatted, found = spans(list(zip(roles, texts)), template, additive)
                for k, v in zip(FIELDS, (conv_id, formatted, found and [s for s, _ in found], found and [e for _, e in found], roles, found is None)):
                    out[k].append(v)
            yield rows_out(FIELDS, out)

    return grouped.mapInArrow(run, SCHEMA)


DIGEST_FIELDS = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back: turns, and the text under the loss mask.

    Roles and texts come from the formatted text alone; spans that do not hold just those texts raise.
    Conversations without spans have no loss mask; null texts and ids stay what they are: no turn, null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in DIGEST_FIELDS}
            for conv_id, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                turns = parse(text)
                held = [unescape(text[a:b]) for a, b in zip(starts or [], ends or [])]
                if starts is not None and held != [t for _, t in turns]:
                    raise ValueError(f"conversation {conv_id}: its spans are not those of the turns read back")
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                loss = "".join(t for (r, _), t in zip(turns, held) if r == "assistant")
                row = (conv_id, len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text))
                for k, v in zip(DIGEST_FIELDS, row):
                    out[k].append(v)
            yield rows_out(DIGEST_FIELDS, out)

    return formatted.select("conv_id", "formatted", "starts", "ends").mapInArrow(run, DIGEST_SCHEMA)


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), sized AS (
  SELECT conv_id, turn, role, text,
         length('<turn>### : </turn>') + 1 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
         + len(regexp_extract_all(text, '</?turn>')) + length(text) - length(replace(text, '### ', '## ')) AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
