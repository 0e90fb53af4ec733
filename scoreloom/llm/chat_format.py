"""Conversations to training text: a finite-state machine over roles and a declarative template.

Every turn becomes segments with a loss flag. Control strings inside texts are escaped by a backslash, and
backslashes by another, so that the output can be read back exactly. Turns are streamed in order: neither formatting nor
reading back ever holds a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. ``names``: display name of each known role; any other role is written as ``role=<role>``."""

    open: str = "### "
    close_name: str = ": "
    close: str = "</turn>"
    after: str = "\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)

    def escape(self, text: str, *more: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in (self.open, self.close, *more):
            text = text.replace(control, "\\" + control)
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        name = self.names.get(role) or "role=" + self.escape(role, self.close_name)
        return [(self.open + name + self.close_name, False), (self.escape(text), role in self.loss_roles), (self.close + self.after, False)]

    def parse(self, written: str) -> tuple[str, str]:
        """Role and text of one written turn."""
        plain = r"((?:[^\\]|\\.)*?)"
        found = re.fullmatch(re.escape(self.open) + plain + re.escape(self.close_name) + plain + re.escape(self.close + self.after), written, flags=re.DOTALL)
        if not found:
            raise ValueError(f"not a written turn: {written[:80]!r}")
        name = found[1]
        known = {v: k for k, v in self.names.items()}
        return known[name] if name in known else self.unescape(name.removeprefix("role=")), self.unescape(found[2])


# States of the machine: the role before, "" at the start. Missing transitions are violations.
TRANSITIONS = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}

_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_conversations(conversations: DataFrame, template: Template = Template(), transitions: dict[str, set[str]] | None = None) -> DataFrame:
    """Written turns of ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, place (0, 1, ... in order of turn, then role, then text), segments (text, loss) and allowed: whether
    the machine permits the turn after the one before. Turns out of order are written all the same and flagged. Null texts and roles
    are empty; a null turn comes first; rows with a null conv_id are one conversation. Repeated rows are turns of
    their own. A conversation's rows meet in one task in order, one at a time. An empty table gives no rows.
    """
    allowed = transitions or TRANSITIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place, started = None, "", 0, False
        for batch in batches:
            ids, places, written, fine = batch.column("conv_id").to_pylist(), [], [], []
            for c, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if not started or c != conv:
                    conv, state, place, started = c, "", 0, True
                places.append(place)
                fine.append(role in allowed.get(state, ()))
                written.append([{"text": t, "loss": l} for t, l in template.segments(role, text)])
                state, place = role, place + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(written, _SEGMENTS), pa.array(fine, pa.bool_())],
                ["conv_id", "place", "segments", "allowed"],
            )

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, place long, segments array<struct<text:string,loss:boolean>>, allowed boolean")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests per conversation, from the written segments alone; ``formatted`` must be as ``format_conversations`` gives it.

    Returns conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars and loss_sha256 (text under
    the loss flag, unescaped), formatted_chars, n_violations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_violations"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        current = None
        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "place", "segments", "allowed")]
            for conv, place, segments, fine in zip(*columns):
                if place == 0:
                    if current:
                        done.append(current)
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                whole = "".join(s["text"] for s in segments)
                role, text = template.parse(whole)
                learned = "".join(template.unescape(s["text"]) for s in segments if s["loss"])
                current[1] += 1
                current[2].update(f"{role}\n{text}\n".encode())
                current[3] += len(learned)
                current[4].update(learned.encode())
                current[5] += len(whole)
                current[6] += not fine
            if done:
                yield rows(done, names, kinds)
        if current:
            yield rows([current], names, kinds)

    def rows(done: list, names: list, kinds: list) -> pa.RecordBatch:
        values = [[d[0], d[1], d[2].hexdigest(), d[3], d[4].hexdigest(), d[5], d[6]] for d in done]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*values), kinds)], names)

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_violations long")


ORACLE = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
w AS (
    SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN role
              ELSE 'role=' || replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: ') END AS name,
           replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS body,
           lag(role, 1, '') OVER o AS previous, row_number() OVER o AS place
    FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
       sum(4 + length(name) + 2 + length(body) + 8)::BIGINT AS formatted_chars,
       sum(CASE WHEN (previous = '' AND role IN ('system', 'user')) OR (previous IN ('system', 'assistant') AND role = 'user')
                  OR (previous = 'user' AND role = 'assistant') THEN 0 ELSE 1 END)::BIGINT AS n_violations
FROM w GROUP BY conv_id
"""
