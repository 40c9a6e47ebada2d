"""Chat formatting by schema fingerprints.

A record comes as JSON in any of several layouts.  The sorted nested field paths of a record (list items as
``[]``) hash to its schema fingerprint, and a table from fingerprints to declarative mappings says how
that layout becomes canonical turns.  A template then writes the turns as one string in which control
strings inside texts are escaped reversibly, with the spans of assistant text as the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The control strings of this template and of well-known ones.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = (
    OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>",
)
#: Splits a control string after its first character; doubled where it stands for itself.
ESCAPE = "\\"
_SPECIAL = re.compile("|".join([re.escape(ESCAPE), *(re.escape(c) for c in CONTROL)]))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """A text in which no control string is left; ``unescape`` gives it back."""
    return _SPECIAL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns``: (role, field paths) in order; the present, non-empty fields of a turn are joined by an empty line.
    ``items``: a list of messages instead, with the paths of role and text in a message; roles are renamed by ``roles``.
    """

    name: str
    fields: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()


_SHARE_ROLES = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Mapping("shared", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=_SHARE_ROLES),
    Mapping("prompt", ("prompt", "completion"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system prompt", ("system", "prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("question", "answer"), (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction input", ("instruction", "input", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("nested", ("data.user", "data.assistant"), (("user", ("data.user",)), ("assistant", ("data.assistant",)))),
)


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a record; an empty list or object is a path of its own."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def schema_fingerprint(fields: Iterable[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(fields)).encode(), digest_size=8).hexdigest()


TABLE = {schema_fingerprint(m.fields): m for m in MAPPINGS} | {schema_fingerprint([m.items]): m for m in MAPPINGS if m.items}


def _at(record: object, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: object, fingerprint: str) -> list[tuple[str, str]] | None:
    """The turns of a record of known layout, else None.  Null texts count as empty, null roles as the empty role."""
    mapping = TABLE.get(fingerprint)
    if mapping is None:
        return None
    if mapping.items:
        rename = dict(mapping.roles)
        items = _at(record, mapping.items)
        return [(rename.get(r := _text(_at(x, mapping.role)), r), _text(_at(x, mapping.text))) for x in items or []]
    out = []
    for role, fields in mapping.turns:
        parts = [x for f in fields if (x := _text(_at(record, f)))]
        out.append((role, "\n\n".join(parts)))
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans (start, end) of assistant text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        # A newline ends the role, so one inside it is escaped too (no control string begins with n).
        head, body = f"{OPEN}{escape(role).replace(chr(10), ESCAPE + 'n')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


_ROLE_ESCAPED = re.compile(r"\\([\\n]?)")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((_ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(rest[: rest.rindex(CLOSE)])))
    return turns


_FORMATTED = "fingerprint string, layout string, formatted string, loss_spans array<struct<start:int,end:int>>"


def format_records(records: DataFrame, json_col: str) -> DataFrame:
    """Add fingerprint, layout, formatted and loss_spans to records whose ``json_col`` holds JSON.

    Records of unknown layout, and null or broken JSON, keep a null layout, formatted and loss_spans (broken: a null
    fingerprint too), so that no row is lost.  Code points count in spans.  Clashing columns are replaced.
    """
    added = [x.split()[0] for x in _FORMATTED.split(", ")]
    kept = records.drop(*added)
    at = kept.columns.index(json_col)
    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[tuple] = []
            for raw in batch.column(at).to_pylist():
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError):
                    new.append((None,) * 4)
                    continue
                mark = schema_fingerprint(paths(record))
                turns = canonical(record, mark)
                if turns is None:
                    new.append((mark, None, None, None))
                    continue
                formatted, spans = render(turns)
                new.append((mark, TABLE[mark].name, formatted, [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*new, strict=True)) if new else [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), _FORMATTED])
    return kept.mapInArrow(convert, schema)


def conversation_records(rows: DataFrame, *apart: str) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record a conversation, in the layout that its turns fit.

    A conversation is the rows of one conv_id (null is one like any other) that agree in the columns ``apart``, too; it is one record,
    however many turns it has.
    One question and its answer become a prompt record, a conversation that opens with the system and has one
    exchange a system prompt record, all others a list of messages.  Turns of equal number stand in order of role and
    text; null turns first.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = rows.groupBy("conv_id", *apart).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("content")))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    say = lambda i: F.get("t", F.lit(i))["content"]
    asks = F.to_json(F.struct(say(0).alias("prompt"), say(1).alias("response")))
    led = F.to_json(F.struct(say(0).alias("system"), say(1).alias("prompt"), say(2).alias("response")))
    listed = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    return grouped.select("conv_id", F.when(is_("user", "assistant"), asks).when(is_("system", "user", "assistant"), led).otherwise(listed).alias("record"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted strings back."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        out = []
        for conv_id, formatted, spans, layout in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted), layout))
        columns = list(zip(*out, strict=True)) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back.

    Null roles and texts count as empty, rows without conv_id are one conversation, repeated rows are turns like any other, and turns of
    equal number go by role and text, null numbers first.  A table that has a conversation -1 of its own keeps it: there are then two
    rows of that number.  Other columns aren't read.
    """
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    both = rows.withColumn("added", F.lit(False)).unionByName(extra.withColumn("added", F.lit(True)))
    formatted = format_records(conversation_records(both, "added"), "record")
    return formatted.select("conv_id", "formatted", "loss_spans", "layout").mapInArrow(_digest, _DIGEST)


def sql() -> str:
    """The same rows in DuckDB, from the conversations themselves."""
    special = "|".join([re.escape(ESCAPE), *(re.escape(c) for c in CONTROL)])
    escaped = lambda c: f"(length({c}) + len(regexp_extract_all({c}, '{special}')))"
    newlines = "(length(role) - length(replace(role, chr(10), '')))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, FALSE AS added FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', TRUE), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', TRUE))
), talks AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns,
    coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '') AS loss, list(role {order}) AS roles,
    CAST(sum({len(OPEN) + len(CLOSE) + 2} + {escaped('role')} + {newlines} + {escaped('text')}) AS BIGINT) AS formatted_chars
  FROM said GROUP BY conv_id, added
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'response' WHEN roles = ['system', 'user', 'assistant'] THEN 'system prompt' ELSE 'messages' END AS layout
FROM talks
"""
