"""Chat formatting: records of unlike layouts to one template with a loss mask.

The nested field paths of a JSON record that some mapping knows, sorted and hashed, are its schema fingerprint; other
fields, such as ids and names, are left aside. The fingerprint selects a declarative mapping, which says where the turns
are, what role and text each has, and which role names of that layout mean others. Turns then go into a template
whose marks cannot occur in texts: the first character of every control string in a role or text is replaced by an
escape, and backslashes are doubled, so that reading back is exact. Half a surrogate pair, which JSON can spell and UTF-8
can't, becomes an escape too.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that steer common chat models, and this template's own marks; none survives inside a role or text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
_TO_ESCAPE = re.compile("\\\\|[\ud800-\udfff]|(?:" + "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + ")")
_TO_PLAIN = re.compile(r"\\(?:[\\lbp]|u[0-9a-f]{4})")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(CLOSE), re.DOTALL)
LEARNED = "assistant"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _ESCAPED.get(m[0]) or f"\\u{ord(m[0]):04x}", text)


def unescape(text: str) -> str:
    return _TO_PLAIN.sub(lambda m: _PLAIN.get(m[0]) or chr(int(m[0][2:], 16)), text)


def paths(value: object, within: frozenset[str] | None = None) -> set[str]:
    """The nested field paths of a parsed record; all elements of a list count as one. It may be nested to any depth; where within is given, only what lies at or above one of those paths is looked at."""
    found, open_ = set(), [("", value)]
    while open_:
        at, value = open_.pop()
        if within is not None and at not in within:
            continue
        if isinstance(value, dict) and value:
            open_ += ((f"{at}.{k}" if at else k, v) for k, v in value.items())
        elif isinstance(value, list):
            open_ += ((f"{at}[]", v) for v in value or (None,))
        else:
            found.add(at)
    return found


def fingerprint(fields: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _said(value: object) -> str:
    """A field as text; of a list of parts their texts, one after the other."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "".join(_said(part.get("text") if isinstance(part, dict) else part) for part in value)
    return json.dumps(value)


@dataclass(frozen=True)
class Mapping:
    """turns: the field that lists the turns (none: the record is one turn, or `parts` names a turn each); role and text: fields of a turn; parts: (role, fields joined by a blank line); roles: (name in this layout, what it means)."""

    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.parts:
            said = [(role, "\n\n".join(_said(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in self.parts]
            return [x for x in said if x[1]]
        turns = record.get(self.turns) or [] if self.turns else [record]
        named = dict(self.roles)
        return [(named.get(_said(t.get(self.role)), _said(t.get(self.role))), _said(t.get(self.text))) for t in turns if isinstance(t, dict)]


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_LAYOUTS = (
    (("role", "text"), Mapping(role="role", text="text")),
    (("role", "content"), Mapping(role="role", text="content")),
    (("messages[].role", "messages[].content"), Mapping("messages", "role", "content")),
    (("messages[].role", "messages[].content[].text"), Mapping("messages", "role", "content")),
    (("messages[].role", "messages[].content", "messages[].content[].text"), Mapping("messages", "role", "content")),
    (("messages[].role", "messages[].text"), Mapping("messages", "role", "text")),
    (("conversations[].from", "conversations[].value"), Mapping("conversations", "from", "value", roles=_SPEAKERS)),
    (("prompt", "completion"), Mapping(parts=(("user", ("prompt",)), ("assistant", ("completion",))))),
    (("prompt", "response"), Mapping(parts=(("user", ("prompt",)), ("assistant", ("response",))))),
    (("instruction", "output"), Mapping(parts=(("user", ("instruction",)), ("assistant", ("output",))))),
    (("instruction", "input", "output"), Mapping(parts=(("user", ("instruction", "input")), ("assistant", ("output",))))),
    (("system", "instruction", "input", "output"), Mapping(parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))))),
)
MAPPINGS = {fingerprint(set(fields)): mapping for fields, mapping in _LAYOUTS}
#: The field paths that count in a fingerprint.
KNOWN = frozenset(f for fields, _ in _LAYOUTS for f in fields)


def _parsed(record: str | None) -> object:
    """None for a null record and for one that isn't JSON."""
    try:
        return json.loads(record) if record else None
    except (ValueError, RecursionError):
        return None


def _above(known: frozenset[str]) -> frozenset[str]:
    """The paths and all beginnings of them at a field or a list."""
    return frozenset({""} | {p[: m.start()] for p in known for m in re.finditer(r"\.|\[\]|$", p)} | {p[: m.end()] for p in known for m in re.finditer(r"\[\]", p)})


def _format(mappings: dict[str, Mapping], known: frozenset[str] | None):
    within = None if known is None else _above(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict[frozenset[str], str] = {}
        for batch in batches:
            out: list[tuple] = []
            for conv_id, place, record in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "record")), strict=True):
                parsed = _parsed(record)
                if not isinstance(parsed, dict):
                    out.append((conv_id, place, None, None, None, None))
                    continue
                fields = frozenset(paths(parsed) if known is None else paths(parsed, within) & known)
                if fields not in prints:
                    prints[fields] = fingerprint(fields)
                mapping = mappings.get(prints[fields])
                try:
                    turns = mapping.read(parsed) if mapping else []
                except RecursionError:  # what stands for a text is nested too deep to be written as one
                    mapping, turns = None, []
                for role, text in turns:
                    head, body = OPEN + escape(role) + SAYS, escape(text)
                    learned = role == LEARNED
                    out.append((conv_id, place, prints[fields], head + body + CLOSE, len(head) if learned else None, len(head) + len(body) if learned else None))
                if mapping is None:
                    out.append((conv_id, place, prints[fields], None, None, None))
            kinds = [("conv_id", pa.int64()), ("place", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    return run


def format_records(records: DataFrame, mappings: dict[str, Mapping] | None = None, known: frozenset[str] | None = None) -> DataFrame:
    """records(conv_id, place, record), record a JSON object: one row for each turn, with layout (the schema fingerprint), formatted, loss_start, loss_end.

    The formatted conversation is the concatenation of its turns by place; the loss mask is the code points from
    loss_start to loss_end of an assistant's turn, null for others. A record whose fingerprint has no mapping gives one
    row with nulls, so that it can be seen and mapped, and so does one whose text is nested too deep to be written; one that is
    null or no JSON object gives a row without layout. Null roles and texts are empty. With mappings of one's own, `known` names the field paths that count (none: all).
    """
    known = KNOWN if mappings is None else known
    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("place").cast("long").alias("place"), "record").mapInArrow(_format(MAPPINGS if mappings is None else mappings, known), "conv_id long, place long, layout string, formatted string, loss_start long, loss_end long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted turns, sorted by conversation, back from the output; a conversation streams through two hash states."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_unmapped", pa.int64())]
    encoded = lambda s: s.encode("utf-8", "surrogatepass")
    now, state, out = object(), None, []

    def closed() -> None:
        if state is not None:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    for batch in batches:
        for conv_id, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if state is None or conv_id != now:
                closed()
                now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[5] += formatted is None
            for m in _TURN.finditer(formatted or ""):
                state[0] += 1
                state[1].update(encoded(f"{unescape(m[1])}\n{unescape(m[2])}\n"))
            if start is not None:
                learned = unescape(formatted[start:end])
                state[2] += len(learned)
                state[3].update(encoded(learned))
            state[4] += len(formatted or "")
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    closed()
    if out:
        yield batch_of(out)


def digests(records: DataFrame) -> DataFrame:
    """One row for each conv_id of records: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted turns, and n_unmapped, the records that gave no turns.

    Turns stand by place, null first, then by the record's text. A null conv_id is one conversation.
    """
    whole = records.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place", "record")
    return format_records(whole).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unmapped long")


def records_of(conversations: DataFrame, mixed: bool = False) -> DataFrame:
    """conversations(conv_id, turn, role, text) as one JSON record for each row; mixed: in one of three layouts, by conv_id."""
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    plain, content = as_json(F.struct(role.alias("role"), text.alias("text"))), F.struct(role.alias("role"), text.alias("content"))
    listed = as_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.array(content).alias("messages")))
    of = F.pmod(F.col("conv_id").cast("long"), F.lit(3))
    record = F.when(of == 1, as_json(content)).when(of == 2, listed).otherwise(plain) if mixed else plain
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("place"), record.alias("record"))
