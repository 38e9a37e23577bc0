r"""Chat records of many layouts to canonical turns, and turns to training text with a loss mask.

* Layouts. A record is one JSON object. Its fingerprint is the hash of the sorted set of its nested field
  paths (``messages[].role``). A table of declarative mappings, expanded over their optional paths,
  gives each known fingerprint its mapping: which list holds the turns, which fields are role and
  text, which fields become turns of which role. A record with further fields takes the mapping whose
  required paths it has most of, once per fingerprint; others stay as rows without a layout.
* Text. Turns are marked by control strings of a template. Where a text itself holds a control string, a
  backslash is put after its first character; one that already has backslashes there gets one more. So
  escaped text never holds a control string, and taking one backslash out restores any text.
* Order. Marked turns are shuffled by conversation and streamed in order; a conversation becomes one row,
  or several pieces cut between turns where it exceeds ``PIECE_CHARS``. No task holds more than a piece.
  Conversations of one piece are read back without a shuffle.

Defined cases: a null text or role is empty. A record that gives no id field takes the hash of its
JSON as id; an id that is null keeps its rows together in one conversation. Turns are ordered by
their number (null first), then by their place in the record, then by the marked text; repeated rows are
repeated turns. Roles without marks of their own are written by name. A record that is no JSON object, or
of no known layout, keeps its text in a row without layout: formatting leaves it out,
``unmapped`` returns it. Empty tables stay empty; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Code points after which a conversation is cut, between two turns, into another row.
PIECE_CHARS = 1 << 20

#: Names that sources use for the two sides of a conversation.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: in a list or the record itself (``each``), or in fields (``fields``)."""

    name: str
    each: str | None = None
    role: str = ""
    text: str = ""
    turn: str = ""
    #: (role, paths): the texts of the paths that are not empty, joined by a blank line, are one turn.
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    key: tuple[str, ...] = ("conv_id", "id")
    roles: dict[str, str] = field(default_factory=dict, hash=False, compare=False)

    def required(self) -> frozenset[str]:
        own = [f"{self.each}{p}" for p in (self.role, self.text)] if self.each is not None else []
        own += [self.turn] if self.turn else []
        own += [p for _, some in self.fields for p in some]
        return frozenset(own) - frozenset(self.optional)

    def shapes(self) -> Iterator[frozenset[str]]:
        """Every set of paths of this layout: optional ones there or not, and the list of turns empty."""
        for key in ((), *((k,) for k in self.key)):
            for some in chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1)):
                yield self.required().union(key, some)
                if self.each:
                    rest = self.required().union(key, some)
                    yield frozenset(p for p in rest if not p.startswith(self.each)) | {self.each.removesuffix(".")}


MAPPINGS = (
    Mapping("turn row", each="", role="role", text="text", turn="turn"),
    Mapping("messages", each="messages[].", role="role", text="content", optional=("messages[].name",)),
    Mapping("message parts", each="messages[].", role="role", text="content[].text", optional=("messages[].content[].type",)),
    Mapping("from and value", each="conversations[].", role="from", text="value", optional=("system",),
            fields=(("system", ("system",)),), roles=ROLE_NAMES),
    Mapping("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
            optional=("system", "input")),
    Mapping("prompt and completion", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
            optional=("system",)),
    Mapping("prompt and response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
            optional=("system",)),
    Mapping("question and answer", fields=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)


def paths(value: Any, at: str = "") -> set[str]:
    """The nested field paths of a JSON value down to its scalars; [] stands for any item of a list."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str] | frozenset[str]) -> int:
    import xxhash
    return xxhash.xxh64_intdigest("\n".join(sorted(found)).encode())


def _values(value: Any, path: str) -> list:
    """All scalars at a path, in order."""
    for n, step in enumerate(parts := path.split(".") if path else []):
        name = step.removesuffix("[]")
        value = value.get(name) if isinstance(value, dict) else None
        if step.endswith("[]"):
            rest = ".".join(parts[n + 1:])
            return [x for item in value or [] for x in _values(item, rest)] if isinstance(value, list) else []
    return [value]


def _text(values: list, join: str = "") -> str:
    return join.join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values if v is not None)


class Layouts:
    """Turns of records by the fingerprints of their layouts."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known: dict[int, Mapping | None] = {}
        for mapping in mappings:
            for shape in mapping.shapes():
                self.known.setdefault(fingerprint(shape), mapping)

    def mapping(self, record: Any) -> Mapping | None:
        found = paths(record)
        mark = fingerprint(found)
        if mark not in self.known:
            fits = [m for m in self.mappings if m.required() and m.required() <= found]
            self.known[mark] = max(fits, key=lambda m: len(m.required()), default=None)
        return self.known[mark]

    def turns(self, raw: str | None) -> tuple[str | None, Any, list[tuple[int | None, str, str]]]:
        """(layout, id, turns) of a record in JSON; a turn is (number, role, text)."""
        try:
            record = json.loads(raw or "")
        except ValueError:
            record = None
        mapping = self.mapping(record) if isinstance(record, dict) else None
        if mapping is None:
            return None, None, []
        key = next((record[k] for k in mapping.key if k in record), raw)
        said = [(role, _text([t for p in some if (t := _text(_values(record, p)))], "\n\n"))
                for role, some in mapping.fields if any(v is not None for p in some for v in _values(record, p))]
        if mapping.each is not None:
            for item in [record] if not mapping.each else record.get(mapping.each.removesuffix("[].")) or []:
                role = _text(_values(item, mapping.role))
                said.append((mapping.roles.get(role, role), _text(_values(item, mapping.text))))
        return mapping.name, key, [(_number(record.get(mapping.turn)) if mapping.turn else n, *turn)
                                   for n, turn in enumerate(said)]

    def rows(self, records: list[str | None]) -> list[tuple]:
        """(id, number, place, role, text, layout) of every turn; of a record without layout only its text."""
        out = []
        for raw in records:
            layout, key, turns = self.turns(raw)
            if layout is None:
                out.append((None, None, 0, None, raw, None))
            key = _number(key)
            out += [(key, number, n, role, text, layout) for n, (number, role, text) in enumerate(turns)]
        return out


def _number(value: Any) -> int | None:
    """A whole number as it is, anything else but null by its hash."""
    if value is None or isinstance(value, int) and not isinstance(value, bool) and -2 ** 63 <= value < 2 ** 63:
        return value
    import xxhash
    return xxhash.xxh64_intdigest(str(value).encode()) - 2 ** 63


@dataclass(frozen=True)
class Template:
    """Control strings around turns: of the roles named, and of any other role."""

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: str = "assistant"

    def marks(self) -> list[str]:
        return [*dict.fromkeys([*(m for _, *some in self.roles for m in some), *self.other])]

    def compiled(self) -> tuple[re.Pattern, re.Pattern]:
        heads = "".join(re.escape(h) for h in sorted({m[0] for m in self.marks()}))
        rests = "|".join(re.escape(m[1:]) for m in self.marks())
        return re.compile(rf"([{heads}])(\\*)(?=(?:{rests}))"), re.compile(rf"([{heads}])\\(\\*)(?=(?:{rests}))")


class Marker:
    """Writes and reads turns by a template."""

    def __init__(self, template: Template = Template()):
        self.template = template
        self.add, self.take = template.compiled()
        self.by_role = {role: (a, b) for role, a, b in template.roles}

    def escape(self, text: str) -> str:
        return self.add.sub(r"\1\\\2", text)

    def unescape(self, text: str) -> str:
        return self.take.sub(r"\1\2", text)

    def write(self, role: str, text: str) -> tuple[str, int | None, int | None]:
        """The marked turn, and from where to where the loss counts."""
        body = self.escape(text)
        if role in self.by_role:
            before, after = self.by_role[role]
        else:
            a, b, after = self.template.other
            before = a + self.escape(role) + b
        counts = role == self.template.learned
        return (before + body + after, len(before) if counts else None, len(before) + len(body) if counts else None)

    def read(self, marked: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a marked text."""
        at = 0
        while at < len(marked):
            for role, before, after in self.template.roles:
                if marked.startswith(before, at):
                    at += len(before)
                    break
            else:
                before, middle, after = self.template.other
                if not marked.startswith(before, at):
                    raise ValueError(f"no turn begins at {at}")
                end = marked.index(middle, at)
                role, at = self.unescape(marked[at + len(before):end]), end + len(middle)
            end = marked.index(after, at)
            yield role, self.unescape(marked[at:end])
            at = end + len(after)


_TURNS = "conv_id long, turn long, place int, role string, text string, layout string"


def _arrow(ddl: str) -> pa.Schema:
    """Worked out on the driver: reading DDL needs a session."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def canonical_turns(records: DataFrame, *, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, place, role, text, layout: a row per turn of every JSON record.

    ``place`` is the place in its record; a record of no known layout is one row with only its text.
    """
    def run(batches):
        layouts = Layouts(mappings)
        for batch in batches:
            yield _batch(layouts.rows(batch.column(0).to_pylist()), kinds)
    kinds = _arrow(_TURNS)
    return records.select(record).mapInArrow(run, _TURNS)


def unmapped(turns: DataFrame) -> DataFrame:
    """The records that have no known layout."""
    return turns.where("layout IS NULL").select(F.col("text").alias("record"))


def _marked(records: DataFrame, record: str, mappings: tuple[Mapping, ...], template: Template) -> DataFrame:
    """Records to marked turns in one pass: (conv_id, turn, place, marked, loss_from, loss_to)."""
    def run(batches):
        layouts, marker = Layouts(mappings), Marker(template)
        for batch in batches:
            yield _batch([(*row[:3], *marker.write(row[3] or "", row[4] or ""))
                          for row in layouts.rows(batch.column(0).to_pylist()) if row[5] is not None], kinds)

    schema = "conv_id long, turn long, place int, marked string, loss_from int, loss_to int"
    kinds = _arrow(schema)
    return records.select(record).mapInArrow(run, schema)


_PIECES = "conv_id long, piece int, whole boolean, text string, loss array<struct<from:int,to:int>>"


def _pieces(piece_chars: int):
    """Joins the marked turns of sorted rows, one conversation after the other."""
    kinds = _arrow(_PIECES)

    def run(batches):
        key, texts, spans, size, piece, ready, chars = None, [], [], 0, 0, [], 0

        def close(last: bool) -> None:
            nonlocal texts, spans, size, piece, chars
            if texts:
                ready.append((key, piece, last and piece == 0, "".join(texts), spans))
                chars += size
            texts, spans, size, piece = [], [], 0, 0 if last else piece + 1

        def out():
            nonlocal ready, chars
            if ready:
                yield _batch(ready, kinds)
            ready, chars = [], 0

        for batch in batches:
            for conv, marked, low, high in zip(*(batch.column(n).to_pylist() for n in (0, 3, 4, 5))):
                if texts and conv != key:
                    close(True)
                elif size > piece_chars:
                    close(False)
                key = conv
                texts.append(marked)
                if low is not None:
                    spans.append({"from": size + low, "to": size + high})
                size += len(marked)
            if chars > piece_chars or len(ready) > 512:
                yield from out()
        close(True)
        yield from out()

    return run


def format_chats(records: DataFrame, path: str, *, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS,
                 template: Template = Template(), piece_chars: int = PIECE_CHARS) -> None:
    """Write all conversations to ``path``: conv_id, piece, whole, text, loss (spans of code points)."""
    order = ["conv_id", "turn", "place", "marked"]
    (_marked(records, record, mappings, template).repartition("conv_id").sortWithinPartitions(*order)
     .mapInArrow(_pieces(piece_chars), _PIECES).write.parquet(path))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PIECES).parquet(path)


def fold_chats(chats: DataFrame, start: Callable[[], Any], schema: str, *, template: Template = Template()) -> DataFrame:
    """One row (conv_id, and what ``row()`` gives) per conversation, folded over its turns in order.

    ``start()`` makes an object with ``piece(text)``, ``turn(role, text)``, ``learned(text)`` for the
    unescaped text of every loss span, and ``row()``. ``schema`` names conv_id and the columns of ``row()``.
    """
    def run(batches):
        marker, key, held = Marker(template), None, None
        for batch in batches:
            rows = []
            for conv, piece, text, loss in zip(*(batch.column(n).to_pylist() for n in (0, 1, 3, 4))):
                if held is not None and (piece == 0 or conv != key):
                    rows.append((key, *held.row()))
                    held = None
                key, held = conv, held or start()
                held.piece(text)
                for role, said in marker.read(text):
                    held.turn(role, said)
                for part in loss:
                    held.learned(marker.unescape(text[part["from"]:part["to"]]))
            yield _batch(rows, kinds)
        if held is not None:
            yield _batch([(key, *held.row())], kinds)

    kinds = _arrow(schema)
    parts = chats.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return chats.where("whole").mapInArrow(run, schema).union(parts.mapInArrow(run, schema))
