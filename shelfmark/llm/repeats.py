"""Substring dedup over whole corpora: seed and extend on winnowed anchors.

A window of ``length`` consecutive words is a repeat if the same words also start earlier (smaller
id, or same document and earlier start). Every word that a repeat covers is removed.

* Seed. A window's anchor is the smallest hash among its ``seed``-word grams, so equal windows have
  equal anchors and equal passages share all anchors inside. Consecutive windows with one anchor
  form a run; a run with its anchor stands for the passage around it.
* Join. Only anchors that occur twice can lie in a repeat. Bit tables of fixed size drop most others
  before anything is shuffled; what passes them by chance costs work, not correctness. Only places that are
  the first of their kind are taken further, again by a bit table: runs and windows are not shuffled to find them.
* Chain. Neighbouring runs of a document that pass are one chain, all but the first and last of them, whose
  windows reach over the edge of a passage. Chains whose words agree repeat as a whole: a passage common
  to many documents is one row in each, not one for every run. Only chains that agree with no other,
  and the earliest of those that do, are taken apart into runs.
* Extend. Runs whose whole words agree repeat as a whole. Where one anchor stands in different
  surroundings, at the ends of repeated passages, each window around it, left and right, is looked
  up. Adjacent windows merge into the maximal repeat.

All grouping is a minimum with map-side combine, and all joins are plain equi-joins, so an anchor
that holds a third of all rows is split like any other. Texts of documents with repeats are shuffled
once, at the end; the others are not.

Defined cases: null and blank texts have no words; rows with a null id come before all others; rows
that repeat an id are ordered by a hash of their text, and rows equal in both stand at one place,
so none repeats the other; empty tables stay empty; other columns are not read, or kept as they are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfmark.llm.common import written

LENGTH = 20
SEED_WORDS = 6
#: The bit tables of anchors have 2 ** TABLE_BITS bits, 32 MB, whatever the corpus.
TABLE_BITS = 28
FINER = 12

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequences:
    """Hashes of any word sequence of one text, from one pass over its words."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]):
        import xxhash
        n = len(words)
        while len(self.powers) <= n:
            size = max(4096, 2 * len(self.powers))
            for name, base in (("powers", _ODD), ("inverses", _ODD_INVERSE)):
                steps = np.full(size, base)
                steps[0] = 1
                setattr(Sequences, name, np.cumprod(steps, dtype=np.uint64))
        each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(each * self.powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts])

    def all_of(self, size: int) -> np.ndarray:
        """Hashes of every sequence of ``size`` words."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.inverses[:n])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


class Runs:
    """The runs of one text: anchor, hash of the whole run, first and last window start."""

    def __init__(self, text: str | None, length: int, seed: int):
        words = text.encode().split() if text else []
        self.length = length
        if len(words) < length:
            self.first = self.last = np.empty(0, np.int64)
            self.anchor = np.empty(0, np.uint64)
            return
        self.hashes = Sequences(words)
        grams = self.hashes.all_of(seed)
        # The low bits carry the place; it is read back relative to the window.
        low = np.uint64(0xFFFF)
        marked = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
        least = _sliding_least(marked, length - seed + 1) & low
        window = np.arange(len(least), dtype=np.int64)
        place = window + ((least.astype(np.int64) - window) & 0xFFFF)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.first, self.last = starts, np.r_[starts[1:], len(place)] - 1
        self.anchor = grams[place[starts]]

    def whole(self, some) -> np.ndarray:
        first, last = self.first[some], self.last[some]
        return _mix(self.hashes.of(first, last + self.length) + (last - first).astype(np.uint64))

    def windows(self) -> np.ndarray:
        return self.hashes.all_of(self.length)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _mark(docs: DataFrame, id: str, text: str) -> Column:
    """Tells rows with equal ids apart: a hash of the text, or nothing if no id is repeated."""
    repeated = docs.groupBy(docs[id].cast("long").alias("doc")).count().where("count > 1").head(1)
    return F.xxhash64(docs[text]) if repeated else F.lit(0).cast("long")


def _repeated_slots(rows: DataFrame, hashes, bits: int) -> DataFrame:
    """Slots of a bit table for the values that occur more than once among ``hashes(value)`` of all rows.

    Values are counted by FINER more bits than the table has, so few of them share a count by chance.
    """
    def run(batches):
        for batch in batches:
            found = np.concatenate([np.empty(0, np.uint64), *map(hashes, batch.column(0).to_pylist())])
            value, n = np.unique(found >> np.uint64(64 - bits - FINER), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)),
                                              pa.array(np.minimum(n, 2).astype(np.int32))], ["value", "n"])
    return (rows.mapInArrow(run, "value long, n int").groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
            .select(F.shiftright("value", FINER).cast("int").alias("slot")))


def _bit_table(slots: DataFrame, bits: int):
    """A broadcast bit table of fixed size with the given slots set."""
    words = (slots.groupBy((F.col("slot") / 64).cast("int").alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("word"))).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return slots.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))


def _held(table) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table.value), np.uint64)


def _passes(table: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    slot = anchors >> np.uint64(64 - bits)
    return np.flatnonzero((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))


def _place_slot(bits: int) -> Column:
    """The slot of a place (doc, mark, first) in a bit table; ``_at_places`` looks the same slot up."""
    return F.expr(f"cast(shiftrightunsigned(xxhash64(doc, mark) ^ shiftleft(cast(first as long), 40), {64 - bits}) as int)")


def _at_places(table: np.ndarray, keys: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Which of the places, given as xxhash64(doc, mark) and first, the table has."""
    return _passes(table, keys.view(np.uint64) ^ (first.astype(np.uint64) << np.uint64(40)), bits)


def _chain_starts(some: np.ndarray) -> np.ndarray:
    """Where chains begin among the run numbers ``some``: first and last run of neighbours are alone."""
    if not len(some):
        return np.empty(0, np.int64)
    first = np.r_[True, np.diff(some) != 1]
    last = np.r_[first[1:], True]
    return np.flatnonzero(first | last | np.r_[False, first[:-1]])


_CHAINS = ("head long, chain long, doc long, mark long, first int, last int, "
           "runs array<struct<anchor:bigint,whole:bigint,first:int,last:int>>")


def _chain_rows(texts: DataFrame, table, length: int, seed: int, bits: int) -> DataFrame:
    """A row for each chain of runs whose anchors pass the table, with its runs."""
    def run(batches):
        held = _held(table)
        for batch in batches:
            parts = []
            for n, t in enumerate(batch.column(2).to_pylist()):
                runs = Runs(t, length, seed)
                some = _passes(held, runs.anchor, bits)
                if len(some):
                    starts = _chain_starts(some)
                    ends = np.r_[starts[1:], len(some)]
                    first, last = runs.first[some], runs.last[some]
                    low, high = first[starts], last[ends - 1]
                    chain = _mix(runs.hashes.of(low, high + length) + (high - low).astype(np.uint64))
                    parts.append((np.full(len(starts), n), runs.anchor[some[starts]], chain, low, high, ends - starts,
                                  runs.anchor[some], runs.whole(some), first, last))
            if not parts:
                continue
            at, head, chain, low, high, size, anchor, whole, first, last = (np.concatenate(c) for c in zip(*parts))
            at, ints = pa.array(at), [pa.array(c.astype(np.int32)) for c in (low, high, first, last)]
            inner = pa.StructArray.from_arrays([_signed(anchor), _signed(whole), *ints[2:]], ["anchor", "whole", "first", "last"])
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [_signed(head), _signed(chain), batch.column(0).take(at), batch.column(1).take(at), *ints[:2],
                 pa.ListArray.from_arrays(offsets, inner)], ["head", "chain", "doc", "mark", "first", "last", "runs"])
    return texts.mapInArrow(run, _CHAINS)


def _runs_at(chains: DataFrame, table, bits: int) -> DataFrame:
    """The runs of the chains whose places the table has."""
    def run(batches):
        held = _held(table)
        for batch in batches:
            some = pa.array(_at_places(held, batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))
            yield batch.select(["doc", "mark", "runs"]).take(some)
    keyed = chains.select(F.xxhash64("doc", "mark").alias("key"), "first", "doc", "mark", "runs")
    return (keyed.mapInArrow(run, StructType([keyed.schema[c] for c in ("doc", "mark", "runs")]))
            .select("doc", "mark", F.inline("runs")))


def _edge_rows(texts: DataFrame, anchors, places, length: int, seed: int, bits: int) -> DataFrame:
    """A row for each run whose anchor and place the tables have, with the hashes of its windows."""
    def run(batches):
        known, wanted = _held(anchors), _held(places)
        for batch in batches:
            parts = []
            docs, marks, keys = batch.column(0), batch.column(1), batch.column(3).to_numpy()
            for n, t in enumerate(batch.column(2).to_pylist()):
                runs = Runs(t, length, seed)
                some = _passes(known, runs.anchor, bits)
                some = some[_at_places(wanted, keys[n:n + 1], runs.first[some], bits)]
                if len(some):
                    raw, first, last = runs.windows(), runs.first[some], runs.last[some]
                    parts.append((np.full(len(some), n), runs.anchor[some], first,
                                  [raw[a:b + 1].tobytes() for a, b in zip(first, last)]))
            if parts:
                at, anchor, first = (np.concatenate(c) for c in list(zip(*parts))[:3])
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), docs.take(at), marks.take(at), pa.array(first.astype(np.int32)),
                     pa.array([w for p in parts for w in p[3]], pa.binary())], names)

    schema = "anchor long, doc long, mark long, first int, windows binary"
    names = [column.split()[0] for column in schema.split(", ")]
    return texts.withColumn("key", F.xxhash64("doc", "mark")).mapInArrow(run, schema)


def _windows_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _window_rows(firsts: DataFrame, table, bits: int) -> DataFrame:
    """A row for each window of the given runs that passes the table."""
    def run(batches):
        held = _held(table)
        for batch in batches:
            raw = batch.column(4).to_pylist()
            size = np.fromiter((len(w) // 8 for w in raw), np.int64, len(raw))
            at = np.repeat(np.arange(len(raw)), size)
            start = batch.column(3).to_numpy()[at] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            windows = _windows_of(b"".join(raw))
            some = _passes(held, windows, bits)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(pa.array(at[some])) for n in range(3)),
                 pa.array(start[some].astype(np.int32)), _signed(windows[some])],
                ["anchor", "doc", "mark", "start", "window"])
    return (firsts.select("anchor", "doc", "mark", "first", "windows")
            .mapInArrow(run, "anchor long, doc long, mark long, start int, window long"))


def repeat_windows(docs: DataFrame, mark: Column, *, id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   seed: int = SEED_WORDS, bits: int = TABLE_BITS) -> DataFrame:
    """(doc, mark, first, last): every window start from first to last is a repeat.

    ``mark`` tells rows with equal ids apart.
    """
    texts = docs.select(docs[id].cast("long").alias("doc"), mark.alias("mark"), docs[text].alias("text"))
    table = _bit_table(_repeated_slots(texts.select("text"), lambda t: Runs(t, length, seed).anchor, bits), bits)
    chains = written(_chain_rows(texts, table, length, seed, bits), "chains")
    table.destroy()
    place = F.struct("doc", "mark", "first")
    slot = _place_slot(bits).alias("slot")
    same = ["head", "chain"]
    chain_classes = written(chains.groupBy(*same).agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")),
                            "chain-classes")
    # Chains that agree with an earlier one are repeats as they are.
    spans = (chains.drop("runs").join(chain_classes.where("n > 1").drop("n"), same)
             .where(F.col("earliest") < place).select("doc", "mark", "first", "last"))
    # Every run, and the earliest of each kind, is in the earliest chain of a class.
    left = _bit_table(chain_classes.select("earliest.*").select(slot), bits)
    runs = _runs_at(chains, left, bits)
    classes = written(runs.groupBy("anchor", "whole")
                      .agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")), "run-classes")

    # Runs that agree as a whole with an earlier one.
    whole = (runs.join(classes.where("n > 1").select("anchor", "whole", "earliest"), ["anchor", "whole"])
             .where(F.col("earliest") < place).select("doc", "mark", "first", "last")).union(spans)

    # Anchors in different surroundings: the windows of the earliest run of each kind.
    value = F.expr(f"shiftrightunsigned(anchor, {64 - bits - FINER})").alias("value")
    mixed = (classes.groupBy(value).count().where("count > 1")
             .select(F.shiftright("value", FINER).cast("int").alias("slot")))
    anchors = _bit_table(mixed, bits)
    places = _bit_table(classes.select("earliest.*").select(slot), bits)
    firsts = written(_edge_rows(texts, anchors, places, length, seed, bits), "edge-runs")
    anchors.destroy()
    places.destroy()
    table = _bit_table(_repeated_slots(firsts.select("windows"), _windows_of, bits), bits)
    windows = _window_rows(firsts, table, bits)
    at = F.struct("doc", "mark", "start")
    earliest = (windows.groupBy("anchor", "window")
                .agg(F.min(at).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    single = (windows.join(earliest, ["anchor", "window"]).where(F.col("earliest") < at)
              .select("doc", "mark", F.col("start").alias("first"), F.col("start").alias("last")))
    found = written(whole.union(single), "repeat-windows")
    table.destroy()
    left.destroy()
    return found


def _finish(docs: DataFrame, finish, schema: StructType, *, id: str, text: str, bits: int = TABLE_BITS,
            **options) -> DataFrame:
    """``finish(columns, repeats)`` of all rows; repeats is null or a list of window starts (first, last).

    A bit table of documents with repeats lets the others pass without a shuffle.
    """
    names = docs.columns
    mark = _mark(docs, id, text)
    key = F.xxhash64("doc", "mark")
    found = written(repeat_windows(docs, mark, id=id, text=text, bits=bits, **options).groupBy("doc", "mark")
                    .agg(F.collect_list(F.struct("first", "last")).alias("repeats")), "repeats")
    table = _bit_table(found.select(F.expr(f"cast(shiftrightunsigned(xxhash64(doc, mark), {64 - bits}) as int)")
                                    .alias("slot")), bits)
    keyed = docs.select(*(docs[c].alias(f"column {n}") for n, c in enumerate(names)),
                        docs[id].cast("long").alias("doc"), mark.alias("mark"))
    keyed = keyed.withColumn("key", key)
    width = len(names)

    def hit(held, batch):
        some = np.zeros(batch.num_rows, bool)
        some[_passes(held, batch.column(width + 2).to_numpy().view(np.uint64), bits)] = True
        return some

    def concerned(batches):
        held = _held(table)
        for batch in batches:
            yield batch.filter(pa.array(hit(held, batch)))

    def others(batches):
        held = _held(table)
        for batch in batches:
            batch = batch.filter(pa.array(~hit(held, batch)))
            yield finish(batch.columns[:width], [None] * batch.num_rows)

    def joined(batches):
        for batch in batches:
            yield finish(batch.columns[:width], batch.column(width).to_pylist())

    some = keyed.mapInArrow(concerned, keyed.schema)
    some = (some.join(found, some.doc.eqNullSafe(found.doc) & (some.mark == found.mark), "left")
            .select(*some.columns[:width], found.repeats))
    return some.mapInArrow(joined, schema).union(keyed.mapInArrow(others, schema))


def covered(n: int, repeats: list | None, length: int) -> np.ndarray:
    """For each of n words whether a repeat covers it."""
    change = np.zeros(n + 1, np.int64)
    if repeats:
        np.add.at(change, [r["first"] for r in repeats], 1)
        np.add.at(change, [r["last"] + length for r in repeats], -1)
    return np.cumsum(change[:n]) > 0


def kept_words(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH,
               **options) -> DataFrame:
    """(id, n_words, n_removed, kept): kept words joined by one space."""
    def finish(columns, repeats):
        rows = []
        for t, some in zip(columns[1].to_pylist(), repeats):
            words = t.encode().split() if t else []
            gone = covered(len(words), some, length)
            kept = [w for w, x in zip(words, gone.tolist()) if not x] if some else words
            rows.append((len(words), int(gone.sum()), b" ".join(kept).decode()))
        found = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [columns[0], *(pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.string())))], schema.names)

    schema = StructType([docs.schema[id], StructField("n_words", LongType()),
                         StructField("n_removed", LongType()), StructField("kept", StringType())])
    return _finish(docs.select(id, text), finish, schema, id=id, text=text, length=length, **options)


def cut_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH,
                **options) -> DataFrame:
    """The same columns with repeats cut out of the text; what stays keeps its own white space.

    A document of which no word stays is dropped; a text that had no words stays as it is.
    """
    names = docs.columns
    at = names.index(text)
    word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def finish(columns, repeats):
        texts, keep = columns[at].to_pylist(), [True] * len(repeats)
        for n, some in enumerate(repeats):
            if some:
                raw = texts[n].encode()
                cuts = [m.span() for m in word.finditer(raw)]
                gone = covered(len(cuts), some, length).tolist()
                texts[n] = b"".join(raw[a:b] for (a, b), x in zip(cuts, gone) if not x).decode().rstrip()
                keep[n] = bool(texts[n])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return _finish(docs, finish, docs.schema, id=id, text=text, length=length, **options)
