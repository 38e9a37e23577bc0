"""Document fingerprints as invertible Bloom lookup sketches; columns and SQL functions only.

A text is cut into phrases: at line ends, at sentence ends and after ``PHRASE_WORDS`` words. Its parts
are its distinct phrases, at every length, so an edit changes only the phrases it touches.

Each part digest is added to three cells of a sketch. A cell holds a count, the XOR of its digests and
the XOR of their check sums. The sketches of two versions are subtracted cell by cell: equal parts
cancel, and peeling cells that hold one digest recovers those that differ. The parts that differ are
estimated from a sample of the digests, and the digests dealt to as many sketches that each has about
``BUCKET`` of them to recover. A sketch with cells left over is built again, larger; if even the
largest fails, its digests are compared directly. Likeness is the share of parts (of both sides) that
do not differ.

Defined cases: null and empty texts have no parts; two of them are alike (1), one of them is unlike any
other text (0). Repeated parts count once. Equal texts have equal fingerprints. Neighbours follow
the ascending order of ids, null first, then of a hash of the text; the last is followed by the
first, a single document by itself. Empty tables stay empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

PHRASE_WORDS = 12
#: Differing digests that a sketch is to recover, and sizes up to which no sample is taken.
BUCKET = 6
SAMPLED_FROM = 64
#: One digest in so many is in the sample.
SAMPLE = 8
#: Cells of the first sketch and of each larger one, and of a document's fingerprint. Building costs cells
#: times digests, so many small sketches cost less than few large ones.
CELLS = (24, 48, 96, 384)
FINGERPRINT_CELLS = 24
PEEL_ROUNDS = 16
#: Documents per range of ids that one window holds, and ranges at most.
RANGE_DOCS = 500
MOST_RANGES = 10_000

_PHRASE = r"(?:\S++(?<![.!?])[ \t]++){0,%d}\S++\s*+" % (PHRASE_WORDS - 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, as the finish of a fold over nothing: that copies no value."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def phrases(text: Column) -> Column:
    """Digests of a text's phrases, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PHRASE), F.lit(0))
    return F.transform(found, lambda p: F.xxhash64(p))


def parts(digests: Column) -> Column:
    """Distinct phrase digests, sorted."""
    return F.sort_array(F.array_distinct(digests))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def _places(key: Column, cells: int) -> list[Column]:
    """The place of a digest in each third of the cells, counted from the third's first."""
    return [F.pmod(F.xxhash64(key, F.lit(3 * cells + n)), F.lit(cells // 3)).cast("int").alias(f"p{n}") for n in range(3)]


def _placed(key: Column, n: Column, check: Column, cells: int) -> Column:
    return F.struct(n.alias("n"), key.alias("k"), check.alias("c"), *_places(key, cells))


def _added(cells: Column, entries: Column, third: int, sign: int, cell: Callable[[Column], Column] = lambda c: c) -> Column:
    """The cells of a third after adding (or taking out) the entries; cells that no entry is placed in stay as they are."""
    def step(s, e):
        n = s["n"] + e["n"] if sign > 0 else s["n"] - e["n"]
        return F.struct(n.alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c"))

    def of(places):
        return F.transform(cells, lambda c, at: F.when(F.array_contains(places, at), F.aggregate(
            F.filter(entries, lambda e: e[f"p{third}"] == at), cell(c), step)).otherwise(cell(c)))
    return _let(F.transform(entries, lambda e: e[f"p{third}"]), of)


def sketch(keys: Column, cells: int) -> Column:
    """``cells`` structs (n, k, c)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    entries = F.transform(keys, lambda k: _placed(k, F.lit(1), _check(k), cells))

    third = F.sequence(F.lit(1), F.lit(cells // 3))
    return _let(entries, lambda some: F.concat(*(_added(third, some, n, 1, lambda _: zero) for n in range(3))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"),
                                                  x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, size: int) -> Column:
    """Recovered differing digests as structs (n, k): n is 1 for the first side, -1 for the second.

    Each round goes through the thirds in turn: a digest has one cell in each, so the cells of a third that
    hold a single digest name each digest once; it is then taken out of the other two. Null if cells are left over.
    """
    part = size // 3
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def step(state: Column, third: int) -> Column:
        own = state[f"t{third}"]
        single = F.filter(own, lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["c"]))
        found = F.transform(single, lambda c: _placed(c["k"], c["n"], c["c"], size))

        def without(some: Column, n: int) -> Column:
            if n == third:
                return F.transform(own, lambda c: F.when((F.abs(c["n"]) == 1) & F.exists(
                    some, lambda e: (e["k"] == c["k"]) & (e["c"] == c["c"])), zero).otherwise(c))
            return _added(state[f"t{n}"], some, n, -1)

        return _let(found, lambda some: F.when(F.size(some) == 0, state).otherwise(F.struct(
            *(without(some, n).alias(f"t{n}") for n in range(3)),
            F.concat(state["found"], F.transform(some, lambda e: F.struct(e["n"], e["k"]))).alias("found"),
            state["over"].alias("over"))))

    def round_(state: Column, _: Column) -> Column:
        def ended(last: Column) -> Column:
            return F.struct(*(last[name].alias(name) for name in ("t0", "t1", "t2", "found")),
                            (F.size(last["found"]) == F.size(state["found"])).alias("over"))
        peeled = _let(state, lambda s: _let(step(s, 0), lambda x: _let(step(x, 1), lambda y: _let(step(y, 2), ended))))
        return F.when(state["over"], state).otherwise(peeled)  # later rounds cost nothing

    start = F.struct(*(F.slice(cells, n * part + 1, part).alias(f"t{n}") for n in range(3)),
                     F.array().cast("array<struct<n:int,k:bigint>>").alias("found"), F.lit(False).alias("over"))
    empty = lambda c: (c["n"] == 0) & (c["k"] == 0)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(PEEL_ROUNDS)), start, round_,
        lambda s: F.when(F.forall(s["t0"], empty) & F.forall(s["t1"], empty) & F.forall(s["t2"], empty), s["found"]))


def _sketches(a: Column, b: Column) -> Column:
    """How many sketches the digests of a pair are dealt to, by the estimated number that differ."""
    total = F.size(a) + F.size(b)
    sampled = lambda x: F.filter(x, lambda k: F.pmod(k, F.lit(SAMPLE)) == 0)
    apart = _let(F.struct(sampled(a).alias("x"), sampled(b).alias("y")), lambda s: (
        F.size(F.array_except(s["x"], s["y"])) + F.size(F.array_except(s["y"], s["x"]))) * SAMPLE + 2 * SAMPLE)
    return F.greatest(F.lit(1), F.ceil(F.when(total <= SAMPLED_FROM, total).otherwise(F.least(total, apart)) / BUCKET))


def differing(a: Column, b: Column, ladder: tuple[int, ...] = CELLS) -> Column:
    """The digests of a and b that are not in both, as structs (n, k), through sketches."""
    def plain(x: Column, y: Column, side: int) -> Column:
        return F.transform(F.array_except(x, y), lambda k: F.struct(F.lit(side).alias("n"), k.alias("k")))

    def recovered(p: Column) -> Column:
        def tried(size: int) -> Column:
            return _let(subtract(sketch(p["a"], size), sketch(p["b"], size)), lambda cells: peel(cells, size))
        return F.coalesce(*map(tried, ladder), F.concat(plain(p["a"], p["b"], 1), plain(p["b"], p["a"], -1)))

    def dealt(p: Column, count: Column, place: Callable[[Column], Column]) -> Column:
        """The digests of a pair in ``count`` shares by their place."""
        return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda n: F.struct(
            *(F.filter(p[side], lambda k: place(k) == n).alias(side) for side in "ab")))

    def of(p: Column) -> Column:
        # Dealt out twice, to a root of the sketches each time, so the work is no square of the digests.
        place = lambda k: F.pmod(F.shiftrightunsigned(k, 8), p["sketches"])
        row = p["row"]
        rows = dealt(p, F.ceil(p["sketches"] / row), lambda k: F.floor(place(k) / row))
        return F.flatten(F.transform(rows, lambda r: F.flatten(F.transform(
            dealt(r, row, lambda k: F.pmod(place(k), row)),
            lambda q: F.when(F.size(q["a"]) + F.size(q["b"]) > 0, recovered(q))
            .otherwise(F.array().cast("array<struct<n:int,k:bigint>>"))))))

    counted = F.struct(a.alias("a"), b.alias("b"), _sketches(a, b).alias("sketches"))
    return _let(counted, lambda p: _let(
        F.struct(p["a"].alias("a"), p["b"].alias("b"), p["sketches"].alias("sketches"),
                 F.ceil(F.sqrt(p["sketches"])).alias("row")), of))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of phrase digests: the share of distinct ones that do not differ, 0 to 1."""
    def of(x, y):
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.lit(1.0)).when(x == y, F.lit(1.0)).otherwise(
            1 - F.size(differing(x, y)) / total)
    return _let(F.struct(parts(a).alias("x"), parts(b).alias("y")), lambda q: of(q["x"], q["y"]))


def fingerprint(digests: Column) -> Column:
    """A sketch of a text as hexadecimal digits: count, digest XOR and check of each cell."""
    def text(cells):
        each = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"),
                                                     F.lpad(F.hex(c["c"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
        return F.array_join(each, "")
    return F.lower(_let(sketch(parts(digests), FINGERPRINT_CELLS), text))


def _ranges(docs: DataFrame) -> DataFrame:
    """Adds ``range``: equal shares of the ids in ascending order, null first."""
    count = docs.count()
    ranges = max(1, min(MOST_RANGES, count // RANGE_DOCS))
    shares = [n / ranges for n in range(1, ranges)]
    bounds = (docs.agg(F.percentile_approx("id", shares, 20 * ranges)).head()[0] if shares else None) or []
    bounds = sorted(set(bounds))
    if not bounds:
        return docs.withColumn("range", F.lit(0))
    # Binary search for the number of bounds that are not above the id.
    steps = F.array(*(F.lit(1 << n) for n in reversed(range(len(bounds).bit_length()))))
    edges = F.array(*map(F.lit, bounds))

    def step(at, width):
        fits = (at + width <= len(bounds)) & (F.get(edges, at + width - 1) <= F.col("id"))
        return F.when(fits, at + width).otherwise(at)

    return docs.withColumn("range", F.aggregate(steps, F.lit(0), step))


def with_next(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, next): every text and the text of the next document, in one shuffle of the texts.

    A range of ids is one window group. The first document of a range also goes to the range before,
    as the neighbour of its last one.
    """
    rows = _ranges(docs.select(docs[id].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text")))
    first = (rows.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("named"), F.col("id"))).alias("f"))
             .select("range", F.col("f.id").alias("first"), F.lit(0).alias("all")))
    along = Window.partitionBy("all").orderBy("range")
    last = F.max("range").over(Window.partitionBy("all"))
    before = first.select(F.col("range").alias("own"), "first",
                          F.coalesce(F.lag("range").over(along), last).alias("before"))
    is_first = F.col("id").eqNullSafe(F.col("first"))
    place = lambda where, ghost: F.struct(F.col(where).alias("range"), F.lit(ghost).alias("ghost"))
    # One row per range, MOST_RANGES at most: small enough to send along.
    spread = (rows.join(F.broadcast(before), F.col("range") == F.col("own"))
              .withColumn("places", F.when(is_first, F.array(place("range", False), place("before", True)))
                          .otherwise(F.array(place("range", False))))
              .select("id", "text", F.explode("places").alias("place"))
              .select("id", "text", "place.*"))
    order = Window.partitionBy("range").orderBy("ghost", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return (spread.withColumn("next", F.lead("text").over(order)).where(~F.col("ghost"))
            .select("id", "text", "next"))


def compare_with_edits(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited version, and how alike it is to that and to the next.

    In the edited version the last half of a text (rounded down) gives way to as much of the start of
    the next document.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    cut = (with_next(docs, id=id, text=text)
           .select("id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited")))
    digests = cut.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                         phrases(F.col("text")).alias("a"), phrases(F.col("edited")).alias("e"),
                         phrases(F.col("next")).alias("b"))
    a, e, b = (F.col(c) for c in "aeb")
    return digests.select(F.col("id").alias(id), "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"),
                          fingerprint(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"),
                          likeness(a, b).alias("near_next"))
