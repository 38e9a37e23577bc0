"""Mixing sources to target weights by Sainte-Lague apportionment; columns and SQL functions only.

* A source's target is its share by weight of ``volume`` times all sizes, at most ``passes`` times its
  own size; what a source cannot take is shared again by weight until none is above its limit.
* The mix has blocks of ``block`` words each. Blocks go to sources by highest quotients
  (target / 1, 3, 5, ...), and a source's blocks to its shards the same way by their words. A shard
  is a seeded group of about ``shard_docs`` documents, so a source of any size spreads over many.
* In a shard the documents lie in seeded order on a line of words, laid out once per pass. Its quota is
  that many consecutive blocks from a seeded start, round the line. So most documents are taken whole,
  and none more than ``passes`` times.

Everything is derived from ids and sizes, so reruns agree. Only ids and sizes are shuffled, and only
tables of one row per source or shard meet in one window.

Defined cases: a null text has size 0; a null source is a source, the last; null ids are hashed as the
word null; repeated rows lie next to each other in the line and are taken each for itself; sources
without words get target 0; empty tables stay empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import word_count, written

BLOCK = 64
SHARD_DOCS = 1000
SEED = 7


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """(group, party, seats) by highest quotients votes / (2k + 1); ties go to the smaller party.

    With n parties the divisor lies between those for seats - n and seats + n, so each party's first
    seats are certain and about 2n quotients in all are left to rank.
    """
    everyone = Window.partitionBy(group)
    count, total = F.count(F.lit(1)).over(everyone), F.sum(votes).over(everyone)
    share = lambda n: F.coalesce(F.floor(F.col(votes) * n / F.nullif(total, F.lit(0)) + 0.5), F.lit(0))
    sure = F.when(F.col(seats) > count, share(F.col(seats) - count)).otherwise(F.lit(0)).cast("long")
    # Two projections: the windows above are settled before their results are summed again.
    known = parties.select(group, party, votes, seats, sure.alias("sure"),
                           share(F.col(seats) + count).cast("long").alias("most"))
    open_ = known.withColumn("open", F.col(seats) - F.sum("sure").over(everyone))
    order = Window.partitionBy(group).orderBy(F.desc("quotient"), party, "seat")
    won = (open_.withColumn("seat", F.explode(F.sequence("sure", "most")))
           .withColumn("quotient", F.col(votes) / (2 * F.col("seat") + 1))
           .withColumn("won", (F.row_number().over(order) <= F.col("open")).cast("long")))
    return (won.groupBy(group, party).agg((F.first("sure") + F.sum("won")).alias("blocks")))


def source_targets(sized: DataFrame, weights: Sequence[int], volume: float, passes: int) -> DataFrame:
    """(source, k, docs, source_size, target): k numbers the sources by code point, null last."""
    by_name = Window.partitionBy("all").orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    sources = (sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
               .withColumn("all", F.lit(0)).withColumn("k", F.row_number().over(by_name))
               .withColumn("w", weight).withColumn("limit", float(passes) * F.col("source_size")))
    # Sources fill up in the order of limit / weight. The level reached if all before i are full rises
    # up to the first that stays below its limit and falls after it.
    filling = Window.partitionBy("all").orderBy(F.col("limit") / F.col("w"), "k")
    before = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy("all")
    level = (F.lit(volume) * F.sum("source_size").over(everyone) - before) / behind
    return (sources.withColumn("level", level)
            .withColumn("target", F.least("limit", F.col("w") * F.max("level").over(everyone)))
            .select("all", "source", "k", "docs", "source_size", "target"))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def _digits(text: Column) -> Column:
    """A number from the first eight digits of a hexadecimal hash."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[int], *, volume: float = 1.5, passes: int = 2,
        id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
        shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    key = F.coalesce(docs[id].cast("string"), F.lit("null"))
    sized = written(docs.select(
        docs[id].alias("id"), docs[source].alias("source"), word_count(docs[text]).alias("size"),
        F.md5(F.concat(F.lit(f"mix:{seed}:"), key)).alias("h")), "mix-sizes")
    sources = written(source_targets(sized, weights, volume, passes), "mix-sources")
    total = F.floor(F.sum("target").over(Window.partitionBy("all")) / block + 0.5).cast("long")
    quotas = apportion(sources.withColumn("seats", total), "all", "k", "target", "seats")
    sources = written(sources.join(quotas, ["all", "k"]), "mix-quotas")

    # Small written tables: the planner sends them along if their size allows.
    named = sized.withColumnRenamed("source", "own")
    placed = (named.join(sources, F.col("own").eqNullSafe(F.col("source")))
              .withColumn("shard", _digits(F.reverse("h")) % F.ceil(F.col("docs") / shard_docs)))
    shards = placed.groupBy("k", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    won = apportion(shards, "k", "shard", "words", "blocks").withColumnRenamed("blocks", "quota")
    shards = written(shards.join(won, ["k", "shard"]).select("k", "shard", "words", "quota"), "mix-shards")

    line = Window.partitionBy("k", "shard").orderBy("h", F.col("id").asc_nulls_first(), "size")
    start = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = (placed.withColumn("start", start).join(shards, ["k", "shard"])
            .withColumn("round", F.floor(passes * F.col("words") / block).cast("long"))
            .withColumn("from", _digits(F.md5(F.concat(F.lit(f"start:{seed}:"), F.col("k").cast("string"),
                                                       F.lit(":"), F.col("shard").cast("string"))))
                        % F.greatest("round", F.lit(1)) * block)
            .withColumn("to", F.col("from") + F.col("quota") * block))
    taken = F.lit(0)
    for n in range(passes):
        a = n * F.col("words") + F.col("start")
        b = a + F.col("size")
        ring = F.col("round") * block
        taken = (taken + _overlap(a, b, F.col("from"), F.least("to", ring))
                 + _overlap(a, b, F.lit(0), F.col("to") - ring))
    whole = (F.col("quota") > 0) & (F.col("quota") >= F.col("round"))
    return laid.select(F.col("id").alias(id), "size", "source_size", "target",
                       F.when(whole, passes * F.col("size")).otherwise(taken).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int], *, id: str = "doc_id", text: str = "text",
                    source: str = "source", **options) -> DataFrame:
    """The documents of the mix, whole: a row for each time half of a document or more is taken.

    Only the two documents at the ends of a shard's quota are taken in part, so rounding moves a source
    from its target by a document a shard at most. Copies of a row with equal id, text and source are
    told apart by nothing, so what the mix takes of them is dealt out in any order: each gets its even
    share, and as many as are left over get one more. A document without words stays once.
    """
    key, more, each = f"{id} of row", "more in the mix", "times in the mix"
    row = F.xxhash64(docs[id], docs[text], docs[source])
    taken = mix(docs.withColumn(key, row), weights, id=key, text=text, source=source, **options)
    copies = written(taken.where("size > 0").select(
        F.col(key).alias("row of the mix"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("long").alias("times"))
        .groupBy("row of the mix").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n"))
        .select("row of the mix", F.floor(F.col("times") / F.col("n")).alias("each"),
                F.pmod("times", "n").alias("more")), "mix-copies")
    words = word_count(docs[text])
    counted = (docs.join(copies, row == copies["row of the mix"], "left")
               .select(*(docs[c] for c in docs.columns),
                       F.when(words == 0, F.lit(1)).otherwise(F.coalesce(copies["each"], F.lit(0))).cast("int").alias(each),
                       F.coalesce(copies.more, F.lit(0)).alias(more), copies["row of the mix"].alias(key)))
    some = counted.where(F.col(more) == 0).drop(more, key)
    if copies.where("more > 0").head(1):
        some = some.unionByName(_dealt(counted.where(F.col(more) > 0), key, more, each))
    some = some.where(F.col(each) > 0)
    return some.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(each)))).drop(each)


def _dealt(rows: DataFrame, key: str, more: str, each: str) -> DataFrame:
    """One more to the first ``more`` rows of each ``key``, numbered in chunks, so a group of any size is cut."""
    rows = written(rows.withColumn("place in the mix", F.monotonically_increasing_id()), "mix-uneven")
    rows = rows.withColumn("chunk of the mix", F.shiftright("place in the mix", 12))
    chunk = [key, "chunk of the mix"]
    before = (rows.groupBy(*chunk).count()
              .withColumn("before the chunk", F.sum("count").over(Window.partitionBy(key).orderBy("chunk of the mix"))
                          - F.col("count")).drop("count"))
    number = F.row_number().over(Window.partitionBy(*chunk).orderBy("place in the mix")) + F.col("before the chunk")
    return (rows.join(before, chunk)
            .withColumn(each, F.when(number <= F.col(more), F.col(each) + 1).otherwise(F.col(each)))
            .drop(more, "place in the mix", "before the chunk", *chunk))


def mix_sql(weights: Sequence[int], volume: float = 1.5, passes: int = 2, block: int = BLOCK,
            shard_docs: int = SHARD_DOCS, seed: int = SEED, table: str = "documents") -> str:
    """The same rows in DuckDB SQL, from a table with doc_id, source and text."""
    def apportioned(name: str, parties: str, group: str, party: str, votes: str, seats: str) -> str:
        return f"""
    {name}_known AS (
      SELECT *, CASE WHEN {seats} > count(*) OVER g THEN coalesce(floor({votes} * ({seats} - count(*) OVER g)
                  / nullif(sum({votes}) OVER g, 0)::DOUBLE + 0.5), 0) ELSE 0 END::BIGINT AS sure,
             coalesce(floor({votes} * ({seats} + count(*) OVER g)
                  / nullif(sum({votes}) OVER g, 0)::DOUBLE + 0.5), 0)::BIGINT AS most
      FROM {parties} WINDOW g AS (PARTITION BY {group})),
    {name}_open AS (
      SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS open FROM {name}_known),
    {name}_ranked AS (
      SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * q + 1)::DOUBLE DESC, {party}, q) AS place
      FROM (SELECT *, unnest(range(sure, most + 1)) AS q FROM {name}_open)),
    {name} AS (
      SELECT {group}, {party}, (first(sure) + count(*) FILTER (place <= open))::BIGINT AS won
      FROM {name}_ranked GROUP BY {group}, {party})"""
    overlaps = " + ".join(
        f"greatest(0, least({n} * words + start + size, {upto}) - greatest({n} * words + start, {low}))"
        for n in range(passes) for low, upto in (("begin", f"least(until, ring * {block})"), ("0", f"until - ring * {block}")))
    return f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             md5('mix:{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM {table}),
    numbered AS (
      SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, 0 AS every,
             row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
    weighed AS (
      SELECT *, {list(weights)}[(k - 1) % {len(weights)} + 1] AS w, {float(passes)} * source_size AS most_of FROM numbered),
    levels AS (
      SELECT *, ({volume}::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(most_of) OVER (
                ORDER BY most_of / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (
                ORDER BY most_of / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
    targets AS (SELECT *, least(most_of, w * max(level) OVER ()) AS target FROM levels),
    voted AS (SELECT *, floor(sum(target) OVER () / {block} + 0.5)::BIGINT AS seats FROM targets),
    {apportioned("by_source", "voted", "every", "k", "target", "seats")},
    placed AS (
      SELECT sized.*, k, source_size, target, won AS blocks,
             ('0x' || substr(reverse(h), 1, 8))::BIGINT % ceil(docs / {shard_docs}::DOUBLE)::BIGINT AS shard
      FROM sized JOIN voted ON sized.source IS NOT DISTINCT FROM voted.source JOIN by_source USING (k)),
    shards AS (
      SELECT k, shard, sum(size)::BIGINT AS words, first(blocks) AS blocks FROM placed GROUP BY k, shard),
    {apportioned("by_shard", "shards", "k", "shard", "words", "blocks")},
    laid AS (
      SELECT placed.*, words, won AS quota, {passes} * words // {block} AS ring,
             ('0x' || substr(md5('start:{seed}:' || k || ':' || shard), 1, 8))::BIGINT
               % greatest({passes} * words // {block}, 1) * {block} AS begin,
             sum(size) OVER (PARTITION BY k, shard ORDER BY h, doc_id NULLS FIRST, size
                             ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
      FROM placed JOIN shards USING (k, shard) JOIN by_shard USING (k, shard)),
    ended AS (SELECT *, begin + quota * {block} AS until FROM laid)
    SELECT doc_id, size, source_size, target::DOUBLE AS target,
           (CASE WHEN quota > 0 AND quota >= ring THEN {passes} * size ELSE {overlaps} END)::BIGINT AS taken
    FROM ended"""
