"""Ranked lexical search by dense blocked matrix products.

Every item (a query text) ranks all documents by the weights of its terms and the documents' impacts,
in whole numbers. The work is cut into tiles:

* Items go in groups of bounded size, each group's vocabulary is sent along. One pass over the texts
  leaves per document its length and the counts of the group's terms; document frequencies are summed
  from those, so only terms that some item has are ever counted.
* A group is cut into blocks of items with a compact vocabulary of their own. A tile is the product of
  a block's weights (items x terms) and the impacts of a batch of documents (terms x documents), in
  float64. Vocabulary tiles are cut where the largest possible sum reaches 2^53, so every partial sum is
  exact; tiles are added as 64-bit integers.
* Each task keeps the k best of an item over its tiles. What ties with the k-th is kept until the ids
  have decided, so the cut is the same whatever the tiles. The lists of all tasks are merged in levels.

Terms are maximal runs of ASCII letters and digits and of all other characters above ASCII; only A-Z
are lowered. With N documents with terms, L terms in them and df documents with a term, its weight is
floor(1000 ln((2N + 2) / (2 df + 1))). With n terms in the document, m = 50 + (50 n N) div L, and a term
that occurs tf times scores its weight times (10^9 tf) div (1000 tf + 20 m).

Defined cases: null and empty texts have no terms; such items give no rows, such documents are not
counted. Rows of items that repeat id and text are one item; equal ids with different texts, and a null
id, are ranked like any other. Rows of documents that repeat an id each have a rank. Documents
without id come after all others of their score. Scores of 0 give no rows. Empty tables give none;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.llm.common import written

#: Items and bytes of item texts in one group: bounds what is sent along.
GROUP_ITEMS = 4096
GROUP_BYTES = 16 << 20
#: Items of a block and terms of a vocabulary tile: bound the memory of a product.
BLOCK_ITEMS = 64
TILE_TERMS = 4096
#: Partial lists that meet in one merge.
MERGE_FAN_IN = 32
#: Impacts stay below this: 10^9 tf / (1000 tf + 20 m).
MOST_IMPACT = 10 ** 6
EXACT = 2 ** 53

_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() and c < 0x80 else 0x20 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return text.encode().translate(_FOLD).split() if text else []


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of counts ``tf`` in documents of ``n`` terms each."""
    if 50 * n_docs * int(n.max(initial=0)) < 2 ** 63:
        m = 50 + (50 * n_docs * n) // max(1, n_terms)
    else:
        m = np.array([50 + 50 * n_docs * int(x) // n_terms for x in n], np.int64)
    return (10 ** 9 * tf) // (1000 * tf + 20 * m)


class Block:
    """Items with a compact vocabulary: numbers of its terms in the group, and sparse weights."""

    def __init__(self, rows: list[tuple[int, list[int]]], weights: np.ndarray):
        self.items = np.array([item for item, _ in rows], np.int64)
        self.terms, at = np.unique(np.concatenate([np.array(t, np.int64) for _, t in rows]), return_inverse=True)
        self.row = np.repeat(np.arange(len(rows)), [len(t) for _, t in rows])
        self.column, self.weight = at.astype(np.int64), weights[self.terms][at].astype(np.float64)

    def edges(self) -> list[int]:
        """Where its vocabulary is cut so that no sum over a part can reach ``EXACT``."""
        most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(most, self.column, self.weight.astype(np.int64))
        edges, total = [0], 0
        for at, one in enumerate((most * MOST_IMPACT).tolist()):
            if at > edges[-1] and (total + one >= EXACT or at - edges[-1] >= TILE_TERMS):
                edges.append(at)
                total = 0
            total += one
        return [*edges, len(self.terms)]

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, vocabulary: int) -> np.ndarray:
        """items x docs, exact."""
        place = np.full(vocabulary, -1, np.int64)
        place[self.terms] = np.arange(len(self.terms))
        at = place[term]
        some = at >= 0
        doc, at, impact = doc[some], at[some], impact[some]
        total = np.zeros((len(self.items), docs), np.int64)
        edges = self.edges()
        for low, high in zip(edges, edges[1:]):
            mine, theirs = (self.column >= low) & (self.column < high), (at >= low) & (at < high)
            left = np.zeros((len(self.items), high - low))
            left[self.row[mine], self.column[mine] - low] = self.weight[mine]
            right = np.zeros((high - low, docs))
            right[at[theirs] - low, doc[theirs]] = impact[theirs]
            total += (left @ right).astype(np.int64)
        return total


class Best:
    """The k best (score, id) of every item of a block; ids without a name come last."""

    def __init__(self, items: int, k: int):
        self.k, self.low = k, np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]  # item, score, id, nameless

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.low[:, None])  # what ties with the last one still counts
        if not len(item):
            return
        item, score, id, without = (np.concatenate(c) for c in zip(
            self.rows, (item, scores[item, doc], ids[doc], nameless[doc])))
        order = np.lexsort((id, without, -score, item))
        starts = np.flatnonzero(np.r_[True, np.diff(item[order]) > 0])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        order = order[rank < self.k]
        self.rows = [c[order] for c in (item, score, id, without)]
        full = np.flatnonzero(np.bincount(self.rows[0], minlength=len(self.low)) == self.k)
        last = np.searchsorted(self.rows[0], full, "right") - 1
        self.low[full] = self.rows[1][last]


def _item_rows(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, item_id, text): a number for each distinct item, kept in a table so that it stays."""
    return written(items.select(items[id].alias("item_id"), items[text].alias("text")).distinct()
                   .where("text IS NOT NULL").withColumn("item", F.monotonically_increasing_id()), "items")


def _groups(items: DataFrame, most_items: int, most_bytes: int) -> list[DataFrame]:
    """Items in groups within both bounds; an item over the bound is a group of its own size."""
    count, size, most = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
                                  F.coalesce(F.max(F.octet_length("text")), F.lit(0))).head()
    groups = max(1, -(-count // most_items), -(-size // most_bytes))
    while True:
        group = F.pmod(F.xxhash64("item"), F.lit(groups))
        largest = items.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
        n, b = largest.agg(F.max("n"), F.max("b")).head()
        if count == 0:
            return []
        if n <= 2 * most_items and b <= max(2 * most_bytes, 2 * most):
            return [items.where(group == g) for g in range(groups)]
        groups *= 2


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, terms, counts) of every document: its length, and the terms of the vocabulary in it."""
    def run(batches):
        number = vocabulary.value
        for batch in batches:
            found = [terms(t) for t in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            of = np.repeat(np.arange(len(found)), size)
            at = np.fromiter((number.get(t, -1) for row in found for t in row), np.int64, len(of))
            keys, count = np.unique((of * len(number) + at)[at >= 0], return_counts=True)
            doc, term = np.divmod(keys, max(1, len(number)))
            offsets = np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.astype(np.int32))) for c in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *lists], ["id", "n", "terms", "counts"])
    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def _lists(counted: DataFrame, blocks, vocabulary: int, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(item, id, score): the k best of every item in the rows of each task."""
    def run(batches):
        held = [(block, Best(len(block.items), k)) for block in blocks.value]
        for batch in batches:
            n = batch.column(1).to_numpy()
            lists, counts = batch.column(2), batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), size)
            term = lists.flatten().to_numpy().astype(np.int64)
            impact = impacts(counts.flatten().to_numpy().astype(np.int64), n[doc], n_docs, n_terms)
            ids = batch.column(0)
            nameless = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for block, best in held:
                best.add(block.scores(doc, term, impact, batch.num_rows, vocabulary), ids, nameless)
        for block, best in held:
            item, score, id, without = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(block.items[item]), pa.array(id, mask=without), pa.array(score)],
                                             ["item", "id", "score"])
    return counted.where(F.size("terms") > 0).mapInArrow(run, "item long, id long, score long")


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    """(item, id, score, rank) of the k best rows of every item, merged in levels."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    count, items = lists.agg(F.count(F.lit(1)), F.approx_count_distinct("item")).head()
    groups = -(-count // max(1, items * k * MERGE_FAN_IN))
    if groups > 1:
        near = Window.partitionBy("item", F.pmod(F.xxhash64("id", "score"), F.lit(groups))).orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
    return (lists.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .where(F.col("rank") <= k))


def search(items: DataFrame, docs: DataFrame, k: int, *, item_id: str = "item_id", item_text: str = "text",
           id: str = "doc_id", text: str = "text", group_items: int = GROUP_ITEMS, group_bytes: int = GROUP_BYTES,
           block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k highest documents of every item."""
    spark = docs.sparkSession
    rows = _item_rows(items, item_id, item_text)
    texts = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))
    found = None
    for group in _groups(rows, group_items, group_bytes):
        asked = [(row["item"], sorted(set(terms(row["text"])))) for row in group.select("item", "text").collect()]
        asked = [(item, some) for item, some in sorted(asked) if some]
        number = {t: n for n, t in enumerate(sorted({t for _, some in asked for t in some}))}
        if not number:
            continue
        counted = written(_counted(texts, spark.sparkContext.broadcast(number)), "counted-terms")
        n_docs, n_terms = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weights = np.zeros(len(number), np.int64)  # a term that no document has never meets an impact
        for term, n in zip(df.column("term").to_pylist(), df.column("count").to_pylist()):
            weights[term] = weight(n, n_docs)
        numbered = [(item, [number[t] for t in some]) for item, some in asked]
        blocks = [Block(numbered[at:at + block_items], weights) for at in range(0, len(numbered), block_items)]
        lists = written(_lists(counted, spark.sparkContext.broadcast(blocks), len(number), k, n_docs, n_terms), "item-lists")
        part = _ranked(lists, k)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"{item_id} long, rank int, {id} long, score long")
    return (found.join(rows.select("item", "item_id"), "item")
            .select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score"))


def search_sql(k: int) -> str:
    """The same in SQL, every term of every document."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS terms FROM documents),
    o AS (SELECT r, unnest(terms) AS term FROM d),
    t AS (SELECT r, term, count(*) AS tf FROM o GROUP BY ALL),
    c AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
    z AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM c),
    f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
          FROM t, z GROUP BY term, n_docs),
    i AS (SELECT DISTINCT item_id, text FROM benchmark),
    q AS (SELECT DISTINCT item_id, text, unnest({found}) AS term FROM i),
    s AS (SELECT q.item_id, q.text, t.r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM q JOIN t USING (term) JOIN f USING (term) JOIN c ON c.r = t.r, z GROUP BY ALL),
    x AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id) AS rank
          FROM s JOIN d ON d.r = s.r WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM x WHERE rank <= {k}"""
