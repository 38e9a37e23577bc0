"""SimHash near-duplicates found with pivot distance tables.

A document's fingerprint has a bit set where over half of its shingle hashes have it set.
Fingerprints at most ``max_bits`` apart are linked, and documents in one chain of links form a
component. The search is exact:

* Equal fingerprints are one class with one representative, so copies cost nothing more.
* The 64 bits are cut into ``max_bits + 2`` blocks. Two fingerprints within ``max_bits`` agree on two
  blocks at least, so each class goes into one bucket per pair of blocks (15 for 4 bits).
* In a bucket every fingerprint has a row of Hamming distances to the same pivot fingerprints. By the
  triangle inequality two fingerprints whose rows differ by more than ``max_bits`` in any coordinate
  cannot be linked; only survivors of that test are compared.
* A bucket emits one spanning link per member, never all pairs. A bucket over ``TILE`` members is cut
  into chunks, and each pair of chunks is a task of its own, so nothing is dropped.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; rows
with a null id take part, but a component is named by the smallest id that is not null; repeated
rows stay repeated; empty tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import written
from shelfmark.llm.components import components
from shelfmark.llm.repeats import Sequences

SEED = 42
#: Members of a bucket that one task compares; a larger bucket is cut into chunks of about this size.
TILE = 2048
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Groups up to this size are compared in one step.
SMALL_GROUP = 96
_BLOCK = 1 << 14


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every shingle, words joined by a space; of the whole text if it is shorter."""
    import xxhash
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    shingle = min(shingle, len(words))
    total = len(words) - shingle + 1
    pairs = zip(starts[:total].tolist(), ends[shingle - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, total)


def _votes(hashes: np.ndarray) -> int:
    """A signed 64-bit number whose bits are set where over half of the hashes have them set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of one text; bytes are lowered, so ASCII letters only."""
    lower = text.encode().lower().split() if text else []
    return _votes(_shingle_hashes(lower, shingle)) if lower else 0


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int) -> DataFrame:
    """(id, fp) of every row, from whole texts, without a shuffle."""
    def run(batches):
        for batch in batches:
            marks = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["id", "fp"])
    return (docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))
            .mapInArrow(run, "id long, fp long"))


def block_masks(max_bits: int) -> list[int]:
    """One mask of two blocks for each pair of the ``max_bits + 2`` blocks."""
    edges = np.linspace(0, 64, max_bits + 3).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2 ** 64, count, dtype=np.uint64, endpoint=False)


def _linked(fps, table, at: int, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Those of ``others`` within ``max_bits`` of ``at``: pivot test first, then the true distance."""
    for n in range(0, table.shape[1], 4):
        apart = np.abs(table[others, n:n + 4] - table[at, n:n + 4]).max(axis=1)
        others = others[apart <= max_bits]
    return others[np.bitwise_count(fps[others] ^ fps[at]) <= max_bits]


def _near_pairs(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a small group within ``max_bits``: pivot test first, then the true distance."""
    a, b = np.triu_indices(len(fps), 1)
    for n in range(0, table.shape[1], 4):
        near = np.abs(table[a, n:n + 4] - table[b, n:n + 4]).max(axis=1) <= max_bits
        if not near.all():
            a, b = a[near], b[near]
        if not len(a):
            return a, b
    near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
    return a[near], b[near]


def spanning_links(fps: np.ndarray, references: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints reachable from each other in one group."""
    table = pivot_table(fps, references)
    if len(fps) <= SMALL_GROUP:
        a, b = _near_pairs(fps, table, max_bits)
        if len(a) <= 2 * len(fps):
            return list(zip(a.tolist(), b.tolist()))
    return _spanning(len(fps), lambda at, others: _linked(fps, table, at, others, max_bits))


def _spanning(count: int, linked) -> list[tuple[int, int]]:
    """A spanning forest of a group; ``linked(at, others)`` gives those of ``others`` linked to ``at``."""
    rest, out = np.arange(count), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = linked(at, rest)
            if len(near):
                out += [(at, member) for member in near]
                rest = np.setdiff1d(rest, near, assume_unique=True)
                queue.extend(near)
    return out


def _group_runs(batches):
    """Columns of sorted batches, cut so that a group (first column) is never split."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        group = table.column(0).to_numpy()
        done = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
        if done:
            yield table.slice(0, done)
        held = table.slice(done)
    if held is not None and held.num_rows:
        yield held


def _packed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _edges(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])


def _bucket_links(max_bits: int):
    def run(batches):
        references = pivots()
        for table in _group_runs(batches):
            fp = table.column(1).to_numpy().view(np.uint64)
            edges = _edges(table.column(0).to_numpy())
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            if len(two):  # most buckets by far: all at once
                left, right = fp[two], fp[two + 1]
                near = np.abs(pivot_table(left, references) - pivot_table(right, references)).max(axis=1) <= max_bits
                left, right = left[near], right[near]
                near = np.bitwise_count(left ^ right) <= max_bits
                yield _packed(left[near], right[near])
            for start, length in zip(edges[:-1][size > 2], size[size > 2]):
                members = np.unique(fp[start:start + length])
                found = spanning_links(members, references, max_bits)
                if found:
                    pairs = np.array(found)
                    yield _packed(members[pairs[:, 0]], members[pairs[:, 1]])

    return run


def _tiled(rows: DataFrame, group: str, tile: int, size: Column | None = None, most: int = 1) -> DataFrame:
    """Rows of groups over ``tile`` members go to one group per pair of chunks, the others to their own.

    Needs a long column ``member`` to deal the rows of a group into chunks by. Where a ``size`` is given,
    a chunk holds about ``most`` of it, too.
    """
    chunks = F.ceil(F.count(F.lit(1)) / tile)
    if size is not None:
        chunks = F.greatest(chunks, F.ceil(F.sum(size) / most))
    large = written(rows.groupBy(group).agg(chunks.alias("chunks")).where("chunks > 1"), "large-groups")
    last = F.coalesce("chunks", F.lit(1)) - 1
    return (rows.join(large, group, "left")
            .withColumn("own", F.pmod(F.xxhash64("member"), last + 1))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .withColumn(group, F.when(F.col("chunks").isNull(), F.col(group)).otherwise(
                F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))))
            .drop("chunks", "own", "other"))


def near_links(classes: DataFrame, max_bits: int, *, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``classes(fp)`` that span all pairs in reach."""
    masks = [_signed(mask) for mask in block_masks(max_bits)]
    rows = classes.select(F.col("fp").alias("member"), F.explode(F.array(*[
        F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask))) for n, mask in enumerate(masks)])).alias("bucket"))
    return (_tiled(rows, "bucket", tile).select("bucket", "member")
            .repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_bucket_links(max_bits), "a long, b long").distinct())


def near_duplicates(marks: DataFrame, max_bits: int, *, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) for rows (id, fp); component_id is the smallest id in reach."""
    marks = written(marks, "marks")
    classes = written(marks.groupBy("fp").agg(F.min("id").alias("rep")), "mark-classes")
    roots = components(near_links(classes, max_bits, tile=tile))
    rooted = (classes.join(roots, classes.fp == roots.node, "left")
              .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("id", "fp", "component_id")


# Near copies by similarity of shingle sets, complete for similarity ``least`` and more.
#
# * SimHash. Texts whose fingerprints are near by the pivot search above are candidates first, and those in
#   buckets of many texts with one reference each; what is similar indeed is one component from then on.
# * Complete search. Copies of similarity 0.8 differ in up to 14 of 64 bits, so texts that are in different
#   components still meet by prefix filtering: with all shingles in one order, two sets of similarity t share
#   one of the first n - ceil(t n) + 1 shingles of each. The order is by hash, but shingles that are frequent in
#   a sample of the texts come last, so common passages make no large buckets as a rule.
# * Decision. Pairs of small buckets are first compared by size and one bit of the least hash in each of
#   ``MINIMA`` classes, which only drops pairs far below ``least``, then by their sets of 64-bit shingle
#   hashes. Large buckets are decided in their tiles: the sets travel there, all overlaps of a tile are
#   counted at once, and only links that span it leave it, so a group alike below ``least`` emits nothing.

#: Bits that the fingerprints of the first candidates differ in at most.
NEAR_BITS = 4
#: Classes of shingles with one bit each that a pair is first compared by.
MINIMA = 256
#: Bits that sets of similarity 0.8 differ in, 25.6 and five standard errors of 4.8.
MOST_APART = 50
SIMILARITY = 0.8
#: One text in so many tells frequent shingles, by counts in 2 ** SLOT_BITS slots; from so many on.
SAMPLE = 32
SLOT_BITS = 22
FREQUENT = 3
#: Buckets over this size are first compared with a reference, then decided in tiles of so many texts and bytes.
STAR_GROUP = 16
SET_TILE = 512
SET_BYTES = 32 << 20
#: Shingles that more texts of a tile share are counted by matrix products, the others pair by pair.
RARE_IN_TILE = 6


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text (bytes are lowered); of all its words if it is shorter."""
    words = text.encode().lower().split() if text else []
    return np.unique(Sequences(words).all_of(min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Exact similarity of two sorted sets; 0 for two empty ones."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / max(1, len(one) + len(other) - both)


def class_bits(shingles: np.ndarray) -> bytes:
    """One bit of the least hash of each of ``MINIMA`` classes; 0 for classes without shingles."""
    least = np.full(MINIMA, 0xFFFFFFFFFFFFFFFE, np.uint64)
    np.minimum.at(least, (shingles % np.uint64(MINIMA)).astype(np.int64), (shingles >> np.uint64(8)) * _SPREAD)
    return np.packbits((least >> np.uint64(9)) & np.uint64(1)).tobytes()


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def prefix(shingles: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a text is looked up by: infrequent ones, frequent ones."""
    if not len(shingles):
        return shingles, shingles
    length = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1
    count = counts[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    some = np.lexsort((shingles, count))[:length]
    return shingles[some[count[some] == 0]], shingles[some[count[some] > 0]]


def _frequent(texts: DataFrame, shingle: int):
    """A broadcast table: for each slot of shingles its count in the sample, 0 if below ``FREQUENT``."""
    def run(batches):
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            slot, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]) >> np.uint64(64 - SLOT_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], ["slot", "n"])
    found = (texts.where(F.pmod("member", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "slot int, n long")
             .groupBy("slot").agg(F.least(F.sum("n"), F.lit(0xFFFF)).cast("int").alias("n"))
             .where(F.col("n") >= FREQUENT).toArrow())
    table = np.zeros(1 << SLOT_BITS, np.uint16)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return texts.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))


def _prints(texts: DataFrame, frequent, shingle: int, least: float) -> DataFrame:
    """(member, fp, size, bits, rare, hot) of every text."""
    def run(batches):
        counts = np.frombuffer(zlib.decompress(frequent.value), np.uint16)
        longs = pa.list_(pa.int64())
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            firsts = [prefix(s, counts, least) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_votes(s) if len(s) else 0 for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([class_bits(s) for s in sets], pa.binary()),
                 *(pa.array([f[n].view(np.int64) for f in firsts], longs) for n in (0, 1))],
                ["member", "fp", "size", "bits", "rare", "hot"])
    return texts.select("member", "text").mapInArrow(
        run, "member long, fp long, size int, bits binary, rare array<long>, hot array<long>")


def _shared(batches):
    """Rows whose first column has another row beside it."""
    for table in _group_runs(batches):
        size = np.diff(_edges(table.column(0).to_numpy()))
        yield from table.filter(pa.array(np.repeat(size > 1, size))).combine_chunks().to_batches()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _alike(size: np.ndarray, bits: np.ndarray, a, b, least: float) -> np.ndarray:
    """Which pairs (a, b) may reach ``least``; a set in n shingles different changes n classes at most."""
    one, two = size[a], size[b]
    fits = np.minimum(one, two) >= least * np.maximum(one, two) - 1e-9
    most = (1 - least) / (1 + least) * (one + two) + 1e-9
    if least >= SIMILARITY:
        most = np.minimum(MOST_APART, most)
    return fits & (_apart(bits[a], bits[b]) <= most)


def _columns(table: pa.Table):
    bits = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint64).reshape(table.num_rows, -1)
    return table.column(1).to_numpy(), table.column(2).to_numpy().astype(np.int64), bits


def _star_pairs(least: float):
    """(a, b, apart) of each member of a bucket and the reference of the bucket."""
    def run(batches):
        for table in _group_runs(batches):
            member, size, bits = _columns(table)
            group = table.column(0).to_numpy()
            edges = _edges(group)
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    others = np.arange(a, b)
                    mixed = (member[a:b].view(np.uint64) ^ group[a:b].view(np.uint64)) * _SPREAD
                    at = a + int(mixed.argmin())
                    others = others[(others != at) & (member[others] != member[at])]
                    others = others[_alike(size, bits, at, others, least)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(others), member[at])), pa.array(member[others]),
                         pa.array(_apart(bits[others], bits[at]))], ["a", "b", "apart"])
    return run


def _open_pairs(least: float):
    """(a, b) of each bucket that may reach ``least`` and are not in one component yet."""
    def run(batches):
        for table in _group_runs(batches):
            member, size, bits = _columns(table)
            root = table.column(4).to_numpy()
            edges = _edges(table.column(0).to_numpy())
            sizes = np.diff(edges)

            def packed(a, b):
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
                near = _alike(size, bits, a, b, least)
                low, high = np.minimum(member[a[near]], member[b[near]]), np.maximum(member[a[near]], member[b[near]])
                return _packed(low, high)

            for count in range(2, STAR_GROUP + 1):  # most buckets by far: all of one size at once
                starts = edges[:-1][sizes == count]
                if len(starts):
                    for i, j in combinations(range(count), 2):
                        yield packed(starts + i, starts + j)
    return run


def _alike_members(least: float):
    """(bucket, member, root) of those that may reach ``least`` with a member of another component."""
    def run(batches):
        for table in _group_runs(batches):
            member, size, bits = _columns(table)
            root = table.column(4).to_numpy()
            edges = _edges(table.column(0).to_numpy())
            keep = np.zeros(table.num_rows, bool)
            for a, b in zip(edges, edges[1:]):
                if (root[a:b] == root[a]).all():
                    continue
                for at in range(a, b - 1):
                    others = np.arange(at + 1, b)
                    others = others[root[others] != root[at]]
                    others = others[_alike(size, bits, at, others, least)]
                    if len(others):
                        keep[at] = keep[others] = True
            some = table.filter(pa.array(keep)).combine_chunks()
            yield from some.select(["bucket", "member", "root"]).to_batches()
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(x) for x in sets])
    _, column, often = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, often = owner[order], often[column[order]]
    out = np.zeros((count, count))
    for n in range(2, RARE_IN_TILE + 1):
        some = owner[often == n].reshape(-1, n)
        for i, j in combinations(range(n), 2):
            out += np.bincount(some[:, i] * count + some[:, j], minlength=count * count).reshape(count, count)
    out += out.T
    rest, sizes = owner[often > RARE_IN_TILE], often[often > RARE_IN_TILE]
    starts = np.flatnonzero(np.r_[True, np.diff(column[order][often > RARE_IN_TILE]) > 0]) if len(rest) else np.empty(0, int)
    for at in range(0, len(starts), 4096):
        low, high = starts[at], starts[at + 4096] if at + 4096 < len(starts) else len(rest)
        held = np.zeros((count, min(4096, len(starts) - at)), np.float32)
        held[rest[low:high], np.repeat(np.arange(held.shape[1]), sizes[starts[at:at + 4096]])] = 1
        out += held @ held.T
    return out


def _tile_links(least: float):
    """Links (a, b) that span what is similar in each tile and not in one component yet."""
    def run(batches):
        for table in _group_runs(batches):
            edges = _edges(table.column(0).to_numpy())
            for start, stop in zip(edges, edges[1:]):
                part = table.slice(start, stop - start)
                member, root = part.column(1).to_numpy(), part.column(2).to_numpy()
                if stop - start < 2 or (root == root[0]).all():
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                size, both = np.array([len(x) for x in sets]), overlaps(sets)
                near = both >= (least - 1e-12) * np.maximum(1, size[:, None] + size[None, :] - both)
                near |= root[:, None] == root[None, :]  # joined already: these links are not needed again
                found = [(a, b) for a, b in _spanning(len(size), lambda at, others: others[near[at, others]]) if root[a] != root[b]]
                if found:
                    a, b = np.array(found).T
                    yield _packed(member[a], member[b])
    return run


def _clustered(alike: DataFrame) -> DataFrame:
    """Rows (bucket, member, root) in which every two members of one bucket still meet, but fewer times.

    Buckets that share members are one cluster. Where it takes fewer rows, a cluster's members meet once,
    in the tiles of the cluster, and not in each of its buckets.
    """
    low = alike.groupBy("bucket").agg(F.min("member").alias("a"))
    roots = components(alike.join(low, "bucket").select("a", F.col("member").alias("b")).distinct())
    held = written(alike.join(roots, F.col("member") == roots.node, "left")
                   .select("bucket", "member", alike["root"], F.coalesce(roots["root"], "member").alias("cluster")), "clusters")
    once = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("member").alias("n"))
    once = once.where(F.col("n") * F.ceil(F.col("n") / SET_TILE) <= F.col("rows")).select("cluster")
    return (held.join(once, "cluster", "left_anti").select("bucket", "member", "root")
            .union(held.join(once, "cluster", "left_semi").select(F.col("cluster").alias("bucket"), "member", "root").distinct()))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(member, shingles): the set of 64-bit hashes as binary."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["member", "shingles"])
    return texts.select("member", "text").mapInArrow(run, "member long, shingles binary")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose exact similarity is ``least`` or more."""
    def run(batches):
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for key, text in ((a, x), (b, y)):
                    if key not in held:
                        if len(held) > 256:
                            held.clear()
                        held[key] = shingle_set(text, shingle)
                one = held[a] if a in held else shingle_set(x, shingle)
                keep.append(jaccard(one, held[b]) >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
    one, other = (texts.select(F.col("member").alias(k), F.col("text").alias(f"text {k}")) for k in "ab")
    return (pairs.join(one, "a").join(other, "b").select("a", "b", "text a", "text b")
            .mapInArrow(run, "a long, b long"))


def _rooted(docs: DataFrame, id: str, text: str, shingle: int, max_bits: int, least: float, tile: int) -> DataFrame:
    """(id, text_key, root) of every row: texts in one chain of similar texts have one root."""
    rows = docs.select(docs[id].cast("long").alias("id"), _text_key(docs[text]).alias("member"))
    texts = written(docs.select(_text_key(docs[text]).alias("member"), F.coalesce(docs[text], F.lit("")).alias("text"))
                    .groupBy("member").agg(F.first("text").alias("text")), "texts")
    frequent = _frequent(texts, shingle)
    prints = written(_prints(texts, frequent, shingle, least), "text-prints")
    rare = (prints.select(F.explode("rare").alias("bucket"), "member").repartition("bucket")
            .sortWithinPartitions("bucket").mapInArrow(_shared, "bucket long, member long"))
    shared = written(rare.union(prints.select(F.explode("hot"), "member")), "shared-shingles")
    marks = prints.select("member", "size", "bits")

    # Candidates by SimHash, one for a text: the head of its own fingerprint, heads that of a near one.
    classes = written(prints.groupBy("fp").agg(F.min("member").alias("head")), "print-classes")
    heads = {k: classes.select(F.col("fp").alias(k), F.col("head").alias(f"head {k}")) for k in "ab"}
    near = (near_links(classes.select("fp"), max_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .groupBy("b").agg(F.min("a").alias("a")).join(heads["a"], "a").join(heads["b"], "b")
            .select(F.col("head a").alias("a"), F.col("head b").alias("b")))
    near = written(near.union(prints.join(classes, "fp").where("member <> head")
                              .select(F.col("head").alias("a"), F.col("member").alias("b"))), "near-prints")

    large = shared.groupBy("bucket").count().where(F.col("count") > STAR_GROUP).select("bucket")
    crowd = shared.join(written(large, "large-buckets"), "bucket").join(marks, "member")
    stars = (_tiled(crowd, "bucket", tile).select("bucket", "member", "size", "bits")
             .repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(_star_pairs(least), "a long, b long, apart long")
             .groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b"))
    stars = stars.join(near.select("b"), "b", "left_anti").select("a", "b")
    first = written(_verified(written(near.union(stars), "first-pairs"), texts, shingle, least), "first-links")
    roots = components(first)

    joined = (shared.join(roots, F.col("member") == roots.node, "left")
              .select("bucket", "member", F.coalesce("root", "member").alias("root")))
    still = written(joined.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
                    .where("low < high").select("bucket", (F.col("n") > STAR_GROUP).alias("large")), "open-buckets")
    open_ = joined.join(still, "bucket")
    pairs = (open_.where("NOT large").join(marks, "member").select("bucket", "member", "size", "bits", "root")
             .repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(_open_pairs(least), "a long, b long").distinct())
    # Most texts of a large bucket share a passage and nothing else: sets travel only for those that are not
    # far below ``least`` from another one there.
    tiles = _tiled(open_.where("large").join(marks, "member"), "bucket", SET_TILE, F.col("size").cast("long") * 8, SET_BYTES)
    alike = written(tiles.select("bucket", "member", "size", "bits", "root").repartition("bucket").sortWithinPartitions("bucket")
                    .mapInArrow(_alike_members(least), "bucket long, member long, root long"), "alike-members")
    sets = written(_sets(texts.join(alike.select("member").distinct(), "member", "left_semi"), shingle), "shingle-sets")
    tiles = _tiled(_clustered(alike).join(sets, "member"), "bucket", SET_TILE, F.octet_length("shingles"), SET_BYTES)
    spans = (tiles.select("bucket", "member", "root", "shingles").repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(_tile_links(least), "a long, b long").distinct())
    links = first.union(_verified(written(pairs, "open-pairs"), texts, shingle, least)).union(spans)
    roots = components(links)
    return (rows.join(roots, rows.member == roots.node, "left")
            .select("id", F.col("member").alias("text_key"), F.coalesce("root", "member").alias("root")))


def similar_texts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5,
                  max_bits: int = NEAR_BITS, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(id, text_key, component_id): texts in one chain of similar texts share the smallest id.

    Equal texts are one member. All pairs whose shingle sets are ``least`` alike are linked, whatever their
    fingerprints; ``max_bits`` tells which texts are compared first.
    """
    rooted = written(_rooted(docs, id, text, shingle, max_bits, least, tile), "rooted")
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(named, "root").select("id", "text_key", "component_id")


def _text_key(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def representatives(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5,
                    max_bits: int = NEAR_BITS, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """One document of each chain of similar texts: that with the smallest id, whole and once.

    Rows with equal id and equal text count as one row. Rows without an id stay only where their chain has no
    row with one: then one row of the text with the smallest key.
    """
    rooted = _rooted(docs, id, text, shingle, max_bits, least, tile)
    stays = written(rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")).alias("s"))
                    .select(F.col("s.id").alias("id that stays"), F.col("s.text_key").alias("its text")), "stays")
    same = docs[id].cast("long").eqNullSafe(stays["id that stays"]) & (_text_key(docs[text]) == stays["its text"])
    kept = docs.join(stays, same, "left_semi")
    repeated = docs.groupBy(docs[id].cast("long"), _text_key(docs[text])).count().where("count > 1").head(1)
    return kept.dropDuplicates([id, text]) if repeated else kept
