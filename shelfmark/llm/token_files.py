"""Token ids of a corpus in binary files with Elias-Fano document boundaries.

A file is one concatenated id array (16 bits wide where the vocabulary allows, else 32), the
boundaries of its documents and their ids, both as Elias-Fano sequences. So the offset of any
document is found by a select, without a table of 64-bit offsets. The files in the order of their
numbers hold the documents in ascending order of id.

    magic "IDF1", width, number of rows without id (u8, u64) | smallest id (i64)
    | three lengths (u64): boundaries, document ids, id array | the three sections

Documents are range-partitioned by id once and encoded while the files are written, so a task holds
the ids of one file at most. Files are written under a name of their own attempt and then renamed, so
a task that runs again leaves the same files.

Texts are encoded as the library does by default, without special tokens added: a text that holds the
name of an added token, such as ``<|endoftext|>``, gets that token's id there.

Defined cases: a null or empty text has only the end id; rows with a null id come first; rows that
repeat an id lie in the order of their texts; an empty table gives no files; other columns are not
read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.llm.eliasfano import EliasFano
from shelfmark.session import work_path

#: Ids after which a file is closed.
FILE_TOKENS = 8 << 20
#: Bytes of text that are encoded at a time, at least, unless a task has less: pieces that repeat in them are encoded once.
BLOCK_BYTES = 8 << 20
#: Distinct parts of pieces whose ids a worker remembers, twice over, and the longest of them.
CACHED_PARTS = 400_000
LONGEST_PART = 64

_MAGIC = b"IDF1"
_HEAD = "<4sBQq3Q"


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start:start + size]`` of the numbers in ``order``, one after the other, and their bounds."""
    sizes = sizes[order]
    bounds = np.append(0, np.cumsum(sizes))
    places = np.repeat(starts[order] - bounds[:-1], sizes)
    places += np.arange(len(places))
    return values[places], bounds


class PieceEncoder:
    """Encodes a block of texts piece by piece between blanks, each distinct piece once.

    For tokenizers whose pattern drops white space, so that no token reaches over a blank. Names of added
    tokens inside a piece are left to the library: they have their own id, as by its default. Pieces
    are encoded many at a time, with a mark between them whose id nothing else can have. Pieces of
    printable ASCII without apostrophes and of accented letters of Latin-1 are cut into their letters, digits and
    signs here, and each distinct part goes to the library's BPE model without the normalizer and the pattern,
    provided that the whole tokenizer gives the same ids for the probes.
    """

    _MARK = "\x01"
    _AT_ONCE = 256
    _PARTS_AT_ONCE = 1024
    _PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
    #: Of each byte of a lower-case plain piece: 1 in a letter, 2 a digit, 0 a sign.
    _BYTE_KINDS = np.array([1 if 97 <= n <= 122 or n >= 128 else 2 if 48 <= n <= 57 else 0 for n in range(256)], np.uint8)
    _PROBES = ["word", "Word,", "AbC", "a1b22c", "x.y/z", "!?", "...", "(a)", "99%%", "U.S.A.", "a-b_c", "@#$", "Qu\"x", "k+1=2;", "~`|<>",
               "Été,", "naïve", "Straße1ø.", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", *"ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
               *(f"a{chr(n)}b" for n in range(33, 127) if n != 39)]

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        #: Its model alone, for parts in lower case with a blank between them.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Names that stand for one id wherever they are in a text, as the library has it by default.
        self.names = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piecewise = not any(re.search(r"\s", name) for name in self.names)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        mark = self.tokenizer.encode(self._MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.direct = all(self._direct(p) == ids.tobytes() for p, ids in zip(self._PROBES, self._ids(self._PROBES)))

    @classmethod
    def of_worker(cls, path: str) -> PieceEncoder:
        """The encoder of this Python worker, which Spark uses for many tasks.

        This module travels with each task, so what outlives a task is kept in a module of its own.
        """
        import sys
        from types import ModuleType
        kept = vars(sys.modules.setdefault("shelfmark_worker", ModuleType("shelfmark_worker"))).setdefault("encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _direct(self, piece: str) -> bytes:
        return self._by_model(pc.utf8_lower(pa.array([piece])))[0].tobytes()

    def _by_model(self, lower: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain pieces in lower case, none of them empty, and the bounds of each piece's."""
        lower = lower.cast(pa.string())
        _, ends, text = lower.buffers()
        bounds = np.frombuffer(ends, np.int32)[lower.offset:lower.offset + len(lower) + 1]
        kinds = self._BYTE_KINDS[np.frombuffer(text, np.uint8)[bounds[0]:bounds[-1]]]
        first = np.append(True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2))
        first[bounds[:-1] - bounds[0]] = True
        starts = np.append(np.flatnonzero(first) + bounds[0], bounds[-1]).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), text).dictionary_encode()
        found = self._known(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        ids = np.frombuffer(b"".join(found), self.kind)
        coded, ends = gather(ids, np.cumsum(sizes) - sizes, sizes, parts.indices.to_numpy())
        return coded, ends[np.searchsorted(starts, bounds)]

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, of which the model gets those that were not met of late."""
        found = list(map(self.known.get, parts))
        if None in found:
            old = [(p, self.before.get(p)) for p, ids in zip(parts, found) if ids is None]
            self.known.update((p, ids) for p, ids in old if ids is not None)
            new = [p for p, ids in old if ids is None]
            groups = [new[n:n + self._PARTS_AT_ONCE] for n in range(0, len(new), self._PARTS_AT_ONCE)]
            for group, coded in zip(groups, self.model.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
                raw, width = np.array(coded.ids, self.kind).tobytes(), self.width
                ends = np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(group))) * width
                self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *ends.tolist()], ends.tolist()))))
            found = list(map(self.known.__getitem__, parts))
            for part in new:
                if len(part) > LONGEST_PART:
                    del self.known[part]
        if len(self.known) > CACHED_PARTS:
            self.known, self.before = {}, self.known
        return found

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_library(self, pieces: list[str]) -> list[np.ndarray]:
        alone = [n for n, p in enumerate(pieces) if self.mark is None or self._MARK in p]
        found = dict(zip(alone, self._ids([pieces[n] for n in alone])))
        rest = [n for n in range(len(pieces)) if n not in found] if alone else range(len(pieces))
        groups = [rest[n:n + self._AT_ONCE] for n in range(0, len(rest), self._AT_ONCE)]
        for group, ids in zip(groups, self._ids([f" {self._MARK} ".join([pieces[n] for n in g]) for g in groups])):
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            if len(ends) != len(group):
                raise ValueError("the mark between pieces was not kept apart")
            found.update(zip(group, (ids[a:b] for a, b in zip(starts.tolist(), ends.tolist()))))
        return [found[n] for n in range(len(pieces))]

    def _plain(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces may go to the model."""
        if not self.direct:
            return np.zeros(len(pieces), bool)
        plain = pc.match_substring_regex(pieces, f"^{self._PLAIN.pattern}$")
        for name in self.names:
            plain = pc.and_not(plain, pc.match_substring(pc.utf8_lower(pieces), name))
        return plain.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the bounds of each text's."""
        texts = texts.fill_null("")
        if not self.piecewise:
            found = self._ids(texts.to_pylist())
            return np.concatenate([np.empty(0, self.kind), *found]), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        split = pc.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        plain = self._plain(pieces.dictionary)
        starts, sizes, ids = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64), [np.empty(0, self.kind)]
        if plain.any():
            coded, bounds = self._by_model(pc.utf8_lower(pieces.dictionary.filter(pa.array(plain))))
            starts[plain], sizes[plain] = bounds[:-1], np.diff(bounds)
            ids.append(coded)
        if not plain.all():
            found = self._by_library(pieces.dictionary.filter(pa.array(~plain)).to_pylist())
            sizes[~plain] = [len(x) for x in found]
            starts[~plain] = sum(map(len, ids)) + np.cumsum(sizes[~plain]) - sizes[~plain]
            ids += found
        coded, bounds = gather(np.concatenate(ids), starts, sizes, pieces.indices.to_numpy())
        ends = split.offsets.to_numpy()
        return coded, bounds[ends - ends[0]]


def blocks(batches: Iterator[pa.RecordBatch], least: int = BLOCK_BYTES) -> Iterator[list[pa.Array]]:
    """The columns of some batches in a row, put together until they hold so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield [pa.concat_arrays(column) for column in zip(*(b.columns for b in held))]
            held, size = [], 0
    if held:
        yield [pa.concat_arrays(column) for column in zip(*(b.columns for b in held))]


def filesystem(path: str):
    """The file system that executors share, and the name of the path in it."""
    from pyarrow import fs
    if ":" not in path.split("/")[0] or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    bounds = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum([len(x) for x in ids], dtype=np.uint64, out=bounds[1:])
    sections = [EliasFano.encode(bounds).to_bytes(),
                EliasFano.encode(named.view(np.uint64) - np.uint64(least & (2 ** 64 - 1))).to_bytes(),
                np.concatenate([*ids, np.empty(0, np.uint32)]).astype(f"<u{width}").tobytes()]
    head = struct.pack(_HEAD, _MAGIC, width, len(ids) - len(named), least, *map(len, sections))
    return head + b"".join(sections)


class TokenFile:
    """One file in memory: ``len``, ``doc_ids`` and the ids of any document by its place."""

    def __init__(self, raw: bytes):
        magic, self.width, self.nameless, least, *sizes = struct.unpack_from(_HEAD, raw)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        self.bounds = EliasFano.from_bytes(raw[at:at + sizes[0]])
        names = EliasFano.from_bytes(raw[at + sizes[0]:at + sizes[0] + sizes[1]]).all()
        self.doc_ids = [None] * self.nameless + (names + np.uint64(least & (2 ** 64 - 1))).view(np.int64).tolist()
        self.ids = np.frombuffer(raw, f"<u{self.width}", sizes[2] // self.width, at + sizes[0] + sizes[1])

    def __len__(self) -> int:
        return self.bounds.n - 1

    def __getitem__(self, place: int) -> np.ndarray:
        return self.ids[self.bounds[place]:self.bounds[place + 1]]


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id: str = "doc_id",
                text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode and write all documents below ``path``; returns a row per file, in order.

    (file, n_docs, n_tokens, start): start counts the ids in all files before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        encoder = PieceEncoder.of_worker(tokenizer)
        system, folder = filesystem(path)
        doc_ids, ids, size, number = [], [], 0, 0

        def close():
            name = f"{folder}/{task.partitionId():06d}-{number:06d}.ids"
            attempt = f"{name}.{task.taskAttemptId()}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(attempt) as out:
                out.write(pack_file(doc_ids, ids, encoder.width))
            system.move(attempt, name)
            return pa.RecordBatch.from_pydict({"part": [task.partitionId()], "number": [number],
                                               "file": [name], "n_docs": [len(ids)], "n_tokens": [size]})

        for docs, texts in blocks(batches):
            found, bounds = encoder.encode(texts)
            bounds = bounds.tolist()
            for doc, start, stop in zip(docs.to_pylist(), bounds, bounds[1:]):
                doc_ids.append(doc)
                ids.append(np.append(found[start:stop], found.dtype.type(end_id)))
                size += len(ids[-1])
                if size >= file_tokens:
                    yield close()
                    doc_ids, ids, size, number = [], [], 0, number + 1
        if ids:
            yield close()

    spark = docs.sparkSession
    order = F.col("id").asc_nulls_first()
    listing = work_path(spark, "token-files")
    (docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))
     # The start of the text splits the rows of one id, should it be repeated very often or null.
     .repartitionByRange(order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")
     .mapInArrow(run, "part long, number long, file string, n_docs long, n_tokens long")
     .write.parquet(listing))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return (spark.read.parquet(listing)
            .withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
            .select("file", "n_docs", "n_tokens", "start"))


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit binary."""
    def run(batches):
        system, _ = filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(name) as raw:
                    held = TokenFile(raw.read())
                bounds = held.bounds.all().astype(np.int64)
                for at in range(0, len(held), 512):
                    part = bounds[at:at + 513]
                    raw = [held.ids[a:b].astype("<u4").tobytes() for a, b in zip(part, part[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(held.doc_ids[at:at + 512], pa.int64()), pa.array(part[:-1] + start),
                         pa.array(np.diff(part)), pa.array(raw, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    listed = files.select("file", "start").orderBy("start")
    tasks = max(1, min(10_000, files.count()))
    return (listed.repartition(tasks)
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))
