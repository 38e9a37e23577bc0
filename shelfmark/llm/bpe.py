"""Byte-level BPE encoding and decoding by a local rank file.

``encode`` turns texts into ids exactly as the tiktoken library does without special tokens, and
``decode`` turns ids back into raw bytes. Both are one Arrow pass without a shuffle. Two Python passes
that follow each other in one stage can block each other in Spark 4.1, so a round trip is one pass
(``encode(..., decoded=...)``) and ``decode`` is for stored ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded
each for itself; an empty table stays empty; only the columns named in ``keep`` come along, so
other columns cannot clash. A null array of ids decodes to null. Ids that are not in the rank file
are an error, never dropped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Texts longer than this are cut before they reach the pattern matcher.
CHUNK_CHARS = 1 << 16

_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# No token holds a visible character followed by a blank, so a text may be cut between the two.
_SAFE_CUT = re.compile(r"\S(?=[ \t\r\n])")


def load(path: str, pattern: str):
    """A tiktoken encoding from a rank file: one base64 token and its rank per line."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, chunk_chars: int = CHUNK_CHARS) -> Iterator[str]:
    """Cuts of a text that tokenise independently; each at least ``chunk_chars`` long but the last."""
    start = 0
    while len(text) - start > chunk_chars:
        cut = _SAFE_CUT.search(text, start + chunk_chars - 1)
        if cut is None:
            break
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def encode_text(encoding, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    if len(text) <= chunk_chars:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    long_blank = re.compile(_SPACE + "{%d,}" % chunk_chars)
    for piece in safe_pieces(text, chunk_chars):
        # The pattern matcher backtracks over blanks one by one and gives up on huge runs. Such a
        # run is one match: all of it at the end of the text, all but its last blank elsewhere.
        start = 0
        for run in long_blank.finditer(piece):
            end = run.end() if run.end() == len(piece) else run.end() - 1
            ids += encoding.encode_ordinary(piece[start:run.start()])
            ids += encoding._encode_single_piece(piece[run.start():end])
            start = end
        ids += encoding.encode_ordinary(piece[start:])
    return ids


def _kept(df: DataFrame, keep: Sequence[str], added: StructField) -> StructType:
    return StructType([df.schema[name] for name in keep] + [added])


def encode(df: DataFrame, path: str, pattern: str, *, text: str = "text",
           keep: Sequence[str] = ("doc_id",), into: str = "ids", decoded: str | None = None,
           chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The columns of ``keep`` and an array of ids for every row.

    With ``decoded`` the ids are decoded again in the same pass, into a binary column of that name.
    """
    keep = list(keep)

    def run(batches):
        encoding = load(path, pattern)
        for batch in batches:
            ids = [encode_text(encoding, t, chunk_chars) if t else []
                   for t in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[:len(keep)], pa.array(ids, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array(map(encoding.decode_bytes, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = _kept(df, keep, StructField(into, ArrayType(IntegerType())))
    if decoded:
        schema = schema.add(decoded, BinaryType())
    names = schema.names
    return df.select(*keep, df[text].alias("text to encode")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids",
           keep: Sequence[str] = ("doc_id",), into: str = "decoded") -> DataFrame:
    """The columns of ``keep`` and the raw bytes that the ids stand for."""
    keep = list(keep)

    def run(batches):
        encoding = load(path, pattern)
        for batch in batches:
            raw = [None if row is None else encoding.decode_bytes(row)
                   for row in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(raw, pa.binary())], [*keep, into])

    schema = _kept(df, keep, StructField(into, BinaryType()))
    return df.select(*keep, df[ids].alias("ids to decode")).mapInArrow(run, schema)
