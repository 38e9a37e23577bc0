"""Byte-level BPE and token files against the tokenizer libraries and a plain reading."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row

from shelfmark import session
from shelfmark.llm import bpe, token_files
from shelfmark.llm.eliasfano import EliasFano

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "it's  we'll\n\n x", "  lead", "trail   ", "tab\t\ttab", "Grüße, 東京 🙂🙂", "<|endoftext|> is text",
    "\x1c\x1d odd   blanks　　x", "12345 67a8", "a" * 5000, " " * 5000 + "x", "x" + " " * 5000, "word " * 3000]


def test_pieces_encode_like_whole_texts():
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    alphabet = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "9", "!", "é", " ", " ", "\x1c", " " * 40, "東", "🙂"]
    for n in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 120)))
        assert bpe.encode_text(encoding, text, chunk_chars=16) == encoding.encode_ordinary(text), repr(text)
    for text in filter(None, TEXTS):
        assert bpe.encode_text(encoding, text, chunk_chars=64) == encoding.encode_ordinary(text)


def test_accented_pieces_go_to_the_model():
    encoder = token_files.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(n) for n in range(0xC0, 0x100) if n not in (0xD7, 0xF7)]
    pieces = letters + ["".join(letters), *(f"a{x}{x.lower()}9,{x}B" for x in letters), "Straße.", "dé-Çà(ü)"]
    assert encoder.direct and all(map(encoder._PLAIN.fullmatch, pieces))
    assert [encoder._direct(p) for p in pieces] == [ids.tobytes() for ids in encoder._ids(pieces)]
    assert not any(map(encoder._PLAIN.fullmatch, ["a×b", "÷", "e\u0301", "l'été", "ǅ", "ª"]))


class _Counted:
    """A tokenizer that keeps the words it is given."""

    def __init__(self, inner):
        self.inner, self.words = inner, []

    def encode_batch(self, texts, **options):
        self.words += " ".join(texts).split()
        return self.inner.encode_batch(texts, **options)


def test_block_sends_each_part_once(monkeypatch):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(WORDS)
    encoder = token_files.PieceEncoder(WORDS)
    encoder.known, encoder.model = {}, _Counted(encoder.model)
    texts = ["Été, the The THE été 1a1", None, "", "the,été\vthe\f" + "x" * 100] * 50

    def same():
        ids, bounds = encoder.encode(pa.array(["cut off", *texts]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]

    same()
    assert sorted(encoder.model.words) == sorted(["été", ",", "the", "1", "a", "x" * 100])
    same()
    assert encoder.model.words[6:] == ["x" * 100]  # too long to be remembered
    monkeypatch.setattr(token_files, "CACHED_PARTS", 3)
    same()
    assert not encoder.known and len(encoder.before) == 5
    same()
    assert encoder.model.words[7:] == ["x" * 100] * 2


def test_block_encodes_like_whole_texts():
    from tokenizers import Tokenizer
    whole, encoder, r = Tokenizer.from_file(WORDS), token_files.PieceEncoder(WORDS), random.Random(5)
    signs = ["a", "B", "é", "É", "ß", "e\u0301", "J\u030c", "\u212a", "İ", "ǅ", "ΑΣ", "'", "'s", "'LL", " ", "  ", "\n", "\v", "\f", "\x1c", "\x85", "\xa0",
             "9", "½", "!", "<", "|>", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x01", "\x00", "東", "🙂", "×", "_", "the", "ing"]
    for _ in range(100):
        texts = [None if r.random() < 0.05 else "".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(r.randint(0, 20))]
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(ids)
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_huge_blank_run():
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)
    for text in (" " * 1_500_000 + "word", "word" + "\n" * 1_500_000):
        assert encoding.decode_bytes(bpe.encode_text(encoding, text)) == text.encode()


def test_encode_and_decode_rows(spark):
    rows = [Row(doc_id=n, text=t, ids="clash", decoded=n) for n, t in enumerate(TEXTS)] + [Row(doc_id=1, text="", ids="", decoded=0)] * 2
    df = spark.createDataFrame(rows + [Row(doc_id=None, text="no id", ids=None, decoded=None)],
                               "doc_id long, text string, ids string, decoded long")
    both = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)
    found = both.collect()
    assert len(found) == len(rows) + 1
    for row in found:
        text = "no id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        assert row.ids == encoding.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    stored = session.checkpointed(both.select("doc_id", "ids"))
    again = bpe.decode(stored, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(bytes(r.decoded) for r in found)
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 9), (7, 3), (1000, 10 ** 9), (4000, 4000), (300, 2 ** 63)])
def test_elias_fano(n, top):
    values = np.sort(np.array([random.Random(n + k).randint(0, top) for k in range(n)], np.uint64))
    coded = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert (coded.all() == values).all()
    assert [coded[k] for k in range(n)] == values.tolist()
    assert len(coded.to_bytes()) < 64 + n * (3 + max(0, np.log2((top + 1) / max(1, n))) / 8 + 1)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(WORDS)
    texts = [*TEXTS, "a <|endoftext|> b", "<|startoftext|>x", "x<|endoftext|>", "Y<|startoftext|><|endoftext|>'s é<|ENDOFTEXT|>",
             "<|endoftext|", "Don't  ÄÖ ΑΣ x\x1cy", "pneumonoultramicroscopic" * 9]
    ids = [*range(10, 10 + len(texts) - 2), -4, None]
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    df = spark.createDataFrame([Row(doc_id=i, text=t, start=0) for i, t in zip(ids, texts)] + [Row(doc_id=12, text="twin", start=0)] * 2,
                               "doc_id long, text string, start long").repartition(3)
    folder = session.work_path(spark, "ids")
    files = token_files.write_files(df, folder, WORDS, 2, file_tokens=500)
    assert files.count() > 1
    found = token_files.read_files(spark, folder, files).orderBy("start").collect()
    want = sorted(((i if i is not None else -10 ** 9, t or "") for i, t in [*zip(ids, texts), (12, "twin"), (12, "twin")]))
    start = 0
    assert len(found) == len(want)
    for row, (i, text) in zip(found, want):
        tokens = whole.encode(text, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (None if i == -10 ** 9 else i, start, len(tokens))
        assert zlib.crc32(row.ids) == zlib.crc32(np.array(tokens, "<u4").tobytes())
        start += len(tokens)
    assert token_files.write_files(df.limit(0), session.work_path(spark, "ids"), WORDS, 2).count() == 0


def test_one_document_by_select():
    raw = token_files.pack_file([None, 3, 9], [np.array([1, 2]), np.array([], int), np.array([7])], 2)
    held = token_files.TokenFile(raw)
    assert held.doc_ids == [None, 3, 9]
    assert [held[n].tolist() for n in range(len(held))] == [[1, 2], [], [7]]
