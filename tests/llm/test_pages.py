"""Main-text extraction and WARC archives."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Row

from shelfmark import session
from shelfmark.llm import html_crf, warc
from shelfmark.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def model():
    return html_crf.fit(html_crf.labelled_pages())


def test_blocks_of_loose_markup():
    page = ('<!DOCTYPE html><p><b>One&amp;two<br><p>Next &lt;3 <a href="x>y">link</a></p><!-- <p>no</p> -->'
            '<script>var t="</p><p>no";</script><style>p{}</style>  <ul><li>a<li>b<ul><li>c</ul></ul><div>tail &copy; <span>in</span>side')
    assert [b.text for b in blocks(page)] == ["One&two", "Next <3 link", "a", "b", "c", "tail © inside"]
    assert blocks(None) == blocks("") == blocks("<div> &nbsp; </div>") == []
    assert [b.text for b in blocks("plain < text & more")] == ["plain < text & more"]
    assert [b.text for b in blocks("x" * 300_000 + "<p>y")] == ["x" * 300_000, "y"]


def test_deep_pages_take_time_by_length(model):
    import time
    began = time.monotonic()
    for html in ("<div>x" * 150_000, "<span class=a>" * 60_000 + "y" + "</span>" * 60_000 + "<p>z", "<x1><i>q" * 90_000 + "</b>" * 90_000):
        page = blocks(html)
        assert len(model.labels(page)) == len(page)
    assert time.monotonic() - began < 60
    assert len(blocks("<div>x" * 150_000)) == 150_000 and len(blocks("<div>x" * 5)[4].path) == 5


def test_held_out_pages(model):
    right = total = 0
    for html, labels in html_crf.labelled_pages(200, seed=31):
        found = model.labels(blocks(html))
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.985


def test_viterbi_is_the_best_labelling(model):
    from itertools import product
    for html, _ in html_crf.labelled_pages(20, seed=77):
        page = blocks(html)[:10]
        scores = [model.score(b) for b in page]

        def value(labels):
            return (sum(s for s, y in zip(scores, labels) if y)
                    + sum(model.moves[a, b] for a, b in zip(labels, labels[1:])))
        best = max(product((0, 1), repeat=len(page)), key=value)
        assert value(tuple(map(int, model.labels(page)))) == pytest.approx(value(best))


def test_extract_rows(spark, model):
    page = ("<html><body><header><h1>Site</h1><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav></header>"
            "<div class='cookie-notice'><p>We use cookies. Accept them all.</p></div><div class='sidebar'><p>Also read this other story here.</p></div>"
            "<article><h1>A  headline\n here</h1><p>First paragraph, with some words in it.</p><div class='ad'>Buy now.</div>"
            "<p>Second &eacute;t&eacute; paragraph has words too.</p></article>"
            "<div class='comments'><h3>Comments</h3><p>I liked this article very much, thanks.</p></div>"
            "<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer>")
    want = "A headline here\n\nFirst paragraph, with some words in it.\n\nSecond été paragraph has words too."
    rows = [Row(page_id=1, url="u", html=page, text=3), Row(page_id=1, url="u", html=page, text=3),
            Row(page_id=2, url=None, html=None, text=0), Row(page_id=None, url="v", html="", text=0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_crf.extract(df, model).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in found] == [
        (1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)]
    assert html_crf.extract(df.limit(0), model).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 1500 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a b\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", "s"), (5, "u", "s"), (None, "u", big),
            (6, "u", None), (7, "u", ""), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "z" * 999), (11, "u", "z" * 999)]
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows],
                               "page_id long, url string, html string, digest string, length int").repartition(3)
    for compression in ("none", "gzip"):
        path = session.work_path(spark, "warc")
        warc.write_archives(df, path, compression=compression)
        read = warc.read_archives(spark, path)
        found = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_length, r.payload_digest, bytes(r.payload) if r.payload is not None else None)
                        for r in read.collect()), key=str)
        want = []
        for i, u, h in rows:
            raw = (h or "").encode()
            owner = {1: 3, 2: 3, 8: 9}.get(i)
            want.append((f"<urn:page:{i if i is not None else 'none'}>", "revisit" if owner else "response",
                         f"<urn:page:{owner}>" if owner else None, len(raw), "sha1:" + hashlib.sha1(raw).hexdigest(), None if owner else raw))
        assert found == sorted(want, key=str)
        again = read.where("record_type = 'revisit' and target_uri is not null").select("record_id", "offset", "file")
        assert "Filter (" not in again._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.record_id for r in again.collect()) == ["<urn:page:1>", "<urn:page:8>"]
        assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    assert read.where("record_id = '<urn:page:1>'").first().target_uri == "http://a%20b%0D%0AX:%20y"


def test_warc_of_nothing(spark):
    path = session.work_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_broken_archive_is_an_error(tmp_path):
    bad = tmp_path / "bad.warc"
    bad.write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort")
    with pytest.raises(ValueError):
        list(warc.records(str(bad), [], True))
