"""URL lists, discovery, sources, resume and the store."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.operators import buckets, discovery, store, urllists
from shelfmark.plans import lifecycle
from shelfmark.sources import categories, pages as page_files, products as source, urllists as files

LINES = [
    "  https://s.example/B-p-2.html?x=1 ", "https://s.example/a-p-1.html", "# note", "",
    "- https://s.example/a-p-1.html", "-- https://s.example/c-p-3.html local/c.html", "- # x",
    "https://s.example/a-p-1.html", "https://s.example/none?y=2",
]
A, B, C, NONE = ("https://s.example/a-p-1.html", "https://s.example/B-p-2.html",
                 "https://s.example/c-p-3.html", "https://s.example/none?y=2")


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES, 1)), "pos long, line string")


def column(df, name):
    return [r[name] for r in df.collect()]


def test_cleaners(lines):
    distinct = urllists.clean_distinct(lines).orderBy(F.lower("url"), "url")
    assert column(distinct, "url") == ["- # x", f"- {A}", f"-- {C} local/c.html".split(" local")[0], A, B, NONE]
    ordered = urllists.sort_lines(urllists.clean_ordered(lines))
    assert column(ordered, "line") == ["# x", A, f"{B}?x=1", f"{C} local/c.html", NONE]
    plain = urllists.sort_lines(urllists.preprocess(lines))
    assert column(plain, "line") == ["# x", A, A, A, f"{B}?x=1", f"{C} local/c.html", NONE]
    best = lifecycle.clean_list(lines).orderBy(F.lower("url"))
    assert column(best, "url") == ["#", A, B, C, NONE]


def test_split_and_local_html(spark, lines):
    split = urllists.split_lines(urllists.preprocess(lines))
    assert {(r["url"], r["local_path"]) for r in split.collect()} >= {(C, "local/c.html"), (A, None)}
    html = spark.createDataFrame([("local/c.html", "<p>"), ("local/z.html", "")], "path string, html string")
    joined = urllists.with_local_html(split, html)
    assert {(r["url"], r["html"]) for r in joined.collect() if r["html"]} == {(C, "<p>")}
    assert joined.count() == 7


def test_list_files(spark, tmp_path, lines):
    listed = tmp_path / "urls.txt"
    listed.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    read = files.read_lines(spark, str(listed)).orderBy("pos")
    assert column(read, "line") == [x.strip() for x in LINES if x.strip()]
    assert files.read_lines_or_none(spark, str(tmp_path / "nothing.txt")) is None
    assert files.read_seed(spark, str(tmp_path / "nothing.txt")) is None
    assert files.read_seed(spark, str(listed)).count() == 6

    out = str(tmp_path / "out")
    files.write_list(urllists.split_lines(urllists.clean_ordered(lines)), out, local_path="local_path")
    for folder in (out, out + "-backup"):
        parts = sorted(p for p in (tmp_path / folder.rsplit("/", 1)[1]).iterdir() if p.name.startswith("part-"))
        text = "".join(p.read_text(encoding="utf-8") for p in parts).splitlines()
        assert text == ["# x", A, f"{B}?x=1", f"{C} local/c.html", NONE]
    clean = tmp_path / "clean"
    files.write_clean_list(urllists.clean_recommended(lines), str(clean))
    parts = sorted(p for p in clean.iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).startswith("# One product URL per line.")
    files.append_found(spark.createDataFrame([("u9",)], "url string"), str(clean))
    assert "u9" in column(spark.read.text(str(clean)), "value")


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nä</p>", encoding="utf-8")
    row = page_files.read_html_files(spark, str(tmp_path)).first()
    assert row["path"].endswith("/a.html") and row["html"] == "<p>\nä</p>"


LISTING = [(0, 1, "u0 u1 u2"), (0, 2, "u1"), (0, 3, ""), (0, 4, "u2"), (0, 5, "u3"), (1, 1, "u3 u1"), (1, 2, "u4 u5")]


def discovered(spark, listing, blocked=(), max_urls=None):
    pages = spark.createDataFrame([(c, p, (c, p) in blocked) for c, p, _ in listing],
                                  "cat_idx int, page_num int, blocked boolean")
    links = spark.createDataFrame([(c, p, u) for c, p, us in listing for u in us.split()],
                                  "cat_idx int, page_num int, url string")
    seed = spark.createDataFrame([("u0",)], "url string")
    found = discovery.discover(pages, links, seed=seed, max_urls=max_urls)
    return {(r["url"], r["cat_idx"], r["page_num"]) for r in found.collect()}


def test_discovery(spark):
    full = {("u1", 0, 1), ("u2", 0, 1), ("u3", 1, 1), ("u4", 1, 2), ("u5", 1, 2)}
    assert discovered(spark, LISTING) == full
    assert discovered(spark, LISTING, max_urls=100) == full
    assert {u for u, _, _ in discovered(spark, LISTING, max_urls=4)} == {"u1", "u2", "u3"}
    assert {u for u, _, _ in discovered(spark, LISTING, max_urls=2)} == {"u1", "u2"}
    assert discovered(spark, LISTING, max_urls=1) == set()


def test_blocked_page_changes_no_streak(spark):
    shifted = [(c, p + (c == 0 and p > 2), u) for c, p, u in LISTING] + [(0, 3, "zz")]
    assert {u for u, _, _ in discovered(spark, shifted, blocked={(0, 3)})} == {"u1", "u2", "u3", "u4", "u5"}


def test_discovery_random_walks(spark):
    """Against a page-by-page walk, with many categories that share links."""
    import random
    rng = random.Random(3)
    for _ in range(2):
        listing = [(c, p, " ".join(f"u{rng.randrange(60)}" for _ in range(rng.randrange(4))))
                   for c in range(4) for p in range(1, 25)]
        blocked = {(c, p) for c, p, _ in listing if rng.random() < 0.1}
        for cap in (None, 20):
            got, streak, last = {"u0"}, 0, None
            for c, p, us in listing:
                streak, last = (streak if c == last else 0), c
                if streak >= 3 or (cap is not None and len(got) >= cap) or (c, p) in blocked:
                    continue
                fresh = set(us.split()) - got
                got |= fresh
                streak = 0 if fresh else streak + 1
            assert {u for u, _, _ in discovered(spark, listing, blocked, cap)} == got - {"u0"}


def test_discover_urls_from_html(spark):
    html = '<a href="/x-p-1.html?c=2">a</a><a href="/x-p-1.html">b</a><a href="/about">c</a><a>d</a>'
    pages = spark.createDataFrame([(0, 1, "https://s.example/c?page=1", html),
                                   (0, 2, "https://s.example/RISK/c?page=2", html.replace("p-1", "p-2"))],
                                  "cat_idx int, page_num int, page_url string, html string")
    seed = spark.createDataFrame([("https://s.example/old-p-9.html",)], "url string")
    found = lifecycle.discover_urls(pages, "https://s.example", seed=seed)
    assert set(column(found, "url")) == {"https://s.example/x-p-1.html", "https://s.example/old-p-9.html"}


def test_category_selection(spark, tmp_path):
    dim = categories.category_dim(spark, "https://s.example")
    assert dim.count() == 26
    choices = spark.createDataFrame([(1, "3, 1,99,3"), (2, "1,x"), (3, "all"), (4, "")], "id int, choice string")
    rows = discovery.select_categories(choices, dim).orderBy("id", "pos").collect()
    assert [(r["id"], r["category_id"]) for r in rows] == [(1, 3), (1, 1), (1, 3)]
    assert discovery.select_categories(choices, dim, all_word=True).where("id = 3").count() == 26
    own = tmp_path / "cats.csv"
    own.write_text("category_id,name,url\n7,Hats,https://h.example/hats?tab=1\n")
    assert categories.category_dim(spark, "", str(own)).collect()[0]["name"] == "Hats"


def test_resume(spark):
    stored = spark.createDataFrame([("u1", "Shirt"), ("u2", " n/a"), ("u3", "Unknown Product")], "url string, name string")
    work = spark.createDataFrame([(f"u{n}", f"u{n}") for n in range(1, 6)], "url string, line string")
    left = store.remaining(work, stored)
    assert column(store.limit_work(left, 0), "url") == ["u2", "u4", "u5"]
    assert column(store.limit_work(left, 2), "url") == ["u2", "u4"]
    assert store.progress(work, stored).first()[:] == (5, 2, 3)


def test_limit_ranks_only_the_border(spark, monkeypatch):
    monkeypatch.setattr(store, "CUTS", 8)
    monkeypatch.setattr(store, "SORTED_LINES", 50)
    lines = [f"{'aB'[n % 2]}{(n * 37) % 400:03d}" for n in range(1000)] + ["same"] * 300 + ["Same"] * 10
    work = spark.createDataFrame([(x,) for x in lines], "line string")
    ordered = sorted(lines, key=lambda x: (x.lower(), x))
    for target in (1, 499, 1100, 1305, 5000):
        assert sorted(column(store.limit_work(work, target), "line"), key=lambda x: (x.lower(), x)) == ordered[:target]
    assert store.limit_work(work.limit(0), 5).count() == 0


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "url string, name string, seq long"
    store.insert_if_absent(spark.createDataFrame([("u1", "Shirt", 1)], schema), path, "seq")
    new = spark.createDataFrame([("u6", "late", 9), ("u1", "changed", 2), ("u6", "first", 3)], schema)
    store.insert_if_absent(new, path, "seq")
    store.insert_if_absent(new, path, "seq")
    rows = {(r["url"], r["name"]) for r in source.read_store(spark, path).collect()}
    assert rows == {("u1", "Shirt"), ("u6", "first")}
    assert store.stored_count(source.read_store(spark, path)).first()[0] == 2
    store.compact(spark, path, str(tmp_path / "compact"))
    assert source.read_store(spark, str(tmp_path / "compact")).count() == 2


def _scanned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_inserts_open_few_buckets(spark, tmp_path):
    held = store.open_store(spark, str(tmp_path / "store"), buckets=32)
    named = lambda low, high: spark.range(low, high).select(F.format_string("u%d", "id").alias("url"))
    held.append(source.in_store_form(named(0, 3000)))
    assert held.may_hold(named(5000, 5020)) == [] or len(held.may_hold(named(5000, 5020))) < 4
    fresh = held.drop_known(named(5000, 5003))
    assert fresh.count() == 3
    plan = _scanned(held.drop_known(named(2999, 3001)))  # one known, one new
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "ReadSchema: struct<url:string>" in plan
    assert [r.url for r in held.drop_known(named(2999, 3001)).collect()] == ["u3000"]
    held.append(source.in_store_form(named(3000, 3010)))  # a second bitmap per slot
    assert held.drop_known(named(0, 3020)).count() == 10 and held.read().count() == 3010
    again = store.open_store(spark, str(tmp_path / "store"), buckets=7)  # the store keeps its own number
    assert again.buckets == 32 and again.drop_known(named(0, 3010)).count() == 0
    small = again.compact(str(tmp_path / "small"))
    assert small.read().count() == 3010 and small.drop_known(named(3005, 3015)).count() == 5


def test_many_stored_urls_are_not_broadcast(spark, tmp_path):
    """The files of 150,000 like URLs are small, the URLs are not."""
    url = F.concat(F.lit("https://s.example/" + "x" * 100 + "/"), F.col("id").cast("string")).alias("url")
    held = store.open_store(spark, str(tmp_path / "urls"))
    held.append(source.in_store_form(spark.range(150_000).select(url)))
    left = held.drop_known(spark.range(149_990, 150_010).select("id", url))
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in left.collect()) == list(range(150_000, 150_010))


def test_many_new_urls_are_not_broadcast(spark, tmp_path, monkeypatch):
    plans = []

    def append(self, rows, urls=None):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        assert rows.count() == 150_000
    monkeypatch.setattr(store.BucketStore, "append", append)
    url = F.concat(F.lit("https://s.example/" + "x" * 100 + "/"), (F.col("id") % 150_000).cast("string")).alias("url")
    new = spark.range(150_010).select(url, F.lit("n").alias("name"), F.col("id").alias("seq"))
    store.insert_if_absent(new, str(tmp_path / "new-urls"), "seq")
    assert len(plans) == 1 and "Broadcast" not in plans[0]


def test_first_row_of_a_url_that_comes_very_often(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.format_string("u%d", F.col("id") % 900)).alias("url"),
                                      (F.lit(20_000) - F.col("id")).alias("seq"), F.col("id").alias("name"))
    rows = rows.unionByName(rows.where("url = 'hot'")).union(spark.createDataFrame([(None, 1, 5), (None, 2, 6)], "url string, seq long, name long"))
    got = {r.url: r.name for r in store.first_per_url(rows, "seq").collect()}
    assert len(got) == 902 and got["hot"] == 14_999 and got[None] == 5


def test_unreadable_store_is_not_an_empty_one(spark, tmp_path):
    (tmp_path / "rows").mkdir()
    (tmp_path / "rows" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        source.read_store(spark, str(tmp_path)).count()


def test_json_store(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    record = {"url": "u", "name": "n", "available_sizes": ["S"],
              "description_structured": {"text": "t", "attributes": {"Color": "Red"}}, "is_international": False}
    good.write_text(json.dumps([record, {"url": "v"}], indent=2))
    bad.write_text('[{"url": "u"')
    rows = source.read_json(spark, str(good)).collect()
    assert [r["url"] for r in rows] == ["u", "v"]
    assert rows[0]["description_structured"]["attributes"] == {"Color": "Red"}
    assert source.read_json(spark, str(bad), strict=False).count() == 0
    with pytest.raises(Exception):
        source.read_json(spark, str(bad)).collect()


@pytest.mark.parametrize("indent", [None, 0, 2])
def test_arrays_are_read_from_any_offset(spark, tmp_path, indent):
    nasty = ['a"}{[', "}", "\\", '\\"', "][}{,", "é}\n", "", '{"url": "no"}']
    records = [{"url": f"u{n} {nasty[n % 8]}", "name": nasty[(n * 3) % 8] * (n % 5), "available_sizes": [nasty[n % 8], "S"],
                "description_structured": {"text": nasty[(n + 1) % 8], "attributes": {nasty[(n + 2) % 8]: "}{"}}} for n in range(400)]
    for part in range(2):
        (tmp_path / f"{part}.json").write_text(json.dumps(records[part::2], indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("[]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")  # dozens of tasks, cut anywhere
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = source.read_json(spark, str(tmp_path))
        rows = {r["url"]: r for r in df.collect()}
        from shelfmark.sources import json_arrays
        assert json_arrays._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 400
    for record in records:
        row = rows[record["url"]].asDict(recursive=True)
        assert {k: row[k] for k in record} == record


def test_broken_records_of_arrays_are_returned(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"url": "u"}, {"url": 5 x}, {"url": "w", "available_sizes": ["S"')
    assert [r["url"] for r in source.read_json(spark, str(path), strict=False).collect()] == ["u"]
    assert [(r["number"], r["record"]) for r in source.broken_json(spark, str(path)).orderBy("number").collect()] == [
        (1, '{"url": 5 x}'), (2, '{"url": "w", "available_sizes": ["S"')]
    with pytest.raises(Exception, match="broken product record"):
        source.read_json(spark, str(path)).collect()


def test_scrape_plan(spark):
    page = '<h1>%s</h1><div id="productMainPriceId">$5.00</div> add to bag'
    pages = spark.createDataFrame([
        (1, "u1", page % "done"), (2, "u2", page % "two"), (3, "u2", page % "two again"),
        (4, "u3", "<h1>please verify</h1> price sku"), (5, "u4", page % ""), (6, "u9", page % "not asked")],
        "page_id long, url string, html string")
    work = spark.createDataFrame([(f"u{n}", f"u{n}") for n in range(1, 6)], "url string, line string")
    stored = spark.createDataFrame([("u1", "Done")], "url string, name string")
    rows = lifecycle.scrape(work, pages, stored).collect()
    assert [(r["url"], r["name"], r["current_price_integer"]) for r in rows] == [("u2", "Two", "5")]


def test_bucketed_pages_are_not_shuffled(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    page_files.land_bucketed(pages, "landed_pages", 8, str(tmp_path / "pages"))
    landed = spark.table("landed_pages")
    listed = pages.where("page_id < 20").select("url")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as if the list were long
    try:
        for keep in (store.keep_listed, store.drop_stored):
            joined = keep(landed, listed, broadcast_bytes=0)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Bucketed: true" in plan
            assert plan.count("Exchange hashpartitioning") == 1
            assert joined.count() == (20 if keep is store.keep_listed else 30)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE landed_pages")


def test_large_append_is_written_by_several_tasks_a_bucket(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.format_string("u%d", "id").alias("url"), F.lit("n").alias("name"))
    monkeypatch.setattr(buckets, "SHARE_ROWS", 25)      # 16 shares of 25 rows in 2 buckets
    held = store.open_store(spark, str(tmp_path / "large"), buckets=2)
    new = source.in_store_form(rows)
    held.append(new, new.select("url"))
    assert len(list((tmp_path / "large" / "rows").glob("bucket=0/*.parquet"))) > 1
    assert sorted(r["url"] for r in held.read().collect()) == sorted(f"u{n}" for n in range(400))
    assert held.drop_known(rows).isEmpty()


def test_files_are_read_in_pieces_that_fill_the_cores(spark):
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for given, kept in (("128MB", str(32 << 20)), ("16m", "16m"), (str(1 << 30) + "b", str(32 << 20))):
            spark.conf.set(name, given)
            assert session.tune(spark).conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
