"""Column functions against CPython and against fixed cases."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import apierrors, money, names, replies, text, urls

BATCH = settings(max_examples=5, deadline=None, phases=[Phase.generate],
                 suppress_health_check=[HealthCheck.function_scoped_fixture])
LETTERS = "abcxyzÀéßñçØÿĳŒαΩЖя中ا5 9'-_.,/\\:|?*<>\"\t\n  　"
WORDS = st.lists(st.text(alphabet=LETTERS, max_size=120), min_size=40, max_size=80)


def apply(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "n int, s string")
    return [r[0] for r in rows.orderBy("n").select(column(F.col("s"))).collect()]


@BATCH
@given(values=WORDS)
def test_text_functions_equal_cpython(spark, values):
    assert apply(spark, values, text.strip) == [v.strip() for v in values]
    assert apply(spark, values, text.title_case) == [v.title() for v in values]
    assert apply(spark, values, text.upper_first) == [v.capitalize() for v in values]
    assert apply(spark, values, text.first_token) == [(v.split() or [""])[0] for v in values]


@BATCH
@given(values=WORDS)
def test_name_rules(spark, values):
    for raw, name in zip(values, apply(spark, values, names.normalize_name)):
        assert len(name) <= 80
        assert not re.search(r'[<>:"|?*\\/,]|\s\s|[\t\n ]', name)
        assert name == name.strip() and not name.endswith("-")
        letters = re.sub(r"[^\w]", "", raw).casefold()
        assert letters.startswith(re.sub(r"[^\w]", "", name).casefold())


@BATCH
@given(values=WORDS)
def test_safe_names(spark, values):
    for raw, name in zip(values, apply(spark, values, names.safe_name)):
        assert name == "".join(c for c in raw if c not in '<>:"/\\|?*')[:80].strip()


@pytest.mark.parametrize("raw, name", [
    (None, ""), ("", ""),
    ("  Red T-shirt,  \"XL\" ", "Red T - Shirt Xl"),
    ("a/b\\\\c", "A - B - C"),
    ("5pcs women's set -", "5Pcs Women'S Set"),
    ("what? <b>: ok|no*", "What B OkNo"),
    (" - lead", "- Lead"),
    ("x" * 90, "X" + "x" * 79),
    ("1/10/5pcs Women's Keychain Back To School Gift Couple Gift Birthday Gift Wedding Gift Holiday Gift",
     "1 - 10 - 5Pcs Women'S Keychain Back To School Gift Couple Gift Birthday Gift"),
    ("中a ßx", "中A Ssx"),
    ("a -,- b", "A - B"),
    ("ab " * 40, ("Ab " * 27).strip()),
    ("y" * 79 + " z", "Y" + "y" * 78),
    ("w" * 40 + " " + "w" * 39 + " tail", "W" + "w" * 39 + " W" + "w" * 38),
])
def test_names(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(names.normalize_name(F.col("s"))).first()[0] == name


def test_name_options(spark):
    row = spark.createDataFrame([("a?b: c",)], "s string").select(
        names.normalize_name(F.col("s"), replace_with="_"), names.normalize_name(F.col("s"), title=False),
        names.normalize_name(F.col("s"), replace_with=" - ")).first()
    assert row[:] == ("A_B_ C", "ab c", "A - B - C")


MONEY = {
    "R$2.299,08": ("2299", "08"), "$1,234.56": ("1", "23"), "$12.5": None, "1.299.08": ("1299", "08"),
    "R$ 49,90": ("49", "90"), "": None, "from $5.00 to $9.00": ("5", "00"), "$2.00": ("2", "00"),
    "$1234": None, "2.299": ("2", "29"), "US$19.99": ("19", "99"), "..,08": None, "€3.456,7": ("3", "45"),
    "$0.99": ("0", "99"),
}


def test_money_cases(spark):
    values = list(MONEY)
    whole = apply(spark, values, money.price_integer)
    cents = apply(spark, values, money.price_decimal)
    assert [(a, b) if a else None for a, b in zip(whole, cents)] == list(MONEY.values())


def test_amount_locales(spark):
    df = spark.createDataFrame([("$1,234.56", "us"), ("R$1.234,56", "br"), ("$12.5", "us")], "s string, l string")
    for r in df.collect():
        one = spark.createDataFrame([r], "s string, l string")
        got = one.select(money.amount(F.col("s"), r["l"])).first()[0]
        assert str(got) in ("1234.56", "12.50")
    with pytest.raises(ValueError):
        money.amount(F.col("s"), "xx")


def test_cents_round_like_cpython(spark):
    rng = random.Random(7)
    values = [rng.randrange(1, 500000) / 100 / (1 - rng.randrange(1, 99) / 100) for _ in range(4000)]
    values += [k / 1000 for k in range(5, 9000, 10)] + [22.475, 2.675, 1.005, 0.125, 0.375]
    df = spark.createDataFrame(list(enumerate(values)), "n int, x double")
    got = [r[0] for r in df.orderBy("n").select(money.cents(F.col("x"))).collect()]
    assert got == [round(round(v, 2) * 100) for v in values]


@pytest.mark.parametrize("message, kind, label, code", [
    ("429 RESOURCE_EXHAUSTED quota", "quota", "RESOURCE_EXHAUSTED", 429),
    ("daily limit reached", "quota", "DAILY_QUOTA_EXCEEDED", None),
    ("billing: insufficient_quota", "quota", "BILLING_QUOTA_EXCEEDED", None),
    ("404 NOT_FOUND model", "permanent", "NOT_FOUND", 404),
    ("503 UNAVAILABLE", "retryable", None, None),
    ("generated value missing", "retryable", None, None),
    ("KeyError: x", "other", None, None),
])
def test_api_errors(spark, message, kind, label, code):
    m = F.col("m")
    row = spark.createDataFrame([(message,)], "m string").select(
        apierrors.error_class(m).alias("kind"), apierrors.quota_label(m).alias("ql"),
        apierrors.quota_code(m).alias("qc"), apierrors.permanent_label(m).alias("pl"),
        apierrors.permanent_code(m).alias("pc"), apierrors.error_class(m, word_match=True).alias("words")).first()
    assert row["kind"] == kind
    if kind == "quota":
        assert (row["ql"], row["qc"]) == (label, code)
    if kind == "permanent":
        assert (row["pl"], row["pc"]) == (label, code)
    assert row["words"] == ("other" if message.startswith("generated") else kind)


def test_backoff(spark):
    got = spark.range(0, 6).select(apierrors.backoff_seconds(F.col("id"))).collect()
    assert [r[0] for r in got] == [None, 15, 30, 60, None, None]


@pytest.mark.parametrize("reply, value", [
    ('```json\n{"a": 1}\n```', '{"a":1}'), ('well {"b": 2} or {"c": 3}', '{"b":2}'),
    ('[1, 2]', '[1,2]'), ("none", None), ('{"a": {"b": 1} oops', '{"b":1}'), ("{x}", None),
    ('{"a": 1, "b": 2, "a": 3}', '{"a":3,"b":2}')])
def test_json_replies(spark, reply, value):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(replies.salvage_json(F.col("r")).cast("string")).first()[0] == value


def test_urls(spark):
    df = spark.createDataFrame([("https://s.example/a.html?x=1.html", "//h/x", "rel", "/p")],
                               "a string, b string, c string, d string")
    row = df.select(
        urls.canonical(F.col("a")), urls.absolute(F.col("b"), "https://o"), urls.absolute(F.col("b"), "https://o", True),
        urls.absolute(F.col("c"), "https://o"), urls.absolute(F.col("d"), "https://o"),
        urls.page_url(F.col("a"), F.lit(3)), urls.page_url(F.col("c"), F.lit(3)),
        urls.is_short_link(F.lit("x http://go.example/Ab/9"), "go.example"),
        urls.is_short_link(F.lit("http://goXexample/Ab"), "go.example")).first()
    assert row[:] == ("https://s.example/a.html", "https://o//h/x", "https://h/x", "rel", "https://o/p",
                      "https://s.example/a.html?x=1.html&page=3", "rel?page=3", True, False)


def test_title_case_of_every_letter(spark):
    """Whole texts are cased as run by run, whatever letters they have."""
    letters = [c for c in map(chr, range(1, 0x2000)) if c.upper() != c or c.lower() != c]
    around = [a + c + b for c in letters for a, b in (("", ""), ("a", "B"), (" ", "b"), ("5", "b"), ("-B", "."))] + ["\ue000 a", "x\ue000 y"]
    runs = F.regexp_extract_all("s", F.lit(f"([{text._CASED}]+|[^{text._CASED}]+)"), F.lit(1))
    rows = spark.createDataFrame([(v,) for v in around], "s string")
    by_run = F.array_join(F.transform(runs, text.upper_first), "")
    assert rows.where(~by_run.eqNullSafe(text.title_case(F.col("s")))).collect() == []
    plan = rows.select(text.title_case(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "initcap" in plan
