"""Quality classification by hierarchical empirical Bayes.

A logistic model over surface features, fitted on labelled documents, gives each document's evidence
as a log-likelihood ratio. Grouped sums over all documents then give every host, and every path
below it, a posterior share of good documents: a host is shrunk toward the global share and a path
toward its host, by strengths estimated from how much groups differ beyond chance. A document's
posterior joins its evidence with the share of its path, so sparse sites borrow from larger ones.

Only the model is fitted on a sample (``FIT_ROWS`` labelled rows at most, the smallest hashes);
evidence and group shares come from all documents and their whole texts.

Defined cases: null and empty texts are documents without words; a null host or path is a group of
its own; null labels do not count; with no labels, or one class only, evidence is zero and all
documents are kept; repeated rows count each; empty tables stay empty; other columns are untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.session import work_path

#: Labelled rows the model is fitted on, at most.
FIT_ROWS = 20_000
#: Ridge penalty of the fit, and the longest evidence one document may give (in nats).
RIDGE = 1.0
LONGEST = 12.0
#: Strengths (in documents) that an estimated prior may have.
WEAKEST, STRONGEST = 1.0, 1e6

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b"%$#&*|!@^~<>{}[]=+_\\/"
_POINTS = b".,;:?'\"()-"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    some = max(1, n)
    without = lambda drop: (size - len(raw.translate(None, drop)) if raw else 0)
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = raw.count(b"\n") + 1
    marks, upper = without(_MARKS), without(_UPPER)
    return [
        math.log1p(n), math.log1p(len(raw)), len(raw) / some, same / some,
        len(set(words)) / some, pairs / some, marks / size, math.log1p(marks), marks / some,
        upper / size, math.log1p(upper), without(_DIGIT) / size, without(_POINTS) / some,
        raw.count(b". ") / some, raw.count(b" | ") / some, math.log1p(raw.count(b" | ")),
        math.log1p(same), raw.count(b"http") / some, lines / some, math.log1p(lines), 1.0 if n == 0 else 0.0]


def fit(rows: np.ndarray, good: np.ndarray, rounds: int = 30) -> dict:
    """Ridge logistic regression by Newton steps on standardised features and their squares."""
    if len(rows) == 0 or good.min() == good.max():
        return {}
    middle, scale = rows.mean(0), rows.std(0) + 1e-9
    x = _expand(rows, middle, scale)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty),
                               x.T @ (good - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = good.mean()
    return {"middle": middle, "scale": scale, "weights": w, "prior": math.log(share / (1 - share))}


def _expand(rows, middle, scale):
    z = np.clip((rows - middle) / scale, -8, 8)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def evidence(model: dict, rows: np.ndarray) -> np.ndarray:
    """log P(text | good) - log P(text | bad) of each feature row."""
    if not model:
        return np.zeros(len(rows))
    z = _expand(rows, model["middle"], model["scale"]) @ model["weights"]
    return np.clip(z - model["prior"], -LONGEST, LONGEST)


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text",
          label: str = "quality", fit_rows: int = FIT_ROWS) -> dict:
    """Fit on at most ``fit_rows`` labelled documents, those with the smallest hash of their id."""
    picked = (labels.select(labels[id].alias("key"), labels[label].cast("int").alias("good"))
              .where("key is not null and good in (0, 1)")
              .orderBy(F.xxhash64("key"), "key", "good").limit(fit_rows))

    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["good", "row"])

    # At most fit_rows keys are sent, so their size is bounded.
    found = (docs.join(F.broadcast(picked), docs[id] == picked.key).select("good", docs[text].alias("text"))
             .mapInArrow(run, "good int, row array<double>").toArrow())
    if not found.num_rows:
        return {}
    rows = found.column("row").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    return fit(rows, found.column("good").to_numpy().astype(float))


def with_evidence(docs: DataFrame, model: dict, *, text: str = "text", into: str,
                  keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep`` and each document's evidence."""
    keep = list(keep)

    def run(batches):
        for batch in batches:
            rows = np.array([features(t) for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(evidence(model, rows))], [*keep, into])

    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType([docs.schema[c] for c in keep] + [StructField(into, DoubleType())])
    return docs.select(*keep, docs[text].alias("text to judge")).mapInArrow(run, schema)


def _strength(groups: DataFrame, n: str, rate: str, parent: str, within: float, share: float) -> float:
    """Documents a parent's share is worth as prior: fewer the more its groups differ (moments)."""
    row = groups.agg(F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"),
                     F.count(F.lit(1)).alias("groups"), F.countDistinct("parent").alias("parents"),
                     F.sum(F.col(n) * F.pow(F.col(rate) - F.col(parent), F.lit(2))).alias("spread")).head()
    free = (row["n"] or 0) - (row["nn"] or 0) / max(1, row["n"] or 1)
    if not row["groups"] or free <= 0:
        return STRONGEST
    between = (row["spread"] - (row["groups"] - row["parents"]) * within) / free
    if between <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, share * (1 - share) / between - 1))


def group_posteriors(judged: DataFrame, model: dict, *, host: str, path: str, evidence: str) -> DataFrame:
    """(host, path, prior): log odds of a good document for every path, written to the shared folder.

    ``judged`` has a row per document; only one row per path goes on from here.
    """
    spark = judged.sparkSession
    prior = model.get("prior", 0.0)
    chance = 1 / (1 + F.exp(-(F.col(evidence) + F.lit(prior))))
    out = work_path(spark, "site-sums")
    (judged.groupBy(F.col(host).alias("host"), F.col(path).alias("path"))
     .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(chance).alias("s"),
          F.sum(chance * chance).alias("q")).write.parquet(out))
    paths = spark.read.parquet(out)
    total = paths.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.count(F.lit(1)),
                      F.sum(F.col("s") * F.col("s") / F.col("n"))).head()
    if not total[0]:
        return paths.select("host", "path", F.lit(prior).alias("prior"))
    share = min(1 - 1e-6, max(1e-6, total[1] / total[0]))
    within = max(1e-9, (total[2] - total[4]) / max(1.0, total[0] - total[3]))
    hosts = (paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
             .withColumn("hr", F.col("hs") / F.col("hn")))
    k_host = _strength(hosts.withColumn("top", F.lit(share)).withColumn("parent", F.lit(1)),
                       "hn", "hr", "top", within, share)
    hosts = hosts.withColumn("hm", (F.col("hs") + k_host * share) / (F.col("hn") + k_host))
    both = (paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
            .withColumn("r", F.col("s") / F.col("n")).withColumn("parent", F.struct("h")))
    k_path = _strength(both, "n", "r", "hr", within, share)
    mean = (F.col("s") + k_path * F.col("hm")) / (F.col("n") + k_path)
    done = work_path(spark, "site-priors")
    both.select("host", "path", F.log(mean / (1 - mean)).alias("prior")).write.parquet(done)
    return spark.read.parquet(done)


def judge(docs: DataFrame, model: dict, *, text: str = "text", host: str = "source", path: str = "lang",
          keep: Sequence[str] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The columns of ``keep``, evidence, site_prior, posterior and keep (posterior at the threshold).

    Texts are read twice and never shuffled: the group table is joined to the judged rows, by
    broadcast where its written size allows.
    """
    keep = list(keep)
    named = docs.select(*keep, docs[text].alias("judged text"), docs[host].alias("judged host"),
                        docs[path].alias("judged path"))
    judged = with_evidence(named, model, text="judged text", into="evidence",
                           keep=[*keep, "judged host", "judged path"])
    groups = group_posteriors(judged.select("judged host", "judged path", "evidence"), model,
                              host="judged host", path="judged path", evidence="evidence")
    odds = F.col("evidence") + F.col("site_prior")
    groups = groups.select(F.col("host").alias("group host"), F.col("path").alias("group path"),
                           F.col("prior").alias("site_prior"))
    return (judged.join(groups, F.col("judged host").eqNullSafe(F.col("group host"))
                        & F.col("judged path").eqNullSafe(F.col("group path")), "left")
            .select(*keep, "evidence", "site_prior", (1 / (1 + F.exp(-odds))).alias("posterior"),
                    (1 / (1 + F.exp(-odds)) >= threshold).alias("keep")))


def good(docs: DataFrame, model: dict, *, text: str = "text", host: str = "source", path: str = "lang",
         threshold: float = 0.5) -> DataFrame:
    """The documents whose posterior is at the threshold or above, with the same columns."""
    names = [f"column {n}" for n in range(len(docs.columns))]
    inner = docs.toDF(*names)
    at = dict(zip(docs.columns, names))
    judged = judge(inner, model, text=at[text], host=at[host], path=at[path], keep=names, threshold=threshold)
    return judged.where("keep").select(*names).toDF(*docs.columns)
