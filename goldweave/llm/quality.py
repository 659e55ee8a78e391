"""Document quality by hierarchical empirical Bayes: what a text says, weighed with what its site is like."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.common import LOWER, slices, text_or_empty, texts_of
from goldweave.session import materialise

#: Labelled rows the text classifier is fitted on at most; a hash of the id picks them.
FIT_ROWS = 50_000
#: Sites up to which the site table is broadcast (about 50 bytes each); beyond, the join shuffles.
BROADCAST_SITES = 100_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:'\"-()"]] = True
N_FEATURES = 12


def _features(text: bytes) -> list[float]:
    """Shares and rates that tell prose from junk; all are 0 for an empty text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, letters, spaces = max(len(text), 1), int(counts[_LETTERS].sum()), int(counts[_SPACES].sum())
    marks, digits = int(counts[_MARKS].sum()), int(counts[_DIGITS].sum())
    n, repeats, seen = 0, 0, set()
    for piece in slices(text.translate(LOWER)):
        words = piece.split()
        n += len(words)
        repeats += sum(map(eq, words, words[1:]))
        seen.update(words)
    distinct = len(seen)
    words = max(n, 1)
    return [math.log1p(n), min(letters / words, 40.0) if n else 0.0, letters / size, int(counts[_UPPER].sum()) / max(letters, 1),
            digits / size, marks / size, (len(text) - letters - spaces - marks - digits) / size, int(counts[ord("|")]) / words,
            int(counts[ord("!")]) / words, repeats / words, math.log1p(distinct) / math.log1p(words) if n else 0.0,
            int(counts[10]) / words]


def text_features(docs: DataFrame, id_column: str, text_column: str, host: Column, path: Column) -> DataFrame:
    """``doc_id, text_hash, host, path, features`` per row, from the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "host", "path"]
        for batch in batches:
            rows = [_features(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rows, pa.list_(pa.float64()))],
                                             names=[*names, "features"])

    text = text_or_empty(text_column)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                      F.coalesce(path.cast("string"), F.lit("")).alias("path"), text.alias("text"))
    return own.mapInArrow(run, "doc_id long, text_hash long, host string, path string, features array<double>")


def _text_logit(features: DataFrame, fit_rows: int) -> tuple[Column, float]:
    """The classifier's log odds as a column, and the log odds of the labels it was fitted on.

    Without labels of both classes the text says nothing: a constant, the smoothed share of good labels.
    """
    facts = features.filter("label is not null").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("good")).first()
    n, good = facts["n"], facts["good"]
    base = math.log((good + 1) / (n - good + 1))
    if not 0 < good < n:
        return F.lit(base), base
    sample = features.filter("label is not null")
    if n > fit_rows:
        sample = sample.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # A label that is a share counts as both classes by weight.
    both = sample.select(array_to_vector("features").alias("x"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("label").alias("w")),
        F.struct(F.lit(0.0).alias("y"), (1 - F.col("label")).alias("w")))).alias("c")).select("x", "c.y", "c.w").filter("w > 0")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, maxIter=60).fit(both)
    logit = F.lit(float(model.intercept))
    for i, w in enumerate(model.coefficients):
        logit = logit + F.col("features")[i] * float(w)
    return logit, base


def _strength(sums: DataFrame, mean: float, most: float = 1000.0) -> float:
    """Rows a prior is worth, by the method of moments: how much sites differ beyond chance."""
    s, n = F.col("good"), F.col("n")
    facts = sums.agg(F.sum(n * (s / n - mean) * (s / n - mean)).alias("spread"), F.sum(n).alias("n"),
                     F.sum(n * n).alias("squares"), F.count(F.lit(1)).alias("sites")).first()
    if not facts["n"] or facts["sites"] < 2:
        return most
    within = mean * (1 - mean)
    size = (facts["n"] - facts["squares"] / facts["n"]) / (facts["sites"] - 1)  # rows of an average site
    between = (facts["spread"] / (facts["sites"] - 1) - within) / max(size, 1e-9)
    if between <= 0:
        return most
    return min(most, max(1.0, within / between - 1))


def assess(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host: str = "source",
           path: str = "lang", label_column: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text_hash, p_text, p_host, p_path, p_quality, keep`` per row of ``docs``.

    A logistic classifier on the labelled rows gives each text's log odds. Over the host and over the
    paths below it (``path``: a column that cuts the host's rows further) the rows' evidence is summed:
    the label where there is one, else the classifier's probability, without the row itself. A host's
    share is shrunk to the global share, a path's to its host's; how far follows from how much
    sites differ. ``p_quality`` joins the text's evidence with the path's share as prior, and a row is
    kept from ``threshold`` on.

    Labels join by id; several labels of one id count as their mean, null labels not at all. Null
    hosts and paths are one site each; a null text is empty; repeated rows stay. Without labels of
    both classes all rows get the labels' smoothed share (one half without labels) and are kept from
    the threshold on. An empty table gives no rows.
    """
    own = text_features(docs, id_column, text_column, F.col(host), F.col(path))
    given = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_column).cast("double").alias("label"))
             .filter("doc_id is not null and label is not null").groupBy("doc_id").agg(
                 F.least(F.greatest(F.avg("label"), F.lit(0.0)), F.lit(1.0)).alias("label")))
    rows, _ = materialise(own.join(given, "doc_id", "left"), "quality-features")
    logit, base = _text_logit(rows, fit_rows)
    rows = rows.select("doc_id", "text_hash", "host", "path", "label", logit.alias("logit")).withColumn(
        "p_text", 1 / (1 + F.exp(-F.col("logit")))).withColumn("own", F.coalesce("label", "p_text"))

    sites, seen = materialise(rows.groupBy("host", "path").agg(F.sum("own").alias("good"), F.count(F.lit(1)).alias("n")),
                              "quality-sites", good=F.sum("good"), n=F.sum("n"))
    if not seen["rows"]:
        mean = 0.5
    else:
        mean = (seen["good"] + 1) / (seen["n"] + 2)
    hosts = sites.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    m_host = _strength(hosts, mean)
    m_path = _strength(sites, mean)
    paths = sites.join(hosts.withColumnsRenamed({"good": "host_good", "n": "host_n"}), "host")
    paths = F.broadcast(paths) if seen["rows"] <= BROADCAST_SITES else paths
    p_host = (F.col("host_good") - F.col("own") + m_host * mean) / (F.col("host_n") - 1 + m_host)
    p_path = (F.col("good") - F.col("own") + m_path * F.col("p_host")) / (F.col("n") - 1 + m_path)
    posterior = F.col("logit") - base + F.log(F.col("p_path") / (1 - F.col("p_path")))
    edge = 1e-6
    return (rows.join(paths, ["host", "path"])
            .withColumn("p_host", F.least(F.greatest(p_host, F.lit(edge)), F.lit(1 - edge)))
            .withColumn("p_path", F.least(F.greatest(p_path, F.lit(edge)), F.lit(1 - edge)))
            .withColumn("p_quality", 1 / (1 + F.exp(-posterior)))
            .select("doc_id", "text_hash", "p_text", "p_host", "p_path", "p_quality",
                    (F.col("p_quality") >= threshold).alias("keep")))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that ``assess`` keeps.

    Rows of equal id and text on different sites go only if every one of them is rejected.
    """
    found = assess(docs, labels, id_column, text_column, host, path, threshold=threshold)
    bad = (found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
           .agg(F.bool_or("keep").alias("kept")).filter(~F.col("kept")))
    own = docs.select(F.struct("*").alias("_row"), F.col(id_column).cast("long").alias("_own_id"),
                      F.xxhash64(text_or_empty(text_column)).alias("_own_hash"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    return own.join(bad, same, "left_anti").select("_row.*")
