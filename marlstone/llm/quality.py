"""Quality classifier: document evidence shrunk towards site and path by empirical Bayes.

A logistic classifier over measures and word n-grams of the whole text gives each document's
evidence. Grouped sums give hosts and their paths posterior rates, drawn towards the global rate
and the host's rate by prior strengths estimated from how much the groups differ. A document's
score adds the log-odds of its path (without its own share) to its own.

``documents`` has a host (``source``) but no URL, hence no path: by default the column ``lang``
stands in for the path, as the only other column that groups documents inside a site."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import join_split, table
from marlstone.llm.words import mixed, word_hashes
from marlstone.operators.stages import settled

#: At most about this many labelled rows are fitted, chosen by a hash of the id.
TRAIN_ROWS = 8000
#: Documents below this score are rejected.
LEAST_SCORE = 0.3
# Classes of bytes that the measures count.
BYTE_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#$%&*+<=>@\\^_`{}~", b".,;:'\"?-()/[]", b"\n", b" \t\r\x0b\x0c",
)
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(BYTE_CLASSES, 1):
    _CLASS[list(_bytes)] = _k
N_MEASURES = 16
#: Buckets of hashed word n-grams (a power of two).
GRAM_BITS = 9
GRAMS = 1 << GRAM_BITS


def features(text: bytes) -> np.ndarray:
    """Measures of a whole text, then square roots of the shares of hashed words and word pairs;
    all finite; an empty text has zeros."""
    out = np.zeros(N_MEASURES + GRAMS, np.float32)
    words = word_hashes(text)
    n = len(words)
    if not n:
        return out
    count = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10).astype(float)
    other, upper, lower, digit, bang, pipe, symbol, stop, line, blank = count[:10]
    visible = max(1.0, len(text) - line - blank)
    sorted_words = np.sort(words)
    edges = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1], [True])))
    repeat = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if n > 1 else words
    period = len(np.unique(pairs)) / len(pairs)
    out[:N_MEASURES] = (
        np.log1p(n), visible / n / 10, upper / max(1.0, upper + lower), digit / visible, bang / visible, pipe / visible,
        symbol / visible, stop / visible, line / n, other / visible, (len(edges) - 1) / n, np.diff(edges).max() / n,
        repeat, period, np.log1p(n) * period, 1.0 if upper > 2 * lower else 0.0,
    )
    grams = np.concatenate((words, mixed(pairs))) >> np.uint64(64 - GRAM_BITS)
    share = np.bincount(grams.astype(np.int64), minlength=GRAMS) / len(grams)
    out[N_MEASURES:] = np.sqrt(share)
    return out


def gram_weights(x: np.ndarray, y: np.ndarray, steps: int = 120) -> np.ndarray:
    """Ridge logistic regression by gradient steps with momentum; the last weight is the bias."""
    w, pace = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        g = np.append(x.T @ (p - y) / len(y) + 1e-4 * w[:-1], (p - y).mean())
        pace = 0.9 * pace - 4 * g
        w += pace
    return w


class Evidence:
    """Word n-grams make a first log-odds, which joins the measures in a standardised logistic
    regression. On the training rows it comes from a model of the other half, so that it weighs
    as much there as on unseen texts. Without labels of both kinds every text is even odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.weights = None
        half = np.arange(len(y)) % 2 == 0
        if all(len(set(part.tolist())) > 1 for part in (y[half], y[~half])):
            measures, grams = x[:, :N_MEASURES].astype(float), x[:, N_MEASURES:]
            first, second = gram_weights(grams[half], y[half]), gram_weights(grams[~half], y[~half])
            self.grams = (first + second) / 2
            odds = np.where(half, grams @ second[:-1] + second[-1], grams @ first[:-1] + first[-1])
            m = np.column_stack((measures, np.clip(odds, -8, 8)))
            self.mean, self.scale = m.mean(0), m.std(0) + 1e-9
            z = np.column_stack((np.ones(len(m)), self._spread(m)))
            w = np.zeros(z.shape[1])
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                grad = z.T @ (p - y) + 0.1 * w
                w -= np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.1 * np.eye(len(w)), grad)
            self.weights = w

    def _spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack((z, z**2))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        odds = np.clip(x[:, N_MEASURES:] @ self.grams[:-1] + self.grams[-1], -8, 8)
        m = np.column_stack((x[:, :N_MEASURES].astype(float), odds))
        z = np.column_stack((np.ones(len(x)), self._spread(m))) @ self.weights
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.001, 0.999)

    def of(self, text: Column) -> Column:
        """The evidence of a text, by Arrow batches."""

        def run(texts: pa.Array) -> pa.Array:
            whole, out = texts.cast(pa.large_binary()), []
            for at in range(0, len(whole), 256):
                out.append(self(np.stack([features(t.as_py() or b"") for t in whole[at : at + 256]])))
            return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

        return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR)(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> Evidence:
    """Fits the evidence on about ``train_rows`` labelled documents; their features alone reach
    the driver, and the label sample, bounded by the same parameter, is broadcast."""
    good = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    share = min(1.0, train_rows / max(1, good.count()))
    at = F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("string"), F.lit(9)), 11) / float(1 << 53)
    sample = F.broadcast(good.filter(at < share))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id")

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py() or b"").tobytes() for t in texts.cast(pa.large_binary())], pa.binary())

    order = F.xxhash64(F.col("_id").cast("string"), F.lit(10)).alias("_at")
    got = rows.select(order, F.arrow_udf(run, "binary", F.ArrowUDFType.SCALAR)("_text").alias("x"), "_y").toArrow().sort_by("_at")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_MEASURES + GRAMS)
    return Evidence(x, np.array(got.column("_y").to_pylist(), float))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def prior_strength(rows: int, groups: int, rate: float, spread: float) -> float:
    """Pseudo-counts of the prior by moments: how far groups differ beyond chance."""
    inside = rate * (1 - rate)
    between = spread - inside * max(0, groups - 1) / max(1, rows)
    return float(min(1e6, max(1.0, inside / between - 1 if between > 1e-9 else 1e6)))


def scored_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", train_rows: int = TRAIN_ROWS, least: float = LEAST_SCORE, whole: bool = True,
) -> DataFrame:
    """Each row of ``docs`` as a struct ``row`` (its id alone unless ``whole``), with ``p_doc``,
    ``p_host``, ``p_path``, ``score`` and ``kept``. Rows meet the posteriors of their path in a
    join that broadcasts the most frequent paths, fewer than a fixed number; only rows of rarer
    ones are shuffled."""
    evidence = train(docs, labels, id_col, text_col, label_col, train_rows)
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((host_col, "host"), (path_col, "path"))]
    row = F.struct("*") if whole else F.struct(id_col)
    scored = settled(docs.select(row.alias("row"), *group, evidence.of(F.col(text_col)).alias("p_doc")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn"), F.count("*"), F.sum("hs"), F.sum(F.col("hs") ** 2 / F.col("hn"))).first()
    rows, groups = total[0] or 0, total[1]
    rate = min(0.999, max(0.001, (total[2] or 0.0) / rows if rows else 0.5))
    strength = prior_strength(rows, groups, rate, (total[3] or 0.0) / max(1, rows) - rate**2)
    hosts = hosts.select("host", ((F.col("hs") + strength * rate) / (F.col("hn") + strength)).alias("p_host"))
    paths = settled(paths.join(hosts, "host"))
    inner = paths.agg(F.count("*"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("p_host")) ** 2)).first()
    below = prior_strength(rows, max(1, inner[0] - groups + 1), rate, (inner[1] or 0.0) / max(1, rows))
    p_path = (F.col("s") - F.col("p_doc") + below * F.col("p_host")) / (F.col("n") - 1 + below)
    odds = logit(F.col("p_doc")) + logit(F.col("p_path")) - logit(F.lit(rate))
    return (
        join_split(scored, paths, ["host", "path"], "n", most=1 << 15)
        .withColumn("p_path", F.least(F.lit(0.999), F.greatest(F.lit(0.001), p_path)))
        .select("row", "p_doc", "p_host", "p_path", (1 / (1 + F.exp(-odds))).alias("score"))
        .withColumn("kept", F.col("score") >= least)
    )


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of ``docs``: id, ``p_doc``, ``p_host``, ``p_path``, ``score``, ``kept``;
    ``how`` as for :func:`scored_rows`.

    The path level is the language unless ``path_col`` says otherwise (see the module).

    Null and empty texts have features of zero. Null hosts and paths are groups of their own,
    the empty ones. Labels other than 0 and 1 are ignored; of several labels of an id the
    largest counts. Without usable labels all evidence is 0.5 and everything stays. Repeated
    rows are scored one by one; an empty table gives no rows; other columns are ignored."""
    out = scored_rows(docs, labels, id_col, whole=False, **how)
    return out.select(F.col("row")[id_col].alias(id_col), "p_doc", "p_host", "p_path", "score", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
