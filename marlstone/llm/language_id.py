"""Language ID by error-correcting output codes over hashed letter n-grams.

Each language has a codeword; a binary n-gram classifier predicts each bit. A text goes to the
language whose codeword has the smallest loss under the bit margins, weighted by how reliable
each bit was in training; a small lead over the runner-up is flagged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

DIMS = 4096
ORDERS = 3
#: At most about this many labelled rows are fitted, spread evenly over the languages.
TRAIN_ROWS = 3000
#: Languages that are learned at most.
MOST_LANGUAGES = 200
STEPS = 150
#: A lead in score below this is flagged as ambiguous.
LEAST_LEAD = 0.2
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> whether it is a letter."""
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed n-grams of 1 to 3 characters, over the whole text in
    lower case with each run of other characters than letters as one gap; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate(([0], code[keep], [0])).astype(np.uint64)
    counts = np.zeros(DIMS)
    gram = np.zeros(len(code), np.uint64)
    for k in range(ORDERS):
        gram = gram[: len(code) - k] * np.uint64(0x100000001B3) + code[k:] + np.uint64(1 + k)
        h = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
        counts += np.bincount(h.astype(np.int64), minlength=DIMS)
    return np.sqrt(counts / counts.sum())


def codewords(n: int) -> np.ndarray:
    """n x bits of +1/-1: every split of the languages where there are few, else the best of
    100 seeded random codes by smallest distance of two words."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        bits = (1 << (n - 1)) - 1
        return np.array([[1 if i == 0 or not (b + 1) >> (i - 1) & 1 else -1 for b in range(bits)] for i in range(n)], float)
    rng, best, far = np.random.default_rng(11), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    """Weights (DIMS x bits), bias and reliability of the bits, codewords and languages."""

    def __init__(self, languages: list[str], code, weights, bias, trust):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score (0 to 1) and its lead over the next."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(1) for word in self.code], 1)
        best = loss.argmin(1)
        score = np.exp(loss.min(1)[:, None] - loss)
        score /= score.sum(1, keepdims=True)
        ranked = np.sort(score, 1)
        lead = ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else 0)
        return best, np.clip(score[np.arange(len(best)), best], 0, 1), lead


def fit(x: np.ndarray, y: list[str], languages: list[str]) -> Model:
    """A logistic classifier for each bit by gradient steps with momentum."""
    code = codewords(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    goal = code[[at[v] for v in y]]
    w, b = np.zeros((DIMS, code.shape[1])), np.zeros(code.shape[1])
    if code.shape[1]:
        share = np.bincount([at[v] for v in y], minlength=len(languages))
        row = 1 / np.maximum(share, 1)[[at[v] for v in y]]
        row = (row / row.sum())[:, None]
        xs = x.astype(np.float32)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, STEPS + 1):
            z = np.clip(goal * (xs @ w.astype(np.float32) + b), -30, 30)
            g = -(row * goal) / (1 + np.exp(z))
            gw, gb = xs.T @ g.astype(np.float32) + 1e-5 * w, g.sum(0)
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        right = ((xs @ w + b) * goal > 0).mean(0)
        trust = np.clip(2 * right - 1, 0.05, 1)
    else:
        trust = np.ones(0)
    return Model(languages, code, w, b, trust)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int = TRAIN_ROWS, most_languages: int = MOST_LANGUAGES
) -> Model:
    """Fits a model on about ``train_rows`` rows, chosen by a hash of the id, evenly by language,
    of the ``most_languages`` most frequent languages (ties by name); others are not learned. Only
    n-gram vectors of these rows reach the driver. Rows without text or language are left out."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(most_languages).collect()
    each = max(1, train_rows // max(1, len(counts)))
    # at most most_languages rows
    shares = labelled.sparkSession.createDataFrame([(r[0], min(1.0, each / r[1])) for r in counts], "_lang string, _share double")
    at = F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("string")), 11) / float(1 << 53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, x) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (x := features(text.as_py())) is not None]
            where = [np.flatnonzero(x) for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in found], pa.string()),
                    pa.array([w.astype(np.int32) for w in where], pa.list_(pa.int32())),
                    pa.array([x[w].astype(np.float32) for (_, x), w in zip(found, where, strict=True)], pa.list_(pa.float32())),
                ],
                ["lang", "at", "value"],
            )

    sample = rows.join(F.broadcast(shares), "_lang").filter(at < F.col("_share")).select("_lang", "_text").mapInArrow(run, "lang string, at array<int>, value array<float>")
    got = sample.toArrow().sort_by("lang")
    x, y = np.zeros((got.num_rows, DIMS), np.float32), got.column("lang").to_pylist()
    for i, (k, v) in enumerate(zip(got.column("at"), got.column("value"), strict=True)):
        x[i, k.values.to_numpy()] = v.values.to_numpy()
    return fit(x, y, sorted(set(y)))


def predicted(text: Column, model: Model, least_lead: float = LEAST_LEAD) -> Column:
    """Struct of ``lang_pred``, ``score`` and ``ambiguous`` of a whole text, by Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        n = len(texts)
        lang, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
        for begin in range(0, n, 256):
            found = [(i, x) for i in range(begin, min(begin + 256, n)) if (x := features(texts[i].as_py())) is not None]
            if found and model.languages:
                at = [i for i, _ in found]
                best, s, lead = model.decode(np.stack([x for _, x in found]))
                score[at], unsure[at] = s, lead < least_lead
                for i, k in zip(at, best, strict=True):
                    lang[i] = model.languages[k]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["lang_pred", "score", "ambiguous"])

    return F.arrow_udf(run, "lang_pred string, score double, ambiguous boolean", F.ArrowUDFType.SCALAR)(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_lead: float = LEAST_LEAD) -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` and ``ambiguous``.

    One map over Arrow batches. Text that is null, empty or without a letter is ``und`` with
    score 0 and not ambiguous, as is every text where no language was learned. Equal losses go
    to the first language by name. Texts count whole; other columns are ignored."""
    found = docs.select(F.col(id_col).alias("_id"), predicted(F.col(text_col), model, least_lead).alias("_p"))
    return found.select(F.col("_id").alias(id_col), "_p.lang_pred", "_p.score", "_p.ambiguous")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
