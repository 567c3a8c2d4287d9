"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 lower-cased characters are hashed to 2^15 features, weighted (1 + log tf) * idf and scaled to length one.
Document frequencies count every training document. The weights are learned by follow-the-regularised-leader with
elastic-net penalties on a bounded sample (TRAIN_DOCS); a temperature fitted on a further slice of the sample calibrates
the probabilities. Held-out rows may be told apart without an error, when log loss alone would drive the temperature to
zero; so it is fitted to smoothed targets, (n + 1) / (n + 2) for a language with n rows, as Platt does. Whole texts are read,
in blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import lean, slices, small_batches, table

FEATURES = 1 << 15
ORDERS = (1, 2, 3)

#: Bound of the labelled sample that the classifier is fitted on, shared equally by the languages; a fifth is for calibration.
TRAIN_DOCS = 4000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3

#: Most languages that a model has weights for; more are refused, as features times languages must fit a task.
MOST_LABELS = 256

#: Calibrated probability below which a pipeline rejects a document's language.
LEAST_SCORE = 0.5

UNKNOWN = "und"
BLOCK = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each feature occurs in the text."""
    total = np.zeros(FEATURES, np.int64)
    for i in range(0, len(text), BLOCK):
        part = text[i : i + BLOCK + max(ORDERS) - 1].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = np.zeros(len(codes), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            if len(codes) < order:
                break
            end = len(codes) - order + 1
            mixed = mixed[:end] * np.uint32(0x01000193) + codes[order - 1 :] + np.uint32(1)
            if order in ORDERS:
                grams = (mixed[:BLOCK] + np.uint32(order)) * np.uint32(0x9E3779B1) >> np.uint32(17)
                total += np.bincount(grams, minlength=FEATURES)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit vector of the text; the last index is the constant."""
    tf = counts(text)
    at = np.flatnonzero(tf)
    x = (1 + np.log(tf[at])) * idf[at]
    norm = np.sqrt(x @ x)
    x = x / norm if norm else x
    return np.append(at, FEATURES), np.append(x, 1.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression."""

    def __init__(self, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def smoothed_loss(logits: np.ndarray, y: np.ndarray, heat: float) -> float:
    """Log loss at a temperature against targets of (n + 1) / (n + 2) for a language with n rows, the rest shared."""
    classes = logits.shape[1]
    n = np.bincount(y, minlength=classes)[y]
    right = (n + 1) / (n + 2)
    z = logits / heat
    z = z - z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    own = log_p[np.arange(len(y)), y]
    others = (log_p.sum(axis=1) - own) / max(1, classes - 1)
    return float(-(right * own + (1 - right) * others).mean())


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least smoothed loss, by golden section over its logarithm; 1 without rows or choice."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    low, high, step = -12.0, 12.0, (np.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        one, two = high - step * (high - low), low + step * (high - low)
        if smoothed_loss(logits, y, np.exp(one)) <= smoothed_loss(logits, y, np.exp(two)):
            high = two
        else:
            low = one
    return float(np.exp((low + high) / 2))


@lean
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(FEATURES, np.int64), 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            seen += counts(text) > 0
            docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["feature", "docs"])


@lean
def _train(batches: Iterator[pa.RecordBatch], idf: np.ndarray, labels: list[str]) -> Iterator[pa.RecordBatch]:
    """Fits on the whole sample, rows (text, lang) in a fixed order, in one task; the sample is bounded."""
    model, rows, number = Ftrl(len(labels)), [], {x: i for i, x in enumerate(labels)}
    for batch in batches:
        rows += [(*features(t, idf), number[y]) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    held = rows[: len(rows) // 5]
    for _ in range(EPOCHS):
        for at, x, y in rows[len(held) :]:
            model.learn(at, x, y)
    w = model.weights(slice(None)).astype(np.float32)
    t = temperature(np.array([x @ w[at] for at, x, _ in held]).reshape(-1, len(labels)), np.array([y for *_, y in held], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["weights", "temperature"])


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.labels, self.idf, self.weights, self.heat = labels, idf, weights, heat

    def predict(self, text: str) -> tuple[str, float]:
        at, x = features(text, self.idf)
        p = softmax((x @ self.weights[at]) / self.heat)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])

    def save(self) -> str:
        return json.dumps({"labels": self.labels, "heat": self.heat, "idf": self.idf.tolist(), "weights": self.weights.tolist()})


def held_out(id_col: str):
    """Documents that the classifier never learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model | None:
    """Learn from text and non-null language of the documents that aren't held out; None if there are none with a letter.

    ``most`` bounds the sample, drawn evenly from the languages by a hash of the identifier. Rows without an identifier
    are not learned from. Over ``MOST_LABELS`` languages raise a ValueError.
    """
    known = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}")
    rows = docs.where(known).select(F.col(id_col).cast("string").alias("ident"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if not per:
        return None
    if len(per) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages to learn")
    labels, share = sorted(per), max(1, most // len(per))
    with small_batches(docs.sparkSession):
        found = rows.select("text").mapInArrow(_document_frequencies, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect()
    df = np.zeros(FEATURES)
    n = next(r.docs for r in found if r.feature < 0)
    for r in found:
        if r.feature >= 0:
            df[r.feature] = r.docs
    idf = np.log((1 + n) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64("ident"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for k, v in per.items() for x in (k, min(1.0, share / v))])[F.col("lang")]
    sample = rows.where(draw < rate).withColumn("draw", F.xxhash64("ident")).repartition(1).sortWithinPartitions("draw", "ident", "text")
    with small_batches(docs.sparkSession):
        row = sample.select("text", "lang").mapInArrow(partial(_train, idf=idf, labels=labels), "weights binary, temperature double").first()
    return Model(labels, idf, np.frombuffer(row.weights, np.float32).reshape(FEATURES + 1, len(labels)), row.temperature)


def predicted(rows: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """``rows`` with _platewise_lang and _platewise_score; all are ``und`` with score 0 if there is no model."""
    if model is None:
        return rows.withColumns({"_platewise_lang": F.lit(UNKNOWN), "_platewise_score": F.lit(0.0)})
    # features times languages numbers, however large the corpus
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # only texts go to Python, a hundred at a time; rows stay. Not deterministic: else a filter would ask a second time
    told = F.udf(lambda text: (UNKNOWN, 0.0) if text is None else shared.value.predict(text), "lang string, score double", useArrow=False).asNondeterministic()
    found = rows.withColumn("_platewise_found", told(F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))))
    return found.withColumns({"_platewise_lang": F.col("_platewise_found.lang"), "_platewise_score": F.col("_platewise_found.score")}).drop("_platewise_found")


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, lang_pred, score).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no model was learned. Only the text
    decides; the first language in order of name, if two are as likely. Repeated rows come back as often as they came in.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("ident"), held_out(id_col).alias("held_out"), F.col(text_col).alias("body"))
    return predicted(rows, model, "body").select(F.col("ident").alias(id_col), "held_out", F.col("_platewise_lang").alias("lang_pred"), F.col("_platewise_score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns; a null language is filled by the prediction.

    Rejected are texts that are null or have no letter, and texts whose calibrated probability is below ``least`` unless the
    prediction agrees with the language that they state. Each row is decided by itself. Without labelled rows there is no
    model: then only the former are rejected.
    """
    model = fit(docs, id_col, text_col, lang_col)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.where(letters)
    rows = predicted(docs, model, text_col)
    sure = (F.col("_platewise_score") >= least) | (F.col("_platewise_lang") == F.coalesce(F.col(lang_col), F.lit("")))
    kept = rows.where((F.col("_platewise_lang") != UNKNOWN) & sure)
    return kept.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col("_platewise_lang"))).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
