"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier on character n-grams predicts
which half of the languages a text belongs to. Decoding weighs a bit's hinge loss by how well
its classifier did on the training sample and takes the codeword of least loss. A text
whose second-best codeword is nearly as near is flagged as ambiguous.

The classifiers are regularized least squares on hashed 1- to 3-grams, solved over a bounded
sample of ``SAMPLE`` rows at most per language (fewer each with very many languages).

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no
labelled row every text is ``und``; with one language every text with a letter is that one.
A null doc_id is not held out; copies enter the sample once; clashing columns never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 400
SAMPLE_ALL = 4000
DIMENSIONS = 1 << 13
RIDGE = 1e-3
#: Exhaustive codes up to here; more languages get drawn codewords.
EXHAUSTIVE = 6
#: Codewords whose losses differ by less are not told apart.
AMBIGUOUS = 0.05
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Unit vector of damped counts of hashed character n-grams of the whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lower = (codes >= 97) & (codes <= 122)
    letter = lower | (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes <= 0x206F))
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keep = np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)]) if len(codes) else np.zeros(0, bool)
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    counts = np.bincount(c[1:-1] * np.uint32(2654435761) >> np.uint32(19), minlength=DIMENSIONS).astype(np.float32)
    two = c[:-1] * np.uint32(40503) + c[1:]
    counts += np.bincount(two * np.uint32(2246822519) >> np.uint32(19), minlength=DIMENSIONS)
    three = two[:-1] * np.uint32(40503) + c[2:]
    counts += np.bincount(three * np.uint32(3266489917) >> np.uint32(19), minlength=DIMENSIONS)
    damped = np.sqrt(counts)
    return damped / max(1e-6, float(np.sqrt(counts.sum())))


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 per class: all splits of few classes, else drawn ones far apart."""
    if classes < 2:
        return np.zeros((classes, 0))
    if classes <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (classes - 1))
        return np.array([[1.0 if k == classes - 1 or not s >> k & 1 else -1.0 for s in splits] for k in range(classes)])
    bits = int(15 * np.ceil(np.log2(classes)))
    best, distance = None, -1
    for seed in range(200):
        code = np.where(np.random.default_rng(seed).random((classes, bits)) < 0.5, -1.0, 1.0)
        gram = code @ code.T
        np.fill_diagonal(gram, -bits)
        least = (bits - gram.max()) / 2
        if least > distance and (np.abs(code.sum(axis=0)) < classes).all():
            best, distance = code, least
    return best


class Model:
    """Classes, their codewords, the bits' classifiers and weights."""

    def __init__(self, classes: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.classes, self.code, self.weights, self.bias, self.trust = classes, code, weights, bias, trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        if not text or not self.classes or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.classes) == 1:
            return self.classes[0], 1.0, False
        bits = features(text) @ self.weights + self.bias
        losses = np.maximum(0.0, 1.0 - self.code * bits) @ self.trust
        order = np.argsort(losses, kind="stable")
        soft = np.exp(-8.0 * (losses - losses[order[0]]))
        return self.classes[order[0]], float(1.0 / soft.sum()), bool(losses[order[1]] - losses[order[0]] < AMBIGUOUS)


def train(texts: list[str], langs: list[str]) -> Model:
    classes = sorted(set(langs))
    code = codewords(len(classes))
    if len(classes) < 2:
        return Model(classes, code, np.zeros((DIMENSIONS, 0)), np.zeros(0), np.zeros(0))
    x = np.array([features(t) for t in texts])
    number = {c: i for i, c in enumerate(classes)}
    y = code[[number[c] for c in langs]]
    bias = y.mean(axis=0)
    gram = (x @ x.T).astype(np.float64)
    inverse = np.linalg.solve(gram + RIDGE * len(x) * np.eye(len(x)), y - bias)
    # Leave-one-out residuals of the solved system tell how far a bit can be trusted.
    diagonal = np.linalg.inv(gram + RIDGE * len(x) * np.eye(len(x))).diagonal()
    fitted = y - inverse / diagonal[:, None]
    right = (np.sign(fitted) == y).mean(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(classes, code, (x.T @ inverse).astype(np.float32), bias, trust / trust.sum())


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts and languages of the bounded training sample: of each language the ``SAMPLE`` distinct texts of least hash, from rows whose remainder is not 1.

    The hash is of the text, so neither a repeated or null id nor copies change how much is drawn."""
    known = docs.where(F.col("lang").isNotNull() & (_remainder(3) != 1) & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", "text", F.xxhash64("text", F.lit("language")).alias("_h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    if not counts:
        return [], []
    most = max(1, min(SAMPLE, SAMPLE_ALL // len(counts)))
    # About twice as many as are kept pass the first test, all where there are few; the rest is decided by rank.
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2.0 * most / n) if n > 4 * most else 1.0)])
    drawn = known.where(F.pmod("_h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 20)), "_h", "text"))
    rows = drawn.withColumn("_k", rank).where(F.col("_k") <= most).orderBy("_k", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs)))  # DIMENSIONS x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.value.predict
        for batch in batches:
            rows = [predict(t.as_py()) for t in batch.column(2)]
            lang, score, flag = list(zip(*rows, strict=True)) if rows else ([], [], [])
            arrays = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_remainder(3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
