"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

The kernel compares words by their common subsequences of three characters, gaps allowed
within a span of ``SPAN``; a subsequence over a span s weighs DECAY ** s. An insult with
inserted characters (``id.i-ot``) keeps most of its subsequences; letters set apart by blanks are
joined first (``i d i o t``). Landmarks are words of the training sample: those most
telling for toxic documents, and common clean ones. A sentence is, for each landmark, the
largest kernel value among its words, raised to ``POWER``; the Nystrom map whitens that vector and a
linear support vector machine, trained on sentences, scores it. A document's labels hold
for its sentences as multiple instances: in a toxic document the best-scoring sentence is the
positive one, in a clean one all are negative. A document scores as its worst sentence.

Training reads a bounded sample of labelled rows (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``); every
whole text is scored. Defined results: a null or empty text, and any text if no toxic or no
clean row is labelled, has the score of a sentence without words or 0 respectively;
repeated labels of a document count as toxic if one does; a null doc_id is not held out;
repeated rows score alike; clashing columns never enter, only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SAMPLE_TOXIC = 800
SAMPLE_CLEAN = 1200
SPAN = 5
#: Exponent of the kernel between words; a larger one tells near words better apart.
POWER = 3
DECAY = 0.75
#: Signs before each word, so that subsequences from its start are told from others.
START = "^"
TOXIC_LANDMARKS = 32
CLEAN_LANDMARKS = 2
#: A word is a landmark candidate from so many toxic documents of the sample on.
LEAST_DOCUMENTS = 3
#: Longer words are cut into windows of this length that overlap by half.
WORD_CHARS = 32
REMEMBERED = 200_000
#: Kernel value, raised to its power, from which a landmark stands in a sentence.
WHOLE = 0.5
#: Weight of all positive, and of all negative, sentences against the machine's norm.
COST = 3000.0
TABLE_BITS = 17
#: Reserved column of ``drop_toxic``.
SCORE = "__toxicity_score"
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
EDGES = re.compile(r"^\W+|\W+$")
SIGNS = re.compile(r"[\W_]+")
#: Characters of text read before the words not met yet are learned together.
READ_CHARS = 2_000_000
#: Words whose kernel values are computed at once.
PART_WORDS = 10_000


def word_of(chunk: str) -> str:
    """Lower-cased chunk without signs at its ends."""
    return EDGES.sub("", chunk.lower())


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, weight) of every gapped three-character subsequence.

    ``START`` stands before each word. A key packs three code points."""
    joined = "".join(START + w for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) + len(START) for w in words])
    owners, keys, weights = [], [], []
    for i, j in GAPS:
        n = len(codes) - j
        if n <= 0:
            continue
        inside = owner[:n] == owner[j:]
        owners.append(owner[:n][inside])
        keys.append(((codes[:n] << 42) | (codes[i : i + n] << 21) | codes[j:])[inside])
        weights.append(np.full(int(inside.sum()), DECAY ** (j + 1), dtype=np.float32))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Kernel:
    """Kernel values of words against unit-length landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        owner, keys, weights = subsequences(landmarks)
        self.keys, where = np.unique(keys, return_inverse=True)
        self.rows = np.zeros((len(self.keys) + 1, len(landmarks)), dtype=np.float32)
        np.add.at(self.rows, (where + 1, owner), weights)
        norms = np.sqrt((self.rows**2).sum(axis=0))
        self.rows /= np.where(norms > 0, norms, 1)
        # Keys that share a slot stand in further tables.
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.keys))
        while len(left):
            slots = _slots(self.keys[left])
            _, first = np.unique(slots, return_index=True)
            table = np.zeros(1 << TABLE_BITS, dtype=np.int32)
            table[slots[first]] = left[first] + 1
            self.tables.append(table)
            left = np.delete(left, first)
        self.known = np.concatenate([[-1], self.keys])
        # Length of a word's own vector, a repeated subsequence counting at each place.
        places = np.maximum(0, np.arange(WORD_CHARS + 1)[:, None] + len(START) - np.array([j for _, j in GAPS]))
        self.lengths = np.sqrt(places @ np.array([DECAY ** (2 * j + 2) for _, j in GAPS])).astype(np.float32)

    def _sums(self, words: list[str]) -> np.ndarray:
        """Sums over common subsequences; words of ``WORD_CHARS`` at most."""
        sums = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), sizes + len(START))
        head, middle = codes << 42, codes << 21
        owners, rows, weights = [], [], []
        for i, j in GAPS:
            n = len(codes) - j
            if n <= 0:
                continue
            keys = head[:n] | middle[i : i + n] | codes[j:]
            slots = _slots(keys)
            at = np.flatnonzero(self.tables[0][slots])
            for table in self.tables:  # most keys are unknown, most known ones stand in the first
                row = table[slots[at]]
                right = self.known[row] == keys[at]
                found = at[right]
                inside = owner[found] == owner[found + j]
                owners.append(owner[found][inside])
                rows.append(row[right][inside])
                weights.append(np.full(int(inside.sum()), DECAY ** (j + 1), dtype=np.float32))
                at = at[~right]
        if owners:
            who = np.concatenate(owners)
            order = np.argsort(who, kind="stable")
            who = who[order]
            if len(who):
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                parts = self.rows[np.concatenate(rows)[order]] * np.concatenate(weights)[order, None]
                sums[who[first]] = np.add.reduceat(parts, first, axis=0)
        lengths = self.lengths[sizes]
        return sums / np.where(lengths > 0, lengths, 1)[:, None]

    def values(self, words: list[str]) -> np.ndarray:
        """Kernel values over the words' own lengths; a word with inner signs also counts without them."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        parts, owners = [], []
        for k, w in enumerate(words):
            forms = [w] if w.isalnum() else [w, SIGNS.sub("", w)]
            for form in forms:
                if len(form) <= WORD_CHARS:
                    parts.append(form)
                    owners.append(k)
                else:
                    half = WORD_CHARS // 2
                    for at in range(0, len(form) - half, half):
                        parts.append(form[at : at + WORD_CHARS])
                        owners.append(k)
        for at in range(0, len(parts), PART_WORDS):
            part, own = parts[at : at + PART_WORDS], np.array(owners[at : at + PART_WORDS])
            sums = self._sums(part)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.maximum.reduceat(sums, first, axis=0)
            out[own[first]] = np.maximum(out[own[first]], best)
        return out


class Sentences:
    """Landmark vectors of the sentences of texts; remembers the chunks and words it has met."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {}  # twice the row of the word, plus 1 at the end of a sentence
        self.words: dict[str, int] = {}
        self.values = np.zeros((0, len(self.kernel.landmarks)), dtype=np.float32)
        self.single = np.zeros(0, dtype=bool)

    def _learn(self, chunks: list[str]) -> None:
        own = list(map(word_of, chunks))
        words = [w for w in dict.fromkeys(own) if w not in self.words]
        n = len(self.words)
        need = n + len(words)
        if need > len(self.values):
            grown = np.zeros((max(need, 2 * n), self.values.shape[1]), dtype=np.float32)
            grown[:n] = self.values[:n]
            self.values, self.single = grown, np.concatenate([self.single[:n], np.zeros(len(grown) - n, dtype=bool)])
        if words:
            self.values[n:need] = self.kernel.values(words)
            self.single[n:need] = [len(w) == 1 for w in words]
            self.words.update(zip(words, range(n, need), strict=True))
        self.chunks.update((c, 2 * self.words[w] + (c[-1] in ".!?")) for c, w in zip(chunks, own, strict=True))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Raised landmark vectors of all sentences, and the count of sentences of each text."""
        if len(self.words) > REMEMBERED or len(self.chunks) > 2 * REMEMBERED:
            self.forget()
        split = [(t or "").split() for t in texts]
        lengths = np.array([len(c) for c in split], dtype=np.int64)
        chunks = [c for own in split for c in own]
        counts = np.zeros(len(texts), dtype=np.int64)
        if not chunks:
            return np.zeros((0, len(self.kernel.landmarks)), dtype=np.float32), counts
        found = list(map(self.chunks.get, chunks))
        if None in found:
            self._learn(list(dict.fromkeys(c for c, f in zip(chunks, found, strict=True) if f is None)))
            found = list(map(self.chunks.__getitem__, chunks))
        codes = np.array(found)
        rows, ends = codes >> 1, (codes & 1).astype(bool)
        opens = np.concatenate([[True], ends[:-1]])
        opens[np.cumsum(lengths)[:-1][lengths[1:] > 0] if len(texts) > 1 else []] = True
        starts = np.flatnonzero(opens)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        counts += np.bincount(text_of[starts], minlength=len(texts))
        out = np.empty((len(starts), self.values.shape[1]), dtype=np.float32)
        for at in range(0, len(starts), 4096):  # the gathered rows stay small
            part = starts[at : at + 4096]
            stop = starts[at + 4096] if at + 4096 < len(starts) else len(rows)
            out[at : at + 4096] = np.maximum.reduceat(self.values[rows[part[0] : stop]], part - part[0], axis=0)
        # Letters set apart by blanks, at least three in a row within a text.
        single = self.single[rows]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
        runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3]
        if runs:
            joined = self.kernel.values(["".join(map(word_of, chunks[a:b])) for a, b in runs])
            np.maximum.at(out, np.searchsorted(starts, [a for a, _ in runs], side="right") - 1, joined)
        return out**POWER, counts


class Model:
    """Landmarks, machine and the sigmoid that turns its margin into a score."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.kernel, self.weights, self.bias, self.slope, self.shift = kernel, weights, bias, slope, shift

    def margins(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Margin of each text's worst sentence; the bias for a text without words."""
        out = np.full(len(counts), self.bias)
        if len(vectors):
            some = counts > 0
            first = (np.cumsum(counts) - counts)[some]
            out[some] += np.maximum.reduceat(vectors @ self.weights, first)
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(-(self.slope * margins + self.shift), -50, 50)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the margin's violators."""
    z = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        new = np.linalg.solve(ridge + (za * ca[:, None]).T @ za, za.T @ (ca * y[active]))
        if np.allclose(new, w, rtol=1e-6, atol=1e-9):
            break
        w = w + (new - w) * 0.8
    return w[:-1], float(w[-1])


def pick_landmarks(texts: list[str], toxic: list[int]) -> tuple[list[str], list[str]]:
    """Telling words of toxic documents and common words of clean ones."""
    bad, good = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        (bad if label else good).update({w for w in map(word_of, (text or "").split()) if len(w) > 2})
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    odds = {w: np.log((c + 0.1) / n_bad) - np.log((good[w] + 0.1) / n_good) for w, c in bad.items() if c >= LEAST_DOCUMENTS}
    ranked = sorted(odds, key=lambda w: (-odds[w] * np.sqrt(bad[w]), w))
    ranked = [w for w in ranked if odds[w] >= 1.5][: 12 * TOXIC_LANDMARKS]
    picked: list[str] = []
    if ranked:
        near = Kernel(ranked).values(ranked)
        taken: list[int] = []
        for k in range(len(ranked)):
            if len(taken) < TOXIC_LANDMARKS and (not taken or near[k, taken].max() < 0.8):
                taken.append(k)
        picked = [ranked[k] for k in taken]
    clean = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if w not in picked]
    return picked, clean[:CLEAN_LANDMARKS]


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of some ``READ_CHARS`` together."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= READ_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def _bags(vectors: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(vectors, np.cumsum(counts)[:-1]) if len(counts) else []


def train(texts: list[str], toxic: list[int], rounds: int = 4) -> Model | None:
    """Fit landmarks, machine and sigmoid on labelled texts; None without both labels."""
    if not any(toxic) or all(toxic):
        return None
    picked, common = pick_landmarks(texts, toxic)
    landmarks = picked + common
    if not picked:
        return None
    kernel = Kernel(landmarks)
    reader = Sentences(kernel)
    bags = [b for part in _parts(texts) for b in _bags(*reader.of(part))]
    del reader
    gram = kernel.values(landmarks) ** POWER
    gram = (gram + gram.T) / 2
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    values = np.maximum(values, 1e-3 * values.max())
    whiten = vectors / np.sqrt(values) @ vectors.T
    clean = [b for b, t in zip(bags, toxic, strict=True) if not t and len(b)]
    telling = np.arange(len(landmarks)) < len(picked)
    bad = [b for b, t in zip(bags, toxic, strict=True) if t and len(b)]
    # Sentences of toxic documents that hold a landmark nearly whole are positive from the start.
    plain = np.concatenate([b[b[:, telling].max(axis=1) >= WHOLE] for b in bad])
    witness = [b[b[:, telling].max(axis=1).argmax()] for b in bad]
    negative = np.concatenate(clean) if clean else np.zeros((0, len(landmarks)))
    if len(negative) > 40_000:  # the sentences nearest to a landmark bound the others
        negative = negative[np.argsort(-negative[:, telling].max(axis=1), kind="stable")[:40_000]]
    weights, bias = np.zeros(len(landmarks)), 0.0
    for _ in range(rounds):
        positive = np.concatenate([np.array(witness), plain])
        x = np.concatenate([positive, negative]) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        cost = np.where(y > 0, COST / max(1, len(positive)), COST / max(1, len(negative)))
        w, bias = svm(x, y, cost)
        weights = whiten @ w
        fresh = [b[(b @ weights).argmax()] for b in bad]
        if all(np.array_equal(p, q) for p, q in zip(fresh, witness, strict=True)):
            break
        witness = fresh
    model = Model(kernel, weights, bias, 1.0, 0.0)
    margins = model.margins(np.concatenate(bags), np.array([len(b) for b in bags]))
    labels = np.array(toxic, dtype=np.float64)
    # Sigmoid whose middle is the margin of least error; a clean text lost weighs five times a toxic one kept.
    order = np.unique(margins)
    middles = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    if len(middles) > 4000:
        middles = middles[np.linspace(0, len(middles) - 1, 4000).astype(int)]
    errors = [5 * ((margins >= m) & (labels == 0)).mean() / (labels == 0).mean() + ((margins < m) & (labels == 1)).mean() / (labels == 1).mean() for m in middles]
    best = np.flatnonzero(np.isclose(errors, min(errors)))
    model.slope = 4.0
    model.shift = -4.0 * float(middles[best[len(best) // 2]])
    return model


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded training sample: rows whose remainder is not 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder(5) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, most / max(1, counts.get(label, 1))))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    # The draw holds about SAMPLE_TOXIC + SAMPLE_CLEAN ids, whatever the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


_READERS: dict[int, tuple[Model, Sentences]] = {}


def with_score(docs: DataFrame, model: Model | None, out: str = "_score") -> DataFrame:
    """Every row with the score of its ``text``."""
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    schema, at = StructType([*docs.schema.fields, StructField(out, DoubleType())]), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes, set by the landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if _READERS.get(0, (None,))[0] is not model:
            _READERS[0] = (model, Sentences(model.kernel))
        reader = _READERS[0][1]
        for batch in batches:
            scores = [x for part in _parts(batch.column(at).to_pylist()) for x in model.scores(model.margins(*reader.of(part))).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(*sample(docs, labels))
    scored = with_score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = train(*sample(docs, labels))
    return with_score(docs, model, SCORE).where(F.col(SCORE) < 0.5).drop(SCORE)
