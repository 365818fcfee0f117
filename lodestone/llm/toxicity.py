"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are alike by the subsequences of three characters that they share, each weighted down for the gaps
it spans, so "idiot", "id-iot" and "idxiot" stay close; a row of single letters ("i d i o t") counts as one
word. Landmarks are words that tell the labels apart and frequent words; kernel values to the landmarks, times the
inverse square root of the landmarks' own kernel matrix, are a word's Nystroem coordinates. A squared-hinge
support vector machine is trained on labelled sentences, whose feature pools the coordinates of their most toxic
words, and on words, weighted by how many toxic and other sentences hold them. It is linear in the subsequences, so
it folds into one weight for each of them, and a text is scored at the cost of its distinct words. A logistic curve
over a text's highest word scores, fitted on labelled texts that the machine behind the scores did not see, gives
the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled texts that are read for training, at most, those with the smallest hashes of doc_id, and their bytes together.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
LANDMARKS = 256
#: Words that are rows of their own in training, at most: half that tell the labels apart, half the most frequent.
UNITS = 16_000
#: Rounds of training on sentences, the units of a sentence whose coordinates its feature pools, and what it counts beside a word.
ROUNDS, WITNESSES, SHARE = 2, 3, 0.25
SPAN, DECAY, BITS = 5, 0.6, 18
#: Word scores at which a text's words are counted.
LEVELS = (0.3, 0.5, 0.7, 0.9)
#: Places of a subsequence's later characters: of three within SPAN, and of four with one gap at most.
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)] + [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
LETTERS = re.compile(r"(?<!\S)[^\W_](?:\s[^\W_](?!\S)){2,}")
INNER = re.compile(r"[\W_]+")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¡¿"


def units(text: str) -> set[str]:
    """A text's distinct lower-case words with what surrounds them; spelled-out words are joined."""
    text = text.lower()
    out = set(text.split())
    for m in LETTERS.finditer(text):
        out.add("".join(m[0].split()))
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of each gapped three-character subsequence, scaled by the word's length."""
    padded = [f"^{w.strip(EDGE)}$" for w in words]
    sizes = np.array([len(w) for w in padded])
    owner = np.repeat(np.arange(len(words)), sizes)
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    norm = np.zeros(len(words))
    for g in GAPS:
        norm += DECAY ** (2 * (g[-1] - len(g))) * np.maximum(0, sizes - g[-1])
    norm = np.sqrt(np.maximum(norm, 1e-9))
    rows, cols, weights = [], [], []
    for g in GAPS:
        j = g[-1]
        n = len(c) - j
        if n <= 0:
            continue
        same = owner[:n] == owner[j:]
        code = c[:n] + C.U64(len(g))
        for i in g:
            code = code * C.U64(0x9E3779B97F4A7C15) + c[i : n + i]
        rows.append(owner[:n][same])
        cols.append((C.mix(code[same]) >> C.U64(64 - BITS)).astype(np.int64))
        weights.append(DECAY ** (j - len(g)) / norm[owner[:n][same]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(weights)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words and landmarks."""
    r, c, w = subsequences(landmarks)
    used, at = np.unique(c, return_inverse=True)
    sides = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(sides, (at, r), w.astype(np.float32))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for s in range(0, len(words), 2000):
        r, c, w = subsequences(words[s : s + 2000])
        near = np.minimum(np.searchsorted(used, c), max(len(used) - 1, 0))
        ok = used[near] == c
        r, near, w = r[ok], near[ok], w[ok]
        for a in range(0, len(r), 20_000):
            np.add.at(out, s + r[a : a + 20_000], sides[near[a : a + 20_000]] * w[a : a + 20_000, None].astype(np.float32))
    return out


class Machine:
    """Word weights and the logistic curve over a text's pooled word scores."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray | None = None):
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's score; a word broken up by punctuation also counts as its letters alone."""
        r, c, w = subsequences(words)
        out = np.bincount(r, self.weights[c] * w, len(words)) + self.bias
        joined = [(k, j) for k, word in enumerate(words) if not word.isalnum() and (j := INNER.sub("", word.strip(EDGE))) != word.strip(EDGE)]
        if joined:
            at = [k for k, _ in joined]
            r, c, w = subsequences([j for _, j in joined])
            out[at] = np.maximum(out[at], np.bincount(r, self.weights[c] * w, len(at)) + self.bias)
        return out

    def every(self, words: list[str], most: int = 4000) -> np.ndarray:
        """Scores of many words, some at a time."""
        return np.concatenate([np.zeros(0), *(self.words(words[k : k + most]) for k in range(0, len(words), most))])

    @staticmethod
    def pooled(scores: np.ndarray) -> np.ndarray:
        """Highest score, how many lie above some levels, and which share lies above the first."""
        if not len(scores):
            return np.array([1.0] + 6 * [0.0])
        n = [(scores > level).sum() for level in LEVELS]
        return np.array([1.0, max(scores.max(), 0.0), *np.log1p(n), np.sqrt(n[0] / len(scores))])

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.curve, -30, 30)))


def _svm(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights of the squared-hinge machine by Newton steps, over parts (x, up, down).

    Row i of x counts up[i] times as 1 and down[i] times as -1.
    """
    width = parts[0][0].shape[1]
    w = np.zeros(width)
    for _ in range(rounds):
        grad, hessian = ridge * w, ridge * np.eye(width)
        for x, up, down in parts:
            for s in range(0, len(x), 4000):
                rows, u, d = x[s : s + 4000].astype(np.float64), up[s : s + 4000], down[s : s + 4000]
                f = rows @ w
                grad -= 2 * rows.T @ (np.maximum(0, 1 - f) * u - np.maximum(0, 1 + f) * d)
                h = 2 * ((f < 1) * u + (f > -1) * d)
                hessian += (rows * h[:, None]).T @ rows
        step = np.linalg.solve(hessian, grad)
        w -= step
        if np.abs(step).max() < 1e-3 * np.abs(w).max():
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _folded(landmarks: list[str], beta: np.ndarray) -> np.ndarray:
    """A weight for each subsequence, from one for each landmark."""
    r, c, weight = subsequences(landmarks)
    out = np.zeros(1 << BITS)
    np.add.at(out, c, weight * beta[r])
    return out


def _coordinates(words: list[str], landmarks: list[str], root: np.ndarray) -> np.ndarray:
    """Nystroem coordinates of words, and a one."""
    out = np.ones((len(words), len(landmarks) + 1), np.float32)
    out[:, :-1] = kernel(words, landmarks) @ root.astype(np.float32)
    return out


def _machine(texts: list[np.ndarray], y: np.ndarray, to: np.ndarray, names: list[str]) -> Machine:
    """The support vector machine of some labelled texts; ``to`` maps their unit numbers to names.

    Its rows are sentences and words. A sentence's feature pools the coordinates of the units that score highest in
    it under the last round's machine, so its label says that some are toxic or that none is; words that tell the
    labels apart and frequent ones have the labels of the texts that hold them.
    """
    texts = [np.unique(to[own]) for own in texts]
    n = np.zeros((len(names), 2))
    for own, t in zip(texts, y.tolist(), strict=True):
        n[own, t] += 1
    ratio = max(1.0, (y == 0).sum()) / max(1.0, (y == 1).sum())
    odds = np.log((n[:, 1] * ratio + 0.5) / (n[:, 0] + 0.5)) * np.sqrt(n.sum(1))
    held = np.flatnonzero(n.sum(1) > 0)
    ranked, common = held[np.argsort(-odds[held], kind="stable")], held[np.argsort(-n[held, 0], kind="stable")]
    landmarks = [names[k] for k in dict.fromkeys([*ranked[: 2 * LANDMARKS // 3], *common[: LANDMARKS // 3]])]
    if not landmarks:
        return Machine(np.zeros(1 << BITS), -1.0)
    own = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-3 * value.max())))[None, :] @ vector.T
    units = list(dict.fromkeys([*ranked[: UNITS // 2], *common[: UNITS // 2]]))
    x = _coordinates([names[k] for k in units], landmarks, root)
    up, down = n[units, 1] * ratio, n[units, 0]
    once = 1 - 0.5 ** (n[units].sum(1) - 1)  # a word of one text tells nothing
    words = (x, up * once, down * once)
    w = _svm([words])
    for _ in range(ROUNDS):
        machine = Machine(_folded(landmarks, root @ w[:-1]), float(w[-1]))
        scores = machine.every(names)
        top = [t for text in texts if len(t := text[np.argsort(-scores[text], kind="stable")[:WITNESSES]])]
        label = np.array([t for text, t in zip(texts, y.tolist(), strict=True) if len(text)])
        used = np.unique(np.concatenate(top))
        own = _coordinates([names[k] for k in used], landmarks, root)
        pooled = np.array([own[np.searchsorted(used, t)].mean(0) for t in top])
        w = _svm([words, (pooled, SHARE * label * ratio, SHARE * (1.0 - label))])
    return Machine(_folded(landmarks, root @ w[:-1]), float(w[-1]))


def fit(texts: list[np.ndarray], toxic: list[int], vocabulary: list[str]) -> Machine:
    """Train on labelled texts, given as numbers of their units.

    The curve is fitted on both halves of the texts, each scored by a machine of the other half; the machine
    that is returned has seen both.
    """
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():  # nothing to learn: the share of label 1
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Machine(np.zeros(1 << BITS), -1.0, np.array([np.log(share / (1 - share))] + 6 * [0.0]))
    bare = [u.strip(EDGE) for u in vocabulary]
    names = sorted(set(bare))
    number = {u: k for k, u in enumerate(names)}
    to = np.array([number[u] for u in bare], np.int64)
    rows, marks = [], []
    for half in (0, 1):
        if len(set(y[half::2].tolist())) < 2:
            continue
        other = _machine(texts[half::2], y[half::2], to, names)
        scores = other.every(vocabulary)
        rows += [Machine.pooled(scores[own]) for own in texts[1 - half :: 2]]
        marks += y[1 - half :: 2].tolist()
    machine = _machine(texts, y, to, names)
    machine.curve = _logistic(np.array(rows), np.array(marks)) if len(set(marks)) == 2 else np.array([-2.5, 1.0, 0.0, 0.5, 1.0, 1.0, 0.0])
    return machine


def held_out() -> F.Column:
    """Whether labels of a doc_id are not for learning."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Machine:
    """Fit on at most ``sample`` labelled texts, of ``most`` bytes together, whose doc_id is not held out.

    Of several labels of a doc_id the highest counts, of several texts the smallest. Texts beyond the bound on bytes, in
    the order of the sample, are left out of training.
    """
    scratch = C.Scratch(docs.sparkSession)
    own = labels.select(C.whole("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(C.whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    texts = scratch.put(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()  # at most ``sample`` rows
    order = sorted(sizes, key=lambda r: (int(C.mix(np.array([r.doc_id], np.int64).view(C.U64))[0]), r.doc_id))
    place, total = {}, 0
    for r in order:
        if total + r.n <= most:
            place[r.doc_id] = len(place)
            total += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.let_go()
        for batch in batches:
            words = [sorted(units(t.as_py() or "")) if d in place else None for d, t in zip(batch.column(0).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["doc_id", "toxic", "units"])

    number: dict[str, int] = {}
    rows = []
    read = texts.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, units array<string>")
    for r in read.where("units is not null").toLocalIterator():
        rows.append((place[r.doc_id], r.toxic, np.array([number.setdefault(u, len(number)) for u in r.units], np.int32)))
    rows.sort(key=lambda r: r[0])
    names = list(number)
    del number, sizes, order, place
    scratch.free(texts)
    machine = fit([r[2] for r in rows], [r[1] for r in rows], names)
    del rows, names
    C.released(docs.sparkSession)
    return machine


def scorer(machine, most: int = 100_000):
    """A column function from text to the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        C.let_go()
        own = machine.value
        known: dict[str, float] = {}
        for batch in batches:
            out = np.empty(len(batch))
            for start in range(0, len(batch), 64):
                part = [units(t) if t else () for t in batch.iloc[start : start + 64]]
                if len(known) > most:
                    known.clear()
                new = list({u for p in part for u in p if u not in known})
                for s in range(0, len(new), 4000):
                    known.update(zip(new[s : s + 4000], own.words(new[s : s + 4000]).tolist(), strict=True))
                rows = [Machine.pooled(np.array([known[u] for u in p])) for p in part]
                out[start : start + 64] = own.probability(np.array(rows))
            yield pd.Series(out)

    return score


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with a column ``score``, from the text alone.

    Null and empty texts get the score of no words. Rows are independent: repeated rows repeat their score;
    an empty table gives none. A column ``score`` that is already there is replaced; others stay.
    """
    C.text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.withColumn("score", scorer(shared)(F.col("text").cast("string")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; the machine is fitted on the sample of ``train``."""
    docs = C.table(spark, sf_dir, "documents")
    out = toxicity(docs.select("doc_id", "text"), train(docs, C.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
