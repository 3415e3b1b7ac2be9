"""Quality scores by Bradley-Terry ranking of document pairs.

Each document is a short vector of text statistics. Preference pairs (a good and a bad labelled
document) are fitted by logistic loss on the difference of their vectors; the ranking score of a
document is the weighted sum of its vector. The threshold is a quantile of the training scores,
and scores are mapped so that it comes to lie at 0.7.

The model is fitted on at most `max_labelled` labelled documents (the smallest by a hash of their
id), whatever the input's size; scoring is a narrow pass over all texts, whole.

Edge cases: null texts count as empty; an empty text has a score of its own from its (zero)
statistics. Labels of null quality or without a document teach nothing. With labels of one kind
only, or none, every document scores 0.5. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_rows, utf8

MAX_LABELLED = 20_000
CUT = 0.7
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL = b"#$%&*+/<=>@\\^_`{|}~!"
_SYMBOLS = re.compile(rb"[" + re.escape(_SYMBOL) + rb"]{2}(?:\s|$)")
NAMES = ("log_words", "symbols", "symbol_words", "loud", "upper", "upper_words", "pipes", "repeats", "distinct", "same_lines", "digits", "no_stops", "dashes", "word_length", "stop_rate", "worst_symbols", "worst_upper", "worst_repeats", "worst_pipes", "short_lines", "top_word")


def _marks(text: bytes, words: list[bytes]) -> np.ndarray:
    """For every word: ends in two or more symbols, is wholly upper-case, is the one before again, is a bar."""
    n = len(words)
    marks = np.zeros((4, n))
    marks[0] = np.fromiter((len(w) > 2 and w[-1] in _SYMBOL and w[-2] in _SYMBOL for w in words), bool, n) if _SYMBOLS.search(text) else 0
    marks[1] = np.fromiter(map(bytes.isupper, words), bool, n)
    marks[2, 1:] = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, n - 1)
    marks[3] = np.fromiter(map(b"|".__eq__, words), bool, n) if b"|" in text else 0
    return marks


def statistics(text: bytes, part: int = 40) -> list[float]:
    """Shares between 0 and 1 (but for log_words, word_length): of the whole text, and of its worst stretch of `part` words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    gone = lambda chars: (size - len(text.translate(None, chars))) / size
    marks = _marks(text, words)
    starts = np.arange(0, max(1, n - part // 2), part)
    lengths = np.diff(np.append(starts, n))
    worst = (np.add.reduceat(marks, starts, axis=1) / lengths).max(axis=1)
    loud, upper, again, bars = marks.mean(axis=1)
    counts = Counter(text.lower().split())
    short = np.count_nonzero(np.fromiter(map(len, words), np.int64, n) <= 4) / n
    return [
        np.log1p(n), gone(_SYMBOL), loud, gone(b"!"), gone(_UPPER), upper, bars, again, len(counts) / n,
        1 - len(set(lines)) / max(1, len(lines)), gone(_DIGIT), float(short < 0.1), gone(b"-_"), min(20.0, size / n), short,
        *worst.tolist(), sum(1 for x in lines if len(x) < 20) / max(1, len(lines)), max(counts.values()) / n,
    ]


def _bend(x: np.ndarray) -> np.ndarray:
    """Shares twice, as they are and bent so that small shares tell: a linear score can then use both."""
    return np.hstack([x, np.log1p(50 * np.abs(x))])


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((_bend(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rising with the ranking score; the threshold maps to CUT."""
        z = (self.raw(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, steps: int = 400, penalty: float = 1e-3, seed: int = 11) -> Ranking | None:
    """Weights of the logistic loss over (better - worse), by Adam on fixed pairs. None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    bent = _bend(x)
    mean, scale = bent.mean(axis=0), bent.std(axis=0) + 1e-6
    z = (bent - mean) / scale
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = (np.zeros(z.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        part = difference[rng.integers(0, pairs, 4096)]
        p = 1 / (1 + np.exp(np.clip(part @ w, -30, 30)))
        grad = -(p[:, None] * part).mean(axis=0) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    # The quantile that errs least on the labels; in between equal ones, the middle.
    levels = np.linspace(0, 1, 401)
    cuts = np.quantile(raw, levels)
    wrong = np.array([((raw >= c) != (y == 1)).sum() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    threshold = float((cuts[best[0]] + cuts[best[-1]]) / 2)
    return Ranking(mean, scale, w, threshold, float(raw.std() / 3 + 1e-6))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranking | None:
    """Fit on labelled documents whose crc32 of the id, mod 4, is not 2; at most max_labelled of them."""
    taught = labels.where("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    chosen = taught.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = _measured(rows, "doc_id", "quality").select("doc_id", "quality", "x").orderBy("doc_id").limit(2 * max_labelled).collect()
    if not found:
        return None
    return fit(np.array([r.x for r in found]), np.array([r.quality for r in found]))


def _measured(docs: DataFrame, *kept: str) -> DataFrame:
    def rows(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*kept, "x"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_rows(docs.select(*kept, utf8("text").alias("__utf8")), rows, f"{schema}, x array<double>")


def scored(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """docs, all columns, with score (double) added."""
    from pyspark.sql import types as T

    fields = docs.schema

    def rows(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(NAMES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*fields.names, "score"])

    return map_rows(docs.withColumn("__utf8", utf8("text")), rows, T.StructType([*fields.fields, T.StructField("score", T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, max_labelled))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
