"""Quality scores from a factorisation machine.

Features of a text: hashed lower-case words and hashed word shapes (letters
and digits folded, so that attached symbols stand out), each with the root of
its count and normalised together, and structure statistics and metadata
(length, lines) on a common scale.  The score is the logistic function of bias
+ linear part + all pairwise interactions through low-rank factors, summed in
linear time as half of (square of sums - sum of squares).

The machine is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of
the id; texts are turned into features where they lie and only those reach the
driver.  Scoring covers every whole text.

Null text is empty; empty texts get a score from bias and statistics.  Labels
that are null do not train; without any label the score is 0.5.  Repeated rows
are scored alike; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ChunkTable, map_texts, per_worker

#: Places for words and shapes, rank of the interactions, labelled rows for the fit.
PLACES, RANK, SAMPLE = 1 << 14, 8, 6000
_HALF = PLACES // 2
ROUNDS, RATE, DECAY, SEED = 8, 0.08, 1e-5, 11
STATISTICS = ("letters", "upper", "digits", "spaces", "symbols", "word_length", "distinct_words", "distinct_lines", "symbol_words", "long_words", "log_words", "log_lines", "log_line_length")
_FOLD = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(word: str) -> str:
    out = "A" if word.isupper() and len(word) > 1 else ""
    for pattern, by in _FOLD:
        word = pattern.sub(by, word)
    return out + word


def _places(words: list[str]) -> list[int]:
    """Word place, shape place, and whether letters and digits are missing, in
    one number."""
    return [zlib.crc32(w.lower().encode()) % _HALF | (zlib.crc32(b"s" + shape(w).encode()) % _HALF) << 16 | (not any(map(str.isalnum, w))) << 32 for w in words]


def _table() -> ChunkTable:
    return per_worker("quality", lambda: ChunkTable(str.split, _places))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: places, their values, statistics."""
    out = []
    for text, found in zip(texts, _table().lookup(texts)):
        words = len(found)
        packed = np.array(found, dtype=np.int64)
        word = packed & 0xFFFF
        places, n = np.unique(np.concatenate([word, _HALF + (packed >> 16 & 0xFFFF)]), return_counts=True)
        weight = np.sqrt(n)
        total = np.linalg.norm(weight)
        out.append((places, weight / total if total else weight, _statistics(text, word, packed >> 32)))
    return out


def _statistics(text: str, word: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = max(1, len(points))
    kind = _KIND[np.minimum(points, len(_KIND) - 1)]
    share = np.bincount(kind, minlength=5)[:5] / n  # other, lower, upper, digit, space
    lines = [x for x in text.split("\n") if x.strip()]
    words = len(word)
    per_word = max(1, words)
    return np.array([share[1] + share[2], share[2] / max(share[1] + share[2], 1e-9), share[3], share[4], share[0], (len(points) - share[4] * n) / per_word / 10, len(np.unique(word)) / per_word, len(set(lines)) / max(1, len(lines)), symbols.sum() / per_word, float(words < 5), np.log1p(words) / 10, np.log1p(len(lines)) / 5, np.log1p(n / max(1, len(lines))) / 10])


_KIND = np.array([4 if chr(i).isspace() else 3 if chr(i).isdigit() else 2 if chr(i).isupper() else 1 if chr(i).isalpha() else 0 for i in range(0x3000)], dtype=np.uint8)


class Machine:
    """bias + w.x + sum over pairs of <v_i, v_j> x_i x_j."""

    def __init__(self, size: int, rank: int = RANK):
        pick = np.random.default_rng(SEED)
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = pick.normal(0, 0.05, (size, rank))

    def raw(self, places: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[places] * x[:, None]
        sums = v.sum(axis=0)
        return self.bias + self.linear[places] @ x + 0.5 * float(sums @ sums - (v * v).sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, rate: float = RATE) -> Machine:
        """Adagrad on logistic loss, in an order fixed by the seed."""
        pick = np.random.default_rng(SEED)
        seen_linear, seen_factors, seen_bias = np.full(len(self.linear), 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(rounds):
            for i in pick.permutation(len(rows)):
                places, x, label = rows[i]
                own = self.factors[places]
                sums = (own * x[:, None]).sum(axis=0)
                score = self.bias + self.linear[places] @ x + 0.5 * float(sums @ sums - ((own * x[:, None]) ** 2).sum())
                slope = _logistic(score) - label
                seen_bias += slope * slope
                self.bias -= rate * slope / np.sqrt(seen_bias)
                step = slope * x + DECAY * self.linear[places]
                seen_linear[places] += step * step
                self.linear[places] -= rate * step / np.sqrt(seen_linear[places])
                step = slope * (x[:, None] * sums - own * (x * x)[:, None]) + DECAY * own
                seen_factors[places] += step * step
                self.factors[places] -= rate * step / np.sqrt(seen_factors[places])
        return self


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _input(feature: tuple, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of words, shapes and scaled statistics together."""
    places, x, statistics = feature
    scaled = np.clip((statistics - mean) / spread, -4, 4) / 2
    return np.concatenate([places, PLACES + np.arange(len(STATISTICS))]), np.concatenate([x, scaled])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> dict:
    """The machine and the statistics' scale, from labelled documents."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    # at most ``sample`` rows, whatever the table's size: safe to broadcast
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # one text of each document, so that an id with many rows counts once
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id")

    def described(part, texts):
        found = features(texts)
        as_list = lambda values, kind: pa.array([list(v) for v in values], pa.list_(kind))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), as_list([f[0].tolist() for f in found], pa.int32()), as_list([f[1].tolist() for f in found], pa.float32()), as_list([f[2].tolist() for f in found], pa.float64())], ["doc_id", "label", "places", "x", "statistics"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    table = map_texts(rows.select("doc_id", "label", "text"), "text", described, f"doc_id {kind}, label int, places array<int>, x array<float>, statistics array<double>")
    found = sorted(table.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.label, r.places))[:sample]
    if not found:
        return {"machine": None}
    statistics = np.array([r.statistics for r in found])
    mean, spread = statistics.mean(axis=0), statistics.std(axis=0) + 1e-3
    inputs = [(*_input((np.array(r.places, dtype=np.int64), np.array(r.x, dtype=np.float64), np.array(r.statistics)), mean, spread), r.label) for r in found]
    return {"machine": Machine(PLACES + len(STATISTICS)).fit(inputs), "mean": mean, "spread": spread}


def score(df: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``keep`` columns, ``score`` (0 to 1), ``predicted``."""
    machine = model["machine"]

    def rows(part, texts):
        scores = [0.5] * len(texts) if machine is None else [_logistic(machine.raw(*_input(f, model["mean"], model["spread"]))) for f in features(texts)]
        own = [part.column(i) for i in range(1 + len(keep))]
        return pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [f"c{i}" for i in range(len(own) + 2)])

    own_text = text_column in keep
    chosen = df.select(id_column, *keep, *([] if own_text else [F.col(text_column).alias("__text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:1 + len(keep)])
    return map_texts(chosen, text_column if own_text else "__text", rows, f"{fields}, score double, predicted int")
