"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams of one to three letters
(lower-cased, everything but letters is a gap), weighted by root of tf times
idf and normalised.  Document frequencies are counted over all training rows.
Each language has several centroids, clustered by cosine from a bounded sample
of its training rows (``SAMPLE`` rows per language, chosen by a hash of the
id).  A text takes the language of the centroid with the largest cosine; the
cosine is the score.  A centroid rejects texts whose cosine is below a third
of the least among its own members, and texts without letters are rejected as
``und``.

Null text, and text without letters, is ``und`` with score 0.  Rows of null
language or id are not trained on; without any training row everything is
``und``.  Texts of any length are read whole; repeated rows are treated alike;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.common import longs, map_texts, text_batches

SIZE = 8192
ORDERS = 3
#: Rows per language that centroids are clustered from, and centroids per language.
SAMPLE, CENTROIDS, ROUNDS = 500, 4, 8
UNDETERMINED = "und"


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams; None without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters(points)
    if not letter.any():
        return None
    code = np.where(letter, points, np.uint32(32))
    # gaps of one place only: a run of other characters counts once
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(SIZE, dtype=np.int64)
    rolled = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        rolled = (rolled[:len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1:] * np.uint32(0x9E3779B1))
        # the hash's high bits, after one more mixing with the order
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        total += np.bincount(mixed >> np.uint32(19), minlength=SIZE)
    return total


_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def _letters(points: np.ndarray) -> np.ndarray:
    low = _LETTER[np.minimum(points, len(_LETTER) - 1)]
    high = points >= len(_LETTER)
    if high.any():
        low = low & ~high
        low[high] = [chr(p).isalpha() for p in points[high].tolist()]
    return low


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.sqrt(count) * idf
    norm = np.linalg.norm(weighted)
    return weighted / norm if norm else weighted


def document_frequencies(df: DataFrame, text_column: str = "text") -> tuple[int, np.ndarray]:
    """Number of texts with letters, and of those with each hashed n-gram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, dtype=np.int64)  # the last: texts
        for batch in batches:
            for _, texts in text_batches(batch, text_column):
                for t in texts:
                    if (c := counts(t)) is not None:
                        total[:SIZE] += c > 0
                        total[SIZE] += 1
        yield pa.RecordBatch.from_arrays([longs(np.arange(SIZE + 1)), longs(total)], ["place", "n"])

    out = np.zeros(SIZE + 1, dtype=np.int64)
    for row in df.select(text_column).mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row.place] = row.n
    return int(out[SIZE]), out[:SIZE]


def clustered(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by cosine, and the least cosine of each one's members.
    They start at vectors spread evenly from the least to the most typical."""
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    typical = np.argsort(vectors @ unit(vectors.mean(axis=0)), kind="stable")
    k = min(k, len(vectors))
    centres = vectors[typical[((np.arange(k) + 0.5) * len(vectors) / k).astype(int)]]
    for _ in range(rounds):
        member = (vectors @ centres.T).argmax(axis=1)
        centres = np.array([unit(vectors[member == c].mean(axis=0)) if (member == c).any() else centres[c] for c in range(len(centres))])
    near = vectors @ centres.T
    member = near.argmax(axis=1)
    least = np.array([near[member == c, c].min() if (member == c).any() else 1.0 for c in range(len(centres))])
    return centres, least


def fit(df: DataFrame, label_column: str = "lang", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> dict:
    """Languages, centroids, rejection bounds and idf, from labelled rows."""
    rows = df.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(label_column).alias("lang"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    n, frequency = document_frequencies(rows)
    idf = 1 + np.log((1 + n) / (1 + frequency))
    # ids alone are ranked; at most ``sample`` of each language remain, safe to broadcast
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("lang", "doc_id")
    # one text of each, so that an id with many rows counts once
    chosen = rows.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        known = [c for t in group["text"] if (c := counts(t or "")) is not None]
        vectors = np.array([v for c in known if (v := vector(c, idf)).any()])
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        centres, least = clustered(vectors, CENTROIDS)
        return pd.DataFrame({"lang": key[0], "centre": [c.astype("<f4").tobytes() for c in centres], "least": least})

    found = sorted(map(tuple, chosen.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, least double").collect()))
    return {"idf": idf, "languages": [f[0] for f in found], "centres": np.array([np.frombuffer(f[1], "<f4") for f in found]).reshape(len(found), SIZE), "floor": np.array([f[2] / 3 for f in found])}


def predict(df: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``keep`` columns, ``lang_pred``, ``score``, ``rejected``."""
    idf, centres, floor = model["idf"], model["centres"].astype(np.float64), model["floor"]
    languages = model["languages"]

    def rows(part, texts):
        lang, score, out = [], [], []
        for t in texts:
            count = counts(t) if languages else None
            if count is None:
                lang.append(UNDETERMINED)
                score.append(0.0)
                out.append(True)
                continue
            near = centres @ vector(count, idf)
            best = int(near.argmax())
            lang.append(languages[best])
            score.append(float(min(1.0, max(0.0, near[best]))))
            out.append(bool(near[best] < floor[best]))
        own = [part.column(i) for i in range(1 + len(keep))]
        return pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [f"c{i}" for i in range(len(own) + 3)])

    own_text = text_column in keep
    chosen = df.select(id_column, *keep, *([] if own_text else [F.col(text_column).alias("__text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:1 + len(keep)])
    return map_texts(chosen, text_column if own_text else "__text", rows, f"{fields}, lang_pred string, score double, rejected boolean")


def remainder(column: str, by: int):
    """crc32 of the column as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
