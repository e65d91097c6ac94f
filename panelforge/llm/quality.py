"""Quality scores from compression: how much better does a text compress with a dictionary of good or of bad texts?

Two zstandard dictionaries are trained on pieces of a bounded sample of labelled texts. A text is compressed in short
chunks, so that a dictionary helps with all of it and not with its beginning only; the difference of the summed sizes under
either dictionary, as a share of the text's own size, is the signal. A logistic curve of this difference alone, fitted on
the other half of the sample, makes it a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

#: Bounds of the sample that the dictionaries and the curve are fitted on: rows of each class; characters of a piece of
#: text, and of all pieces that the dictionaries are trained on together. Pieces are whole texts cut up; where they are more
#: than that, they are drawn by a hash, each with the same chance.
SAMPLE_ROWS = 2500
PIECE_CHARS, DICTIONARY_CHARS = 512, 64_000_000
#: Pieces of a short look at a text.
PIECES = 8
DICTIONARY_BYTES = 16 << 10
CHUNK_BYTES = 256
LEVEL = 3


@dataclass
class CompressionModel:
    """Dictionaries (empty: no training text of that class), and slope and intercept of the curve (none: not fitted)."""

    good: bytes
    bad: bytes
    curve: np.ndarray
    prior: float

    def compressors(self) -> list:
        dictionaries = [zstandard.ZstdCompressionDict(d) if d else None for d in (self.good, self.bad)]
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if d else zstandard.ZstdCompressor(level=LEVEL) for d in dictionaries]

    def differences(self, texts: list[str]) -> np.ndarray:
        """The normalised size difference of each text that is not empty; positive where the good dictionary helps more."""
        pair, sizes = self.compressors(), []
        for t in map(str.encode, texts):
            chunks = [t[i : i + CHUNK_BYTES] for i in range(0, len(t), CHUNK_BYTES)]
            sizes.append([len(t), *(sum(len(c.compress(x)) for x in chunks) for c in pair)])
        n, good, bad = np.array(sizes, float).reshape(-1, 3).T
        return (bad - good) / n

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        known = [i for i, t in enumerate(texts) if t]
        if known and len(self.curve):
            out[known] = logistic(self.curve[0] * self.differences([texts[i] for i in known]) + self.curve[1])
        return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(d: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for a weighted, lightly penalised logistic curve; returns slope and intercept, the slope not negative."""
    mean, scale = d.mean(), max(d.std(), 1e-9)
    x, w = np.column_stack([(d - mean) / scale, np.ones(len(d))]), np.zeros(2)
    for _ in range(rounds):
        p = logistic(x @ w)
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, w[0] / scale)
    return np.array([slope, w[1] - slope * mean])


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or as much raw text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def pieces_of(text: Column, most: int | None = PIECES) -> Column:
    """Up to ``most`` stretches of PIECE_CHARS characters, evenly spread over the text; all of it where it is short, or
    where most is None."""
    if most is None:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    n = F.ceil(F.length(text) / PIECE_CHARS)
    taken = F.least(n, F.lit(most)).cast("int")
    at = lambda k: (F.floor(k * n / taken) * PIECE_CHARS + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), taken - 1), lambda k: F.substring(text, at(k), F.lit(PIECE_CHARS)))


def differences_of(text: Column, model: CompressionModel, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.differences(texts.tolist()), dtype=float)

    return run(text)


def train(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Fit on at most about ``rows`` labelled texts of each class, of any length (documented bounds).

    usable: a condition on labels' id. Labels other than 0 and 1, labels of missing or empty texts, and ids with two
    different labels teach nothing. With one class only, every score is that class's share.
    """
    marks = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("id", "y")
    found = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(found.values())
    prior = found.get(1, 0) / total if total else 0.5
    nothing = CompressionModel(b"", b"", np.zeros(0), prior)
    if len(found) < 2:
        return nothing
    share = F.when(F.col("y") == 1, min(1.0, rows / found[1])).otherwise(min(1.0, rows / found[0]))
    drawn = unit_hash(F.col("id"), seed=8) / share
    # About 2 * rows ids: small enough to broadcast. One half of them builds the dictionaries, the other fits the curve.
    chosen = marks.where(drawn < 1).select("id", "y", (unit_hash(F.col("id"), seed=80) < 0.5).alias("builds"))
    text = F.col(text_col).cast("string")
    sample = docs.where(F.length(text) > 0).select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    building = sample.where("builds")
    chars = building.agg(F.sum(F.length("text"))).first()[0] or 0
    pieces = building.select("id", "y", F.posexplode(pieces_of(F.col("text"), most=None)).alias("pos", "piece"))
    if chars > DICTIONARY_CHARS:
        pieces = pieces.where(unit_hash(F.col("id"), F.col("pos"), seed=81) < DICTIONARY_CHARS / chars)
    pieces = pieces.select("id", "y", "piece").distinct().toPandas().sort_values(["id", "piece"])
    if pieces["y"].nunique() < 2:
        return nothing
    good, bad = ([t.encode() for t in pieces["piece"][pieces["y"] == k]] for k in (1, 0))
    model = CompressionModel(dictionary(good), dictionary(bad), np.zeros(0), prior)
    scored = sample.where("not builds").select("y", differences_of(F.col("text"), model, docs.sparkSession).alias("d")).groupBy("y", "d").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["y", "d"])
    d, y, n = (scored[c].to_numpy(float) for c in ("d", "y", "n"))
    if len(set(y)) < 2:
        return nothing
    # The sample holds the classes in other shares than the labels do; weights undo that.
    own = (n * y).sum() / n.sum()
    model.curve = fit_curve(d, y, n * np.where(y == 1, prior / own, (1 - prior) / (1 - own)))
    return model


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """All columns of docs with ``quality_score`` (0 to 1) and ``quality_pred`` (1 where the score reaches the threshold).

    Null and empty texts get the share of good labels. Repeated rows and null ids stay; existing columns of these two
    names are replaced. Whole texts are compressed, of any length, a chunk at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.withColumn("quality_score", rate(F.col(text_col).cast("string"))).withColumn("quality_pred", (F.col("quality_score") >= threshold).cast("int"))
