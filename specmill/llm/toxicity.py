"""Toxicity by compression distance.

Two zstandard dictionaries share a base that is trained on windows of ordinary text. The toxic one is not trained: behind
the base it lists words that a log-odds test finds more often in toxic texts. A window, one word, that
compresses much better with the toxic dictionary is a toxic window. The least saving and what a count of toxic
windows means are calibrated on labelled rows that made no dictionary.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.common import as_bytes, fold_of, plain_words, share_of, slices


@dataclass(frozen=True)
class ToxicSettings:
    """``toxic`` and ``ordinary`` rows of at most ``chars`` characters bound the labelled sample."""

    toxic: int = 3000
    ordinary: int = 6000
    chars: int = 50_000
    window: int = 1
    base: int = 65_536
    least_texts: int = 5
    least_evidence: float = 3.5
    least_ratio: float = 8.0
    savings: tuple[int, ...] = (2, 3, 4, 5, 6)
    memo: int = 400_000


def windows_of(text: bytes | None, size: int) -> list[bytes]:
    """Consecutive windows of ``size`` words, the last one may be shorter."""
    words = plain_words(text)
    return words if size == 1 else [b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


class ToxicModel:
    """Two dictionaries and the calibration. Travels to tasks as plain bytes and numbers."""

    def __init__(self, ordinary: bytes, toxic: bytes, pad: bytes, settings: ToxicSettings):
        self.ordinary, self.toxic, self.pad, self.settings = ordinary, toxic, pad, settings
        self.saving, self.weights = settings.savings[0], np.zeros(3)

    def meter(self):
        """A function from windows to the bytes that the toxic dictionary saves; known windows are looked up."""

        def compressor(data: bytes):
            words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
            how = zstandard.ZstdCompressionParameters.from_level(
                6,
                source_size=64,
                dict_size=len(data),
                strategy=zstandard.STRATEGY_BTOPT,
                min_match=3,
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            words.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress

        plain, hostile, memo, most = compressor(self.ordinary), compressor(self.toxic), {}, self.settings.memo

        def savings(windows: list[bytes]) -> np.ndarray:
            out = []
            for window in windows:
                value = memo.get(window)
                if value is None:
                    if len(memo) >= most:
                        memo.clear()
                    # The compressor finds no match in a block's last bytes: usual words follow the window.
                    padded = b" " + window + self.pad
                    value = memo[window] = len(plain(padded)) - len(hostile(padded))
                out.append(value)
            return np.array(out)

        return savings

    def features(self, savings: np.ndarray, least: float) -> tuple[float, float, float]:
        return 1.0, math.log1p(float((savings >= least).sum())), math.log1p(len(savings))

    def score(self, savings: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.features(savings, self.saving), self.weights))))


def _distinct(texts: list[bytes], size: int) -> list[Counter]:
    """Window counts of the texts without near copies: those that share a least hash of four-word runs are left out.

    Copies would pass for evidence that a window is toxic.
    """
    seen, out = set(), []
    for text in texts:
        words = plain_words(text)
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        keys = {(seed, min(zlib.crc32(r, seed) for r in runs)) for seed in (1, 77, 999)}
        if not keys & seen:
            out.append(Counter(windows_of(text, size)))
        seen |= keys
    return out


def trained_model(toxic: list[bytes], ordinary: list[bytes], settings: ToxicSettings = ToxicSettings()) -> ToxicModel:
    """Dictionaries from the even rows of each class, calibration from the odd ones.

    A window of toxic text goes into the toxic dictionary if it marks toxic texts: it is in several of them, and its
    odds there are larger than in ordinary text by a clear factor and beyond chance.
    """
    hostile, plain = _distinct(toxic[::2], settings.window), _distinct(ordinary[::2], settings.window)
    with_hostile, with_plain = Counter(w for c in hostile for w in c), Counter(w for c in plain for w in c)
    samples = [b" " + b" ".join(c.elements()) + b" " for c in plain[:2000] if c]
    samples = [s[i : i + 64] for s in samples for i in range(0, len(s), 64)]
    model = ToxicModel(b"", b"", b"", settings)
    marks = []
    for window, a in with_hostile.items():
        b, n, m = with_plain[window], len(hostile), len(plain)
        ratio = (a + 0.5) / (n + 1) / ((b + 0.5) / (m + 1))
        odds = math.log((a + 0.5) / (n - a + 0.5)) - math.log((b + 0.5) / (m - b + 0.5))
        evidence = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= settings.least_texts and evidence >= settings.least_evidence and ratio >= settings.least_ratio:
            marks.append((a, window))
    if not marks or len(samples) < 100:
        return model
    base = zstandard.train_dictionary(settings.base, samples, k=32, d=6).as_bytes()
    common = [w for w, _ in with_plain.most_common(len(marks) + 4)]
    model.pad = b" " + b" ".join(common[:4]) + b" "
    behind = b"".join(b" " + window + b" " for _, window in sorted(marks)) * 2
    usual = (b"".join(b" " + window + b" " for window in common) * 4)[: len(behind)]
    model.ordinary, model.toxic = base + usual + model.pad, base + behind + model.pad
    measure = model.meter()
    sets = [(measure(windows_of(t, settings.window)), y) for y, texts in ((1, toxic), (0, ordinary)) for t in texts[1::2]]
    labels = np.array([y for _, y in sets], float)
    best = -np.inf
    for least in settings.savings:
        rows = np.array([model.features(s, least) for s, _ in sets])
        weights, fit = _logistic(rows, labels)
        if fit > best:
            best, model.saving, model.weights = fit, least, weights
    return model


def _logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, both classes weighing the same; weights and log likelihood."""
    weights, ridge = np.zeros(rows.shape[1]), 1e-2
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (balance * (labels - p)) - ridge * weights
        curve = (rows * (balance * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    p = np.clip(1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30))), 1e-6, 1 - 1e-6)
    return weights, float((balance * np.where(labels == 1, np.log(p), np.log(1 - p))).sum())


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, trains, settings: ToxicSettings
) -> tuple[list[bytes], list[bytes]]:
    """Texts of about ``settings.toxic`` toxic and ``settings.ordinary`` ordinary rows, by a hash of the key.

    A key labelled both ways is toxic. Only keys and sampled texts, both bounded by the settings, reach the driver.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    marked = marked.where(trains & F.col("_y").isin(0, 1))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    keys = {
        y: [r[key] for r in share_of(marked.where(F.col("_y") == y), F.col(key), most, counts.get(y, 0)).collect()]
        for y, most in ((1, settings.toxic), (0, settings.ordinary))
    }
    spark = docs.sparkSession
    chosen = spark.createDataFrame(
        [(k, y) for y, found in keys.items() for k in found], f"`{key}` {docs.schema[key].dataType.simpleString()}, _y int"
    )
    rows = docs.where(F.length(text) <= settings.chars).select(key, text).join(F.broadcast(chosen), key).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[key]).encode()), r[key], r[text]))
    return [r[text].encode() for r in rows if r["_y"] == 1], [r[text].encode() for r in rows if r["_y"] == 0]


def scored_texts(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_windows, n_toxic, score) for every row, from all windows of its whole text.

    A null or empty text has no windows and gets the score of a text without any; repeated rows get repeated
    results; an empty table gives no rows. Only the text enters a score.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def score(batches):
        measure = model.meter() if model.toxic else lambda windows: np.zeros(len(windows))
        for whole in batches:
            for batch in slices(whole, text):
                found = [measure(windows_of(t, model.settings.window)) for t in as_bytes(batch.column(text))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([int((s >= model.saving).sum()) for s in found], pa.int64()),
                        pa.array([model.score(s) for s in found], pa.float64()),
                    ],
                    names=[key, "n_windows", "n_toxic", "score"],
                )

    return rows.mapInArrow(score, f"`{key}` {kind}, n_windows bigint, n_toxic bigint, score double")


def toxic_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 3,
    held: int = 1,
    least: float = 0.7,
    settings: ToxicSettings = ToxicSettings(),
) -> DataFrame:
    """(key, held_out, score, predicted, n_windows, n_toxic) for every row of ``docs``.

    Labels are learnt from all folds of the key but ``held``; rows with a null key are held out. Without both
    kinds of labels every score is one half.
    """
    held_out = F.coalesce(fold_of(F.col(key), folds) == held, F.lit(True))
    toxic, ordinary = labelled_sample(docs, labels, key, text, label, ~held_out, settings)
    found = scored_texts(docs, trained_model(toxic, ordinary, settings), key, text)
    return found.select(
        key,
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"),
        "n_windows",
        "n_toxic",
    )
