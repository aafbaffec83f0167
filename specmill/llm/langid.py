"""Language identification with a small byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; the largest response of each filter goes
into a softmax over the languages seen in training. The network is trained in numpy on
a bounded sample of labelled rows and applied inside tasks, where a convolution becomes a few table lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.common import as_bytes, fold_of, slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class NetSettings:
    """``sample`` documents per language of at most ``sample_chars`` characters bound the training set."""

    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 12
    sample: int = 500
    sample_chars: int = 20_000
    windows_per_text: int = 4
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


def window_matrix(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as uint8 rows, zero-padded, and how many each text has (one at least)."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    rows = np.zeros(int(counts.sum()) * size, np.uint8)
    at = 0
    for text, n in zip(texts, counts):
        rows[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * size
    return rows.reshape(-1, size), counts


class ByteNet:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], settings: NetSettings):
        self.languages, self.settings = languages, settings
        rng = np.random.default_rng(settings.seed)
        d, f = settings.embedding, settings.filters
        self.embed = rng.normal(0, 0.5, (256, d)).astype(np.float32)
        self.embed[0] = 0
        self.conv = [rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)).astype(np.float32) for w in settings.widths]
        self.out = rng.normal(0, 0.1, (f * len(settings.widths), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values, places = [], []
        for kernel in self.conv:
            w = len(kernel)
            # One table per filter position: what each byte adds to the responses.
            tables = np.einsum("bd,wdf->wbf", self.embed, kernel)
            span = windows.shape[1] - w + 1
            answer = tables[0][windows[:, :span]]
            for k in range(1, w):
                answer += tables[k][windows[:, k : k + span]]
            best = answer.argmax(axis=1)
            values.append(np.take_along_axis(answer, best[:, None, :], axis=1)[:, 0])
            places.append(best)
        return np.concatenate(values, axis=1), places

    def probabilities(self, windows: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Softmax rows for uint8 ``windows``. Pairs of bytes are looked up at once."""
        tables = []
        for kernel in self.conv:
            single = np.einsum("bd,wdf->wbf", self.embed, kernel)
            pairs = [
                (k, (single[k][None, :, :] + single[k + 1][:, None, :]).reshape(65536, -1))
                for k in range(0, len(kernel) - 1, 2)
            ]
            tables.append((len(kernel), pairs, [(len(kernel) - 1, single[-1])] if len(kernel) % 2 else []))
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), chunk):
            part = windows[at : at + chunk]
            # pair[i] = byte[i] + 256 * byte[i + 1]
            pair = part[:, :-1].astype(np.int32) | (part[:, 1:].astype(np.int32) << 8)
            pooled = []
            for width, pairs, singles in tables:
                span = part.shape[1] - width + 1
                answer = None
                for k, table in pairs:
                    term = np.take(table, pair[:, k : k + span], axis=0)
                    answer = term if answer is None else answer.__iadd__(term)
                for k, table in singles:
                    term = np.take(table, part[:, k : k + span], axis=0)
                    answer = term if answer is None else answer.__iadd__(term)
                pooled.append(answer.max(axis=1))
            out[at : at + chunk] = _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.bias)
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """Adam on cross-entropy; the gradient reaches the winning positions only."""
        rng = np.random.default_rng(self.settings.seed + 1)
        weights = [self.embed, *self.conv, self.out, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(self.settings.epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), self.settings.batch):
                chosen = order[at : at + self.settings.batch]
                step += 1
                for i, slope in enumerate(self._slopes(windows[chosen], labels[chosen])):
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope * slope
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    weights[i] -= self.settings.rate * move
        return self

    def _slopes(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        pooled, places = self._pooled(windows)
        active = np.maximum(pooled, 0)
        error = _softmax(active @ self.out + self.bias)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.out.T) * (pooled > 0)
        slope_embed, slopes, f = np.zeros_like(self.embed), [], self.settings.filters
        rows = np.arange(len(windows))[:, None]
        for i, kernel in enumerate(self.conv):
            own = back[:, i * f : (i + 1) * f]
            slope = np.empty_like(kernel)
            for k in range(len(kernel)):
                byte = windows[rows, places[i] + k]
                slope[k] = np.einsum("nfd,nf->df", self.embed[byte], own)
                np.add.at(slope_embed, byte, own[:, :, None] * kernel[k].T[None])
            slopes.append(slope)
        slope_embed[0] = 0
        return [slope_embed, *slopes, active.T @ error, error.sum(axis=0)]


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def trained_net(
    labelled: DataFrame, key: str, text: str, lang: str, settings: NetSettings = NetSettings()
) -> ByteNet | None:
    """A network from a bounded sample of ``labelled``; None where no row has a language and a letter.

    About ``settings.sample`` documents per language are taken by a hash of the key, of those with at most
    ``settings.sample_chars`` characters, and a few windows of each, some of them shortened.
    """
    rows = labelled.where(
        F.col(lang).isNotNull() & (F.length(text) <= settings.sample_chars) & F.col(text).rlike(r"\p{L}")
    )
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    keep = F.create_map(
        *[
            F.lit(v)
            for name in languages
            for v in (name, int(min(1.0, settings.sample / counts[name]) * (1 << 30)))
        ]
    )
    place = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 30))
    taken = rows.where(place < keep[F.col(lang)]).select(key, lang, text).collect()
    taken.sort(key=lambda r: (str(r[key]), r[text]))
    rng, size = np.random.default_rng(settings.seed), settings.window
    windows, labels = [], []
    for row in taken:
        data = row[text].encode()
        for _ in range(settings.windows_per_text):
            length = size if rng.random() < 0.7 else int(rng.integers(4, size))
            start = int(rng.integers(0, max(1, len(data) - length + 1)))
            windows.append(data[start : start + length].ljust(size, b"\0"))
            labels.append(languages.index(row[lang]))
    matrix = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, size)
    return ByteNet(languages, settings).train(matrix, np.array(labels))


def predicted_languages(
    docs: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text", carried: tuple[str, ...] = ()
) -> DataFrame:
    """(``carried``, lang_pred, score) for every row, from every window of its whole text.

    ``score`` is the mean over the windows of the predicted language's probability, weighted by their
    bytes. ``und`` with score 0 if the text is null or has no letter, or if there is no network. Empty
    tables give no rows; repeated rows repeated results. ``carried`` columns are handed on.
    """
    kept = list(carried or (key,))
    rows = docs.select(*kept, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_judged"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def predict(batches):
        for whole in batches:
            for batch in slices(whole, "_judged"):
                texts = as_bytes(batch.column("_judged"))
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if t is not None and net is not None]
                if known:
                    given = [texts[i] for i in known]
                    windows, counts = window_matrix(given, net.settings.window)
                    weight = (windows != 0).sum(axis=1).astype(np.float64) + 1e-9
                    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                    total = np.add.reduceat(net.probabilities(windows) * weight[:, None], starts, axis=0)
                    mean = total / np.add.reduceat(weight, starts)[:, None]
                    for i, row in zip(known, mean):
                        names[i], scores[i] = net.languages[int(row.argmax())], float(min(1.0, row.max()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*kept, "lang_pred", "score"],
                )

    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def identified(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 4,
    held: int = 2,
    settings: NetSettings = NetSettings(),
) -> DataFrame:
    """(key, held_out, lang_pred, score): trained on all folds but ``held``, applied to every row.

    Rows with a null key are held out. Labels and keys never enter a prediction.
    """
    held_out = F.coalesce(fold_of(F.col(key), folds) == held, F.lit(True))
    net = trained_net(docs.where(~held_out), key, text, lang, settings)
    found = predicted_languages(docs, net, key, text)
    return found.select(key, held_out.alias("held_out"), "lang_pred", "score")
