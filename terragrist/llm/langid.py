"""Language identification by a byte convolutional network written in numpy.

Filters of several widths over byte windows of fixed length, max pooling over a window, one softmax layer. A text is
classified by the mean of its windows' logits, all of them, weighted by the bytes they hold.

A filter of width w is a sum of w table rows, so inference looks up tables of byte pairs: one row for bytes p, p+1 and one
for p+2, p+3 give all widths up to four at position p.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist.llm.words import LOWER, utf8_views

WIDTHS = (2, 3, 4)
#: Bytes of a window.
WINDOW = 512


@dataclass(frozen=True)
class ByteCnn:
    """filters[k]: (width, 256, n) of WIDTHS[k]; bias: (3n,); out: (3n, languages); out_bias: (languages,)."""

    languages: tuple[str, ...]
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(view: np.ndarray) -> np.ndarray:
    """(windows, WINDOW + 3) bytes: each window with the three bytes that follow; the end is padded with zeros."""
    n = max(1, -(-len(view) // WINDOW))
    padded = np.zeros(n * WINDOW + 3, dtype=np.uint8)
    padded[: len(view)] = LOWER[view]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 3)[::WINDOW]


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], n: int = 16, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteCnn:
    """Adam on the cross-entropy; windows: (m, WINDOW + 3) bytes, labels: (m,) places in `languages`."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (w, 256, n)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(len(WIDTHS) * n, np.float32), rng.normal(0, 0.1, (len(WIDTHS) * n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y = windows[at], labels[at]
            rows = np.arange(len(at))
            pooled, arg = [], []
            for k, w in enumerate(WIDTHS):
                act = params[k][0][x[:, :WINDOW]]
                for j in range(1, w):
                    act += params[k][j][x[:, j : WINDOW + j]]
                arg.append(act.argmax(axis=1))
                pooled.append(np.take_along_axis(act, arg[-1][:, None, :], axis=1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + params[3]
            h = np.maximum(pre, 0)
            logits = h @ params[4] + params[5]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, y] -= 1
            p /= len(at)
            dh = (p @ params[4].T) * (pre > 0)
            grads = [np.zeros_like(q) for q in params[:3]] + [dh.sum(axis=0), h.T @ p, p.sum(axis=0)]
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * n : (k + 1) * n]
                f = np.broadcast_to(np.arange(n), d.shape)
                for j in range(w):
                    np.add.at(grads[k][j], (x[rows[:, None], arg[k] + j], f), d)
            step += 1
            for q, g, a, b in zip(params, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(languages, tuple(params[:3]), *params[3:])


class Predictor:
    """The pair tables of a trained network; made once a task."""

    def __init__(self, model: ByteCnn) -> None:
        self.model = model
        f2, f3, f4 = model.filters
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.n = f2.shape[2]
        self.head = np.ascontiguousarray(np.concatenate([pair(f2[0], f2[1]), pair(f3[0], f3[1]), pair(f4[0], f4[1])], axis=1))
        self.tail = np.ascontiguousarray(np.concatenate([pair(f3[2], np.zeros_like(f3[2])), pair(f4[2], f4[3])], axis=1))

    def logits(self, windows: np.ndarray, block: int = 16) -> np.ndarray:
        out = np.empty((len(windows), self.head.shape[1]), dtype=np.float32)
        for at in range(0, len(windows), block):
            x = windows[at : at + block].astype(np.intp)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            act = self.head[pairs[:, :WINDOW]]
            act[:, :, self.n :] += self.tail[pairs[:, 2 : WINDOW + 2]]
            act.max(axis=1, out=out[at : at + block])
        return np.maximum(out + self.model.bias, 0) @ self.model.out + self.model.out_bias

    def predict(self, view: np.ndarray) -> tuple[str, float]:
        windows = windows_of(view)
        held = np.full(len(windows), WINDOW)
        held[-1] = len(view) - WINDOW * (len(windows) - 1)
        z = held @ self.logits(windows).astype(np.float64) / held.sum()
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.model.languages[best], float(p[best] / p.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = 300, windows_per_text: int = 4, max_languages: int = 200, epochs: int = 12) -> ByteCnn:
    """Trains on a bounded sample: about the `per_language` texts of each language (the `max_languages` most frequent ones) that a hash of
    the id chooses, up to `windows_per_text` windows of each, spread over its length. So languages * per_language * windows_per_text windows of 512 bytes reach the driver,
    with 4 languages 2.5 MB, with the most 124 MB. Rows with null language, id or text, or without text, are not learned from.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).filter("doc_id is not null and lang is not null")
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages)
    # thin each language out by hash first, so that no task ranks all rows of a frequent one
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thin = known.join(F.broadcast(rows), "lang").filter(share * F.col("rows") < 2 * per_language)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = thin.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_language).select("doc_id").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces, keys = [], [], []
            for doc, lang, view in zip(batch.column(0), batch.column(1), utf8_views(batch.column(2))):
                if view is None or not len(view):
                    continue
                every = windows_of(view)
                for i in np.unique(np.linspace(0, len(every) - 1, min(windows_per_text, len(every))).astype(int)):
                    langs.append(lang.as_py())
                    keys.append(doc.as_py())
                    pieces.append(every[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["doc_id", "lang", "piece"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter("lang is not null").join(F.broadcast(ids), "doc_id", "left_semi").select(F.col("doc_id").cast("string"), "lang", "text")
    rows = texts.mapInArrow(cut, "doc_id string, lang string, piece binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["piece"])))
    languages = tuple(sorted({r["lang"] for r in rows}))
    if not rows:
        return ByteCnn((), (), np.empty(0), np.empty(0), np.empty(0))
    windows = np.frombuffer(b"".join(bytes(r["piece"]) for r in rows), dtype=np.uint8).reshape(len(rows), WINDOW + 3)
    place = {x: i for i, x in enumerate(languages)}
    return train(windows, np.array([place[r["lang"]] for r in rows]), languages, epochs=epochs)


def has_letter(view: np.ndarray) -> bool:
    """True if any character of the UTF-8 text is a letter."""
    low = LOWER[view]
    if ((low >= 97) & (low <= 122)).any():
        return True
    return any(c.isalpha() for c in view.tobytes().decode("utf-8", "replace"))


def identify(docs: DataFrame, model: ByteCnn, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of `docs`, with the predicted language and its probability.

    Columns of `docs` with the names of the two are replaced. `und` with score 0 for null texts, texts without a letter, and a model that learned no language. Repeated rows are each answered.
    """
    docs = docs.drop(*{lang_out, score_out} - {text_col})
    place = docs.columns.index(text_col)
    kept = [f for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model) if model.languages else None
        for batch in batches:
            found = [predictor.predict(v) if predictor and v is not None and has_letter(v) else ("und", 0.0) for v in utf8_views(batch.column(place))]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, lang_out, score_out])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept]).add(lang_out, "string").add(score_out, "double")
    return docs.mapInArrow(run, schema)
