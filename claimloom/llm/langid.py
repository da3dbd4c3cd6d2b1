"""Language identification by a byte convolutional network.

Filters of several widths slide over fixed-length byte windows; the maximum of
each filter passes a rectifier and a softmax layer. The network is trained in
numpy by Adam on a bounded sample of labelled texts. Every window of every text
is classified; a text's score is the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, broadcast_if_small, checkpointed, column, held_out, slices, spread, tidy, utf8

WIDTHS = (2, 3, 4)
WINDOW = 256
#: Windows overlap by the widest filter less one, so no run of bytes is split by a boundary alone.
STRIDE = WINDOW - max(WIDTHS) + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48  # digits are alike


@dataclass
class Network:
    filters: list[np.ndarray]  # for each width: (width, 256, filters), a convolution over one-hot bytes
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    names: list[str]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables over byte pairs (and a last single byte) whose rows add up to the filter outputs."""
        out = []
        for w in self.filters:
            own = []
            for k in range(0, len(w) - 1, 2):
                own.append((w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32))
            if len(w) % 2:
                own.append(w[-1].astype(np.float32))
            out.append(own)
        return out

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of each window (row of bytes) and language."""
        out = np.zeros((len(windows), len(self.names)))
        for a in range(0, len(windows), 128):
            own = np.ascontiguousarray(windows[a : a + 128].T)  # positions by windows
            pairs = (own[:-1].astype(np.int32) << 8) | own[1:]
            peaks = []
            for w, parts in zip(self.filters, tables, strict=True):
                n = len(own) - len(w) + 1
                total = None
                for k, part in enumerate(parts):
                    index = pairs[2 * k : 2 * k + n] if len(part) == 65536 else own[2 * k : 2 * k + n]
                    value = part.take(index, axis=0)
                    total = value if total is None else np.add(total, value, out=total)
                peaks.append(total.max(axis=0))
            hidden = np.maximum(np.concatenate(peaks, 1) + self.bias, 0)
            out[a : a + 128] = _softmax(hidden @ self.dense + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(text: np.ndarray) -> np.ndarray:
    """All fixed-length windows of one text's bytes, the last filled up by zeros."""
    text = _LOWER[text]
    n = max(1, -(-(len(text) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(text)] = text
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (STRIDE, 1)).copy()


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], filters: int = 8, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Softmax cross-entropy; only the position of each filter's maximum gets a gradient."""
    rng = np.random.default_rng(seed)
    c, total = len(names), filters * len(WIDTHS)
    net = Network([rng.normal(0, 0.1, (w, 256, filters)) for w in WIDTHS], np.zeros(total), rng.normal(0, 0.3, (total, c)), np.zeros(c), names)
    parts = [*net.filters, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            x, y = windows[own], labels[own]
            peaks, places = [], []
            for w in net.filters:
                n = WINDOW - len(w) + 1
                value = sum(w[k][x[:, k : k + n]] for k in range(len(w)))
                place = value.argmax(1)
                places.append(place)
                peaks.append(np.take_along_axis(value, place[:, None, :], 1)[:, 0])
            raw = np.concatenate(peaks, 1) + net.bias
            hidden = np.maximum(raw, 0)
            delta = _softmax(hidden @ net.dense + net.offset)
            delta[np.arange(len(y)), y] -= 1
            delta /= len(y)
            back = (delta @ net.dense.T) * (raw > 0)
            grads = []
            rows = np.arange(len(y))[:, None]
            for k, (w, place) in enumerate(zip(net.filters, places, strict=True)):
                g = np.zeros_like(w)
                own_back = back[:, k * filters : (k + 1) * filters]
                for j in range(len(w)):
                    np.add.at(g[j], (x[rows, place + j], np.arange(filters)[None, :]), own_back)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ delta, delta.sum(0)]
            step += 1
            pace = rate * (1 - epoch / epochs) + 1e-3
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _sample(batches: Batches) -> Batches:
    """Up to four windows of each text at places that its key picks."""
    for batch in batches:
        raw, offsets = utf8(batch.column(0))
        out, of = [], []
        for k, place in enumerate(batch.column(2).to_pylist()):
            found = cut_windows(raw[offsets[k] : offsets[k + 1]])
            for j in sorted({(place + j * 2654435761) % len(found) for j in range(4)}):
                out.append(found[j].tobytes())
                of.append(k)
        at = pa.array(of, pa.int64())
        yield pa.record_batch([pa.array(out, pa.binary()), batch.column(1).take(at), batch.column(2).take(at)], ["window", "lang", "place"])


def learn(docs: DataFrame, train_rows: int = 3_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> Network | None:
    """Trains on texts with a letter and a known language outside the held-out third.

    train_rows bounds the sample: that many texts at most, each language with
    about an equal share of them (all its texts if it has fewer), in a fixed
    pseudo-random order. None without such rows.
    """
    named = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    known = named.where(F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("text").rlike(r"\p{L}"))
    counts = checkpointed(known.groupBy("lang").agg(F.count("*").alias("n")))
    langs = counts.count()
    if not langs:
        return None
    # A text is drawn where its place in 0..1 lies below its language's cut; what is over train_rows goes at the same part of each cut.
    cut = F.least(F.lit(1.0), F.lit(max(1.0, train_rows / langs)) / F.col("n"))
    placed = known.withColumn("place", spread(F.col("id"), "language")).join(broadcast_if_small(counts), "lang")
    part = ((F.col("place").cast("double") / F.lit(2.0**64)) + 0.5) / cut
    drawn = placed.withColumn("part", part).where("part < 1").orderBy("part", "place", "lang").limit(train_rows)
    rows = drawn.select("text", "lang", (F.col("place") % 1_000_003 + 1_000_003).alias("place")).mapInArrow(tidy(_sample), "window binary, lang string, place long").toPandas()
    rows = rows.sort_values(["place", "lang", "window"], kind="stable")
    names = sorted(rows["lang"].unique())
    if not names:
        return None
    x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    return train(x, rows["lang"].map(names.index).to_numpy(), names, **settings)


def _apply(net: Network | None, batches: Batches) -> Batches:
    tables = net.tables() if net else None
    for batch in batches:
        raw, offsets = utf8(batch.column(2))
        lettered = np.asarray(batch.column(3).fill_null(False))
        best, score = ["und"] * len(batch), np.zeros(len(batch))
        if net:
            for a, b in slices(offsets, 1 << 20):
                rows = [k for k in range(a, b) if lettered[k]]
                for k, p in zip(rows, _means(net, tables, [raw[offsets[k] : offsets[k + 1]] for k in rows]), strict=True):
                    best[k], score[k] = net.names[int(p.argmax())], min(1.0, float(p.max()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(best), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])


def _means(net: Network, tables: list, texts: list[np.ndarray], most: int = 16 << 20) -> Iterator[np.ndarray]:
    """Mean probabilities of each text over all its windows, in bounded memory for long ones."""
    if not texts:
        return
    if sum(map(len, texts)) <= most:
        cut = [cut_windows(t) for t in texts]
        p = net.probabilities(np.concatenate(cut), tables)
        ends = np.cumsum([len(c) for c in cut])
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            yield p[a:b].mean(0)
        return
    for text in texts:
        total, n = np.zeros(len(net.names)), 0
        step = STRIDE * (most // WINDOW)
        for at in range(0, max(1, len(text) - (WINDOW - STRIDE)), step):
            p = net.probabilities(cut_windows(text[at : at + step + WINDOW - STRIDE]), tables)
            total, n = total + p.sum(0), n + len(p)
        yield total / n


def identify_languages(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Null texts and texts without a letter (empty ones too) are `und` with score
    0, as are all texts where there was nothing to learn from. Language, source
    and id never enter a prediction. Repeated rows give equal rows; extra columns
    are ignored. An empty table gives an empty table.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), held_out(column(id_col)).alias("held_out"), column(text_col).alias("text"), column(text_col).rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(tidy(_apply, net), "doc_id long, held_out boolean, lang_pred string, score double")
