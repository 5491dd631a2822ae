"""Language identification by a byte convolutional network.

A text's bytes are cut into windows of fixed length. Each window goes through an
embedding of bytes, filters of several widths, the largest response of each filter and a
softmax. The network is trained in numpy on a bounded sample of labelled texts. A whole
text's prediction is the mean of its windows' probabilities, by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_fold, small_batches

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Documents a language, and windows a document, that the network is trained on at most.
MAX_DOCS, DOC_WINDOWS = 500, 3
EPOCHS, BATCH, RATE = 8, 64, 0.004
#: Few training windows are gone through more often, to make so many steps.
MIN_STEPS = 400
#: Windows that go through the network at once.
AT_ONCE = 512
FOLDS, HELD = 4, 2
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, A-Z in lower case; the last is padded with zeros."""
    data = data.lower()
    count = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(count * WINDOW, b"\0"), np.uint8).reshape(count, WINDOW)


class Network:
    """Parameters, and what is done with them."""

    def __init__(self, languages: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["c"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        emb, pooled, kept = self.p["e"][x], [], []
        for w in WIDTHS:
            length = x.shape[1] - w + 1
            # Row i of a window's matrix is the embeddings of bytes i to i + w - 1.
            lag = np.lib.stride_tricks.as_strided(
                emb, (x.shape[0], length, w * EMBED), (emb.strides[0], emb.strides[1], emb.strides[2])
            ).reshape(-1, w * EMBED)
            out = (lag @ self.p[f"f{w}"]).reshape(x.shape[0], length, FILTERS)
            at = out.argmax(axis=1)
            top = np.take_along_axis(out, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((lag.reshape(x.shape[0], length, -1), at, top > 0))
        hidden = np.concatenate(pooled, axis=1)
        z = hidden @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), [hidden, *kept]

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[k : k + AT_ONCE])[0] for k in range(0, len(x), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, (hidden, *kept) = self._forward(x)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dz = prob
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g["o"], g["c"] = hidden.T @ dz, dz.sum(axis=0)
        dh = dz @ self.p["o"].T
        row = np.arange(len(x))[:, None]
        for k, (w, (lag, at, on)) in enumerate(zip(WIDTHS, kept, strict=True)):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"b{w}"] = d.sum(axis=0)
            # Only the place of the largest response passes the gradient on.
            g[f"f{w}"] = np.einsum("nfk,nf->kf", lag[row, at], d, optimize=True)
            de = (d[:, :, None] * self.p[f"f{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], x[row, at + j], de[:, :, j])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // max(1, len(x))))):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows, t = order[at : at + BATCH], t + 1
                for k, g in self._gradient(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def _spaced(count: int) -> list[int]:
    """Windows of a training text: at its begin, its middle and its end."""
    return sorted({(count - 1) * k // max(1, DOC_WINDOWS - 1) for k in range(DOC_WINDOWS)})


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, held: int = HELD, max_docs: int = MAX_DOCS) -> Network | None:
    """Train on documents with a language outside the held-out fold; None if there is none.

    Of each language about max_docs documents are taken by a hash of their id, at most
    four times as many. A few windows of each come to the driver.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (held_fold(F.col(doc_id), folds) != held))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang)).count().orderBy(lang).collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, max_docs / n))))
    chosen = known.where(unit <= F.element_at(share, F.col(lang))).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for r in rows:
                w = windows(r["_text"].encode())
                found += [(r["_id"], r["_lang"], w[k].tobytes()) for k in _spaced(len(w))]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string() if id_type == "string" else None), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["_id", "_lang", "_window"])

    id_type = "string"
    chosen = chosen.withColumn("_id", F.col("_id").cast("string"))
    most = 4 * max_docs * DOC_WINDOWS * len(counts)
    rows = chosen.mapInArrow(cut, "_id string, _lang string, _window binary").orderBy("_id", "_lang", "_window").limit(most).collect()
    languages = sorted(counts)
    x = np.frombuffer(b"".join(bytes(r["_window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r["_lang"]) for r in rows])
    return Network(languages).train(x, y)


def predict_texts(texts: list[str | None], net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The number of the likeliest language of each text, and its probability."""
    total, size = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    room = 8 * AT_ONCE

    def flush() -> None:
        if held:
            x = np.concatenate(held)
            weight = np.count_nonzero(x, axis=1).astype(np.float64)
            of = np.concatenate(owner)
            np.add.at(total, of, net.predict(x) * weight[:, None])
            np.add.at(size, of, weight)
        held.clear()
        owner.clear()

    for k, text in enumerate(texts):
        x = windows(text.encode()) if text else np.zeros((0, WINDOW), np.uint8)
        for at in range(0, len(x), room):
            part = x[at : at + room]
            held.append(part)
            owner.append(np.full(len(part), k))
            if sum(map(len, held)) >= room:
                flush()
    flush()
    mean = total / np.maximum(size, 1)[:, None]
    return mean.argmax(axis=1), mean.max(axis=1)


def identify(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score; `und` and 0 where the text is null or has no letter, or without a network.

    Columns of these names are replaced; others pass through.
    """
    if net is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    names = F.array(*map(F.lit, net.languages))

    small_batches(df.sparkSession)

    @F.arrow_udf("struct<k int, p double>")
    def of(texts: pa.Array) -> pa.Array:
        best, p = predict_texts(texts.to_pylist(), net)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(np.minimum(p, 1.0))], names=["k", "p"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = df.withColumn("_found", of(F.col(text))).withColumn("_known", known)
    return found.withColumns(
        {
            "lang_pred": F.when(F.col("_known"), names[F.col("_found.k")]).otherwise(F.lit(UNKNOWN)),
            "score": F.when(F.col("_known"), F.col("_found.p")).otherwise(F.lit(0.0)),
        }
    ).drop("_found", "_known")
