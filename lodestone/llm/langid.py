"""Language ID by a byte convolutional network, trained and applied in numpy.

Bytes are mapped to 64 classes by a fixed rule (letters without case, the bytes of
multi-byte characters kept apart); filters of widths 2, 3 and 4 slide over a window
of ``WINDOW`` bytes, the maximum of each filter over the window goes through a ReLU
and a linear layer to a softmax. A whole text is cut into windows, all of them are
scored in batches, and their probabilities averaged.

Training reads at most ``SAMPLE_DOCS`` labelled documents (the bound is a parameter, but
for documents alike in id and text), chosen by a hash of id and text. Executors cut each whole
text into windows and draw at most ``DOC_WINDOWS`` of them from all over it; of these at
most ``TRAIN_WINDOWS`` in all, as many for every language, reach the driver: 8 MB.

A null text, or one without a letter (Unicode category L; a number such as a Roman
numeral or a superscript is none), is ``und`` with score 0. Ids, sources and labels
are no input of a prediction. All columns of the input are kept, whatever their names;
the two new ones get underscores in front while their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_arrow

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 64
SAMPLE_DOCS = 1500
DOC_WINDOWS, TRAIN_WINDOWS = 64, 32768
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """0 white space and control, 1-26 letters, 27 digits, 28 other ASCII, and 29-60 the
    bytes above, by their five low bits."""
    out = np.full(256, 28, np.uint16)
    out[:33] = 0
    out[48:58] = 27
    for n in range(26):
        out[65 + n] = out[97 + n] = n + 1
    out[128:] = 29 + np.arange(128) % 32
    return out


def windows(text: bytes, classes: np.ndarray) -> np.ndarray:
    """All windows of a text, the last one filled up with white space."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint16)
    out[: len(text)] = classes[np.frombuffer(text, np.uint8)]
    return out.reshape(n, WINDOW)


class Network:
    """Filters (width, class, filter), biases and the linear layer on top."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.top = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.top_bias = np.zeros(len(labels), np.float32)
        self.pairs: dict[int, list[np.ndarray]] = {}

    def compose(self) -> None:
        """Sums of each filter's taps two by two, as tables over pairs of classes."""
        self.pairs = {}
        for w, f in self.filters.items():
            self.pairs[w] = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(-1, FILTERS) if k + 1 < w else f[k] for k in range(0, w, 2)]

    def features(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Per window, each filter's maximum over it (and where that is)."""
        pair = x[:, :-1] * np.uint16(CLASSES) + x[:, 1:]
        best, places = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            total = None
            for k, table in zip(range(0, w, 2), self.pairs[w], strict=True):
                part = table[(pair if k + 1 < w else x)[:, k : k + n]]
                total = part if total is None else total + part
            if where:
                places.append(total.argmax(axis=1))
            best.append(total.max(axis=1))
        return np.concatenate(best, axis=1), np.concatenate(places, axis=1) if where else None

    def probabilities(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)))
        for a in range(0, len(x), batch):
            h = np.maximum(self.features(x[a : a + batch])[0] + self.bias, 0)
            z = h @ self.top + self.top_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + batch] = e / e.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over a batch, in the order of the parameters; the
        maximum passes its gradient to its place."""
        self.compose()
        raw, places = self.features(x, where=True)
        h = np.maximum(raw + self.bias, 0)
        z = h @ self.top + self.top_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = e / e.sum(axis=1, keepdims=True)
        g[np.arange(len(x)), y] -= 1
        g /= len(x)
        gh = (g @ self.top.T) * (h > 0)
        grads = []
        for n, w in enumerate(WIDTHS):
            part = slice(n * FILTERS, (n + 1) * FILTERS)
            gw = np.zeros_like(self.filters[w])
            for k in range(w):
                cls = np.take_along_axis(x, places[:, part] + k, axis=1)
                np.add.at(gw[k], (cls, np.arange(FILTERS)[None, :]), gh[:, part])
            grads.append(gw)
        return [*grads, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters.values(), self.bias, self.top, self.top_bias]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                grads = self.gradients(x[at], y[at])
                step += 1
                for p, gr, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (gr - m)
                    v += 0.01 * (gr * gr - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        self.compose()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; documents with 1 are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network for the languages of the labelled documents that are not held out;
    None if there are none."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{doc_id}`").alias("doc_id"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    count = rows.select("lang").count()
    if not count:
        return None
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("langid")), F.lit(1 << 30))
    # more than enough by the hash, of these exactly the first ones
    rows = rows.withColumn("key", key).filter(F.col("key") < int((1 << 30) * min(1.0, 2 * sample_docs / count)))
    last = rows.select("key").orderBy("key").limit(sample_docs).agg(F.max("key")).first()[0]
    if last is None:
        return None
    drawn = map_arrow(rows.filter(F.col("key") <= last).select("lang", "text", "key"), _draw, "lang string, window binary, at bigint")
    n_labels = drawn.select("lang").distinct().count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "window"))
    sample = drawn.withColumn("place", place).filter(F.col("place") <= max(1, TRAIN_WINDOWS // n_labels)).orderBy("lang", "place").collect()
    labels = sorted({s.lang for s in sample})
    net = Network(labels)
    net.train(np.frombuffer(b"".join(s.window for s in sample), np.uint8).reshape(-1, WINDOW).astype(np.uint16), np.array([labels.index(s.lang) for s in sample]))
    return net


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows drawn from whole texts, with a number to draw again by."""
    classes = byte_classes()
    for b in batches:
        langs, found, at = [], [], []
        for lang, text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cut, rng = windows(text.encode(), classes), np.random.default_rng(key)
            for n in rng.permutation(len(cut))[:DOC_WINDOWS]:
                langs.append(lang)
                found.append(cut[n].astype(np.uint8).tobytes())
                at.append(int(rng.integers(1 << 62)))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()), pa.array(at, pa.int64())], names=["lang", "window", "at"])


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    names = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [t if t is not None and network is not None and any(map(str.isalpha, t)) else None for t in b.column(at).to_pylist()]
                preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [n for n, t in enumerate(texts) if t is not None]
                if known:
                    cut = [windows(texts[n].encode(), classes) for n in known]
                    counts = np.array([len(w) for w in cut])
                    p = network.probabilities(np.concatenate(cut))
                    mean = np.add.reduceat(p, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                    for n, m in zip(known, mean, strict=True):
                        preds[n], scores[n] = network.labels[int(m.argmax())], float(min(1.0, m.max()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds), pa.array(scores)], names=[f"f{n}" for n in range(len(b.columns) + 2)])

    return map_arrow(docs, run, schema)
