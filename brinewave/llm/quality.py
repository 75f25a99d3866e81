"""Document quality by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of ``2 * HALF`` bytes that step by ``HALF``, so
every byte is in a chunk. Each of ``FILTERS`` learned filters looks at ``SPAN`` neighbouring
bytes; its largest response in a chunk is kept (max-pooling), a small layer turns the
responses into the chunk's logit, and mean, largest and smallest logit of all chunks are
combined into one probability.

Training: a sample of at most ``SAMPLE_DOCS`` labelled documents, chosen by a hash of the
id, of which at most ``SAMPLE_CHUNKS`` chunks each are collected; that bounds what reaches
the driver. The combination is fitted on mean, largest and smallest logit of the sample's
whole texts, which tasks compute. Scoring reads whole texts. A filter over byte pairs is a table look-up, so a
response is a sum of ``SPAN / 2`` table rows.

Defined cases: null and empty texts are one chunk of zero bytes; equal texts get equal
scores; without any labelled document, or with one class only, the score is the smoothed
share of label 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import flat_bytes, held_out, llm_query, schema_with, slices, table

HALF = 256
SPAN = 8
FILTERS = 24
EMBED = 8
HIDDEN = 16
SAMPLE_DOCS = 6000
SAMPLE_CHUNKS = 5
EPOCHS = 7
#: share of training chunks that are cut to a random length, so that short texts are known
CUT = 0.4
#: score from which a document counts as good
KEEP = 0.7


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as whole halves of zero-padded bytes, and the offsets in halves.

    Every text gets two halves at least and SPAN - 1 zeros at its end, so no filter sees
    two texts.
    """
    sizes = np.diff(offsets)
    halves = np.maximum(2, -(-(sizes + SPAN - 1) // HALF))
    at = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(at[-1] * HALF + SPAN, np.uint8)
    out[np.repeat(at[:-1] * HALF - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])] = data
    return out, at


class ByteNet:
    """Weights of the network, trained by gradient descent (Adam) on chunks."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "embed": normal(256, EMBED, scale=0.5),
            "conv": normal(SPAN * EMBED, FILTERS, scale=(SPAN * EMBED) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "inner": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
            "inner_bias": np.zeros(HIDDEN, np.float32),
            "outer": normal(HIDDEN, 1, scale=HIDDEN**-0.5),
            "outer_bias": np.zeros(1, np.float32),
        }
        self.combine = np.array([1.0, 0.0, 0.0, 0.0])
        self.tables: list[np.ndarray] | None = None

    def fit(self, chunks: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.004) -> None:
        """``chunks``: (n, 2 * HALF + SPAN - 1) bytes."""
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(chunks))
            lr = rate * (1 - epoch / epochs)
            for start in range(0, len(order), batch):
                pick = order[start : start + batch]
                grads = self._gradients(self._cut(chunks[pick], rng), labels[pick])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    @staticmethod
    def _cut(chunks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Some chunks end early, as a short text does."""
        length = np.exp(rng.uniform(np.log(12), np.log(2 * HALF), len(chunks)))
        length[rng.random(len(chunks)) >= CUT] = chunks.shape[1]
        return np.where(np.arange(chunks.shape[1]) < length[:, None], chunks, 0)

    def _gradients(self, chunks: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(chunks)
        embedded = w["embed"][chunks]
        view = np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, -1), SPAN * EMBED, axis=1)[:, ::EMBED]
        response = np.matmul(view, w["conv"])
        place = response.argmax(axis=1)
        rows = np.arange(n)[:, None]
        pooled = response[rows, place, np.arange(FILTERS)] + w["bias"]
        top = np.maximum(pooled, 0)
        inner = top @ w["inner"] + w["inner_bias"]
        active = np.maximum(inner, 0)
        logit = (active @ w["outer"] + w["outer_bias"])[:, 0]
        error = ((1 / (1 + np.exp(-logit)) - labels) / n).astype(np.float32)
        g = {"outer": active.T @ error[:, None] + 1e-3 * w["outer"], "outer_bias": error.sum(keepdims=True)}
        back = error[:, None] * w["outer"][:, 0] * (inner > 0)
        g |= {"inner": top.T @ back + 1e-3 * w["inner"], "inner_bias": back.sum(0)}
        back = (back @ w["inner"].T) * (pooled > 0)
        g["bias"] = back.sum(0)
        windows = view[rows, place]
        g["conv"] = np.einsum("nfk,nf->kf", windows, back) + 1e-3 * w["conv"]
        into = (back[:, :, None] * w["conv"].T[None]).reshape(n, FILTERS, SPAN, EMBED)
        g["embed"] = np.zeros_like(w["embed"])
        seen = chunks[rows[:, :, None], place[:, :, None] + np.arange(SPAN)]
        np.add.at(g["embed"], seen, into)
        return g

    def __getstate__(self) -> dict:
        """Weights only: tasks make the tables themselves."""
        return {**self.__dict__, "tables": None}

    def compile(self) -> None:
        """Byte-pair tables: one row of filter responses for each pair at each even place."""
        per_byte = np.einsum("be,jef->jbf", self.w["embed"], self.w["conv"].reshape(SPAN, EMBED, FILTERS))
        self.tables = [
            (per_byte[j + 1][:, None] + per_byte[j][None]).reshape(1 << 16, FILTERS).astype(np.float32) for j in range(0, SPAN, 2)
        ]

    def half_maxima(self, data: np.ndarray, block: int = 256 * HALF) -> np.ndarray:
        """Largest response of each filter in each half of padded bytes."""
        if self.tables is None:
            self.compile()
        total = (len(data) - SPAN) // HALF * HALF
        pairs = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << 8)
        out = np.empty((total // HALF, FILTERS), np.float32)
        for start in range(0, total, block):
            end = min(total, start + block)
            response = np.take(self.tables[0], pairs[start:end], axis=0)
            for k in range(1, SPAN // 2):
                response += np.take(self.tables[k], pairs[start + 2 * k : end + 2 * k], axis=0)
            out[start // HALF : end // HALF] = response.reshape(-1, HALF, FILTERS).max(axis=1)
        return out

    def chunk_logits(self, halves: np.ndarray) -> np.ndarray:
        """Logit of the chunk of each half and the next one."""
        top = np.maximum(np.maximum(halves[:-1], halves[1:]) + self.w["bias"], 0)
        active = np.maximum(top @ self.w["inner"] + self.w["inner_bias"], 0)
        return (active @ self.w["outer"] + self.w["outer_bias"])[:, 0].astype(np.float64)

    def features(self, column: pa.Array) -> np.ndarray:
        """Mean, largest and smallest chunk logit of each text, and 1."""
        data, at = padded(*flat_bytes(column))
        logits = self.chunk_logits(self.half_maxima(data))
        first, last = at[:-1], at[1:] - 1  # the last half of a text starts no chunk
        out = np.ones((len(column), 4))
        edges = np.stack([first, last], 1).ravel()
        logits = np.concatenate([logits, [0.0]])
        out[:, 0] = np.add.reduceat(logits, edges)[::2] / (last - first)
        out[:, 1] = np.maximum.reduceat(logits, edges)[::2]
        out[:, 2] = np.minimum.reduceat(logits, edges)[::2]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.combine, -30, 30)))


class Constant:
    """The share of label 1 where nothing can be learned."""

    def __init__(self, share: float):
        self.share = share

    def score(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.share)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``most`` labelled training documents ``(doc_id, text, quality)``, by a hash of the id."""
    marked = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").where(~held_out("doc_id"))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the ids are chosen before any text is moved
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that occurs often gives one text
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))


def _chunks_of(frame: DataFrame, chunks: int) -> list:
    """Bounded chunks of each sampled document: evenly spread over all its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, at = padded(*flat_bytes(batch.column(1)))
            doc, out, label = [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                n = b - a - 1
                for c in sorted({int(x) for x in np.linspace(0, n - 1, min(n, chunks))}):
                    start = (a + c) * HALF
                    out.append(data[start : start + 2 * HALF + SPAN - 1].tobytes().ljust(2 * HALF + SPAN - 1, b"\0"))
                    doc.append(batch.column(0)[i].as_py())
                    label.append(batch.column(2)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(label, pa.int32()), pa.array(out, pa.binary())], ["doc_id", "quality", "chunk"])

    rows = frame.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    return rows.mapInArrow(run, "doc_id long, quality int, chunk binary").orderBy("doc_id", "chunk").collect()


def _features_of(frame: DataFrame, net: ByteNet) -> list:
    """``(doc_id, quality, f)`` of each sampled document, ``f`` over all its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            f = pa.array(net.features(batch.column(1)).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), f], ["doc_id", "quality", "f"])

    rows = frame.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    return rows.mapInArrow(run, "doc_id long, quality int, f array<double>").orderBy("doc_id", "f").collect()


def train(docs: DataFrame, labels: DataFrame, docs_most: int = SAMPLE_DOCS, chunks_most: int = SAMPLE_CHUNKS) -> ByteNet | Constant:
    chosen = sample(docs, labels, docs_most)
    rows = _chunks_of(chosen, chunks_most)
    y = np.array([r.quality for r in rows], np.float32)
    if not len(y) or len(set(y.tolist())) < 2:
        return Constant((y.sum() + 1) / (len(y) + 2))
    x = np.stack([np.frombuffer(r.chunk, np.uint8) for r in rows])
    net = ByteNet()
    net.fit(x, y)
    # combination of the chunks, on the whole sampled documents
    whole = _features_of(chosen, net)
    net.combine = _logistic(np.array([r.f for r in whole]), np.array([r.quality for r in whole], np.float32))
    return net


def _logistic(f: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Newton's method for a small ridge logistic regression around the mean logit."""
    prior = np.array([1.0, 0.0, 0.0, 0.0])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        gradient = f.T @ (p - y) + ridge * len(y) * (w - prior)
        hessian = (f * (p * (1 - p))[:, None]).T @ f + ridge * len(y) * np.eye(4)
        w = w - np.linalg.solve(hessian, gradient)
    return w


def score(docs: DataFrame, model: ByteNet | Constant, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a probability; texts are read whole."""
    at = docs.columns.index(text)
    schema = schema_with(docs, **{name: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 18):
            found = pa.array(model.score(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


@llm_query("op10_byte_cnn_quality")
def op10(spark, sf_dir):
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
