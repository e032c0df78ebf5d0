"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP and cover
the whole document. Bytes are embedded, FILTERS filters of WIDTH bytes run over a chunk in
steps of STEP, and each filter's largest response in the chunk is kept. A chunk's logit
is linear in these; a document's probability comes from the mean logit of its chunks, so
no part of a document is left out and long ones are not favoured.

Embedding, filters and output are learned together (Adam) on a bounded sample: at most
SAMPLE_ROWS labelled rows of at most MAX_CHARS characters. A logistic fit on the part of
the sample that was not trained on calibrates the probability.

Edge cases: null and empty texts are one empty chunk; texts of any length are scored
whole, in bounded pieces; null labels are not learned from; rows with equal or null ids
each give a row; without labelled rows every score is 0.5; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import labelled_sample, python_workers, session

SAMPLE_ROWS, MAX_CHARS = 3_000, 20_000
CHUNK, OVERLAP, WIDTH, STEP, DIM, FILTERS = 512, 64, 8, 4, 8, 32
WINDOWS = (CHUNK - WIDTH) // STEP + 1
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Chunks that are in memory at once.
PIECE = 192


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes, zero-padded; number of windows that begin inside the text, for each chunk)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = 1 + max(0, -(-(len(raw) - CHUNK) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]
    left = len(raw) - np.arange(n) * step
    return out, np.clip(-(-left // STEP), 1, WINDOWS)


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def pooled(self, chunks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest responses: chunks x FILTERS, the windows they come from)."""
        view = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STEP]
        x = self.p["embed"][view].reshape(len(chunks) * WINDOWS, WIDTH * DIM)
        z = (x @ self.p["filters"]).reshape(len(chunks), WINDOWS, FILTERS)
        z[np.arange(WINDOWS)[None, :] >= windows[:, None]] = -1e9
        at = z.argmax(1)
        return np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["bias"], at

    def logits(self, chunks: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out = [np.empty(0, np.float32)]
        for lo in range(0, len(chunks), PIECE):
            out.append(np.tanh(self.pooled(chunks[lo : lo + PIECE], windows[lo : lo + PIECE])[0]) @ self.p["out"] + self.p["base"])
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> list[float]:
        """The probability of each text; chunks of short texts share matrix products, long texts go in pieces."""
        out = np.zeros(len(texts))
        total = np.zeros(len(texts))
        held, owner, n = [], [], 0

        def flush() -> None:
            nonlocal held, owner, n
            if held:
                z = self.logits(np.concatenate([c for c, _ in held]), np.concatenate([w for _, w in held]))
                np.add.at(out, np.concatenate(owner), z)
            held, owner, n = [], [], 0

        for k, t in enumerate(texts):
            chunks, windows = chunks_of(t)
            total[k] = len(chunks)
            for lo in range(0, len(chunks), PIECE):
                part = chunks[lo : lo + PIECE]
                held.append((part, windows[lo : lo + PIECE]))
                owner.append(np.full(len(part), k))
                n += len(part)
                if n >= PIECE:
                    flush()
        flush()
        z = self.scale * out / np.maximum(total, 1) + self.shift
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def train(self, rows: list[tuple[Any, str | None, int]], seed: int = 5) -> Network:
        if not rows:
            self.p["out"][:] = 0
            return self
        held = rows[::5] if len(rows) >= 50 else rows
        fit = [r for k, r in enumerate(rows) if k % 5] if len(rows) >= 50 else rows
        good = sum(1 for r in fit if r[2])
        if good and good < len(fit):
            self._descend([chunks_of(t) for _, t, _ in fit], np.array([r[2] for r in fit], np.float32), seed)
        else:
            self.p["out"][:] = 0
        self._calibrate(np.array([self._mean_logit(t) for _, t, _ in held]), np.array([r[2] for r in held], float))
        return self

    def _mean_logit(self, text: str | None) -> float:
        return float(self.logits(*chunks_of(text)).mean())

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the mean logit, by Newton's method with a small ridge."""
        x = np.stack([z, np.ones_like(z)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 0.05 * (w - [1, 0])
            w = w - np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad), -1, 1)
        self.scale, self.shift = max(0.05, float(w[0])), float(w[1])

    def _descend(self, data: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> None:
        r = np.random.default_rng(seed)
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        steps = EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                batch = order[lo : lo + BATCH]
                grads = self._gradients([data[k] for k in batch], y[batch], weight[batch])
                t += 1
                rate = RATE * (1 - t / (steps + 1))
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)

    def _gradients(self, data: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        owner = np.repeat(np.arange(len(data)), [len(c) for c, _ in data])
        n = np.bincount(owner)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        pieces, logits = [], []
        for lo in range(0, len(owner), PIECE):
            chunks = np.concatenate([c for c, _ in data])[lo : lo + PIECE]
            a, at = self.pooled(chunks, np.concatenate([w for _, w in data])[lo : lo + PIECE])
            h = np.tanh(a)
            pieces.append((lo, chunks, h, at))
            logits.append(h @ self.p["out"] + self.p["base"])
        z = np.bincount(owner, np.concatenate(logits)) / n
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d_doc = weight * (p - y) / len(data)
        for lo, chunks, h, at in pieces:
            d = (d_doc / n)[owner[lo : lo + len(h)]].astype(np.float32)
            grads["out"] += h.T @ d
            grads["base"] += d.sum()
            d_a = d[:, None] * self.p["out"] * (1 - h * h)
            grads["bias"] += d_a.sum(0)
            # only the window with the largest response gets a gradient
            seen = chunks[np.arange(len(h))[:, None, None], at[:, :, None] * STEP + np.arange(WIDTH)]
            x = self.p["embed"][seen].reshape(len(h), FILTERS, WIDTH * DIM)
            grads["filters"] += np.einsum("cf,cfk->kf", d_a, x)
            back = (d_a[:, :, None] * self.p["filters"].T).reshape(-1, DIM)
            flat = seen.reshape(-1)
            for k in range(DIM):
                grads["embed"][:, k] += np.bincount(flat, back[:, k], 256).astype(np.float32)
        return grads


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, max_chars: int = MAX_CHARS) -> Network:
    """A network trained on labelled rows whose id satisfies `learn`."""
    return Network().train(labelled_sample(docs, labels, learn, label_col, id_col, text_col, rows, max_chars))


def score_documents(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    import pyarrow as pa

    spark = session(docs)
    python_workers(spark)
    sent = spark.sparkContext.broadcast(network)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scored(batches: Iterator[Any]) -> Iterator[Any]:
        net = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
