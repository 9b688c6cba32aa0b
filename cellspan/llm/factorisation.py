"""Quality classifier: a factorisation machine over hashed words, statistics of the text's structure, and its size."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import pieces
from cellspan.llm.labelled import held_out, sample

ODD = re.compile(r"[^\w\s.,;:!?'\"’()-]+|[.,;:!?*#-]{2,}")
SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
STATS = 14


def _steps(x: float, *bounds: float) -> list[float]:
    return [float(x > b) for b in bounds]


def vector(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's features: its distinct words' buckets, of length 1 together; then the statistics."""
    text = text or ""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(w))
    h = np.unique(np.fromiter((crc32(x) % buckets for x in w), np.int64, len(w)))
    lines = [x for x in text.split("\n") if x.strip()]
    odd, shouted = len(ODD.findall(text)) / n, len(SHOUTED.findall(text)) / n
    symbols = sum(map(text.count, "#*$%&|<>")) / n
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    triples = set(zip(w, w[1:], w[2:])) if len(w) > 3 else ()
    again = 1 - len(triples) / (len(w) - 2) if triples else 0.0
    stats = [
        1.0, *_steps(odd, 0.1, 0.3), *_steps(symbols, 0.02, 0.1), *_steps(shouted, 0.1, 0.4), float(text.count("!") / n > 0.2),
        *_steps(repeated, 0.1, 0.35), *_steps(again, 0.15, 0.4), min(3.0, np.log1p(len(w)) / 4), min(3.0, len(text) / n / 8),
    ]
    value = np.concatenate([np.full(len(h), 1 / np.sqrt(max(1, len(h)))), stats])
    return np.concatenate([h, buckets + np.arange(STATS)]), value


@dataclass
class FactorisationMachine:
    """y = bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the last as half of (sum v x) ** 2 - sum (v x) ** 2."""

    w: np.ndarray
    v: np.ndarray
    bias: float
    buckets: int

    @classmethod
    def fresh(cls, buckets: int, rank: int, bias: float) -> FactorisationMachine:
        return cls(np.zeros(buckets + STATS), np.random.default_rng(7).normal(0, 0.05, (buckets + STATS, rank)), bias, buckets)

    def parts(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, sums of v x, and v x, of rows that begin at `at`; time is linear in the number of features."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(1)
        return self.bias + np.add.reduceat(self.w[index] * value, at) + pairs, total, vx

    def probability(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        at = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        y, _, _ = self.parts(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), at)
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4) -> None:
        """AdaGrad on the logistic loss."""
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), 64):
                some = order[k : k + 64]
                size = [len(rows[r][0]) for r in some]
                index = np.concatenate([rows[r][0] for r in some])
                value = np.concatenate([rows[r][1] for r in some])
                y, total, vx = self.parts(index, value, np.cumsum([0, *size[:-1]]))
                off = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[some]) / len(some)
                each = np.repeat(off, size) * value
                touched, back = np.unique(index, return_inverse=True)
                dw = np.bincount(back, each, len(touched)) + decay * self.w[touched]
                step = each[:, None] * (np.repeat(total, size, axis=0) - vx)
                dv = np.stack([np.bincount(back, step[:, f], len(touched)) for f in range(self.v.shape[1])], 1) + decay * self.v[touched]
                gw[touched] += dw**2
                gv[touched] += dv**2
                gb += off.sum() ** 2
                self.w[touched] -= rate * dw / np.sqrt(gw[touched])
                self.v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
                self.bias -= rate * off.sum() / np.sqrt(gb)


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, buckets: int = 1 << 14, rank: int = 8, modulus: int = 3, remainder: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> FactorisationMachine:
    """Learns labels.quality from at most max_rows labelled documents; ids with crc32 mod modulus equal to remainder are
    not looked at. Only those rows' feature vectors (made on the executors) come to the driver. Without labels of both
    kinds every score is near their share of ones, one half without any."""
    schema = "id long, label int, i array<long>, x array<float>"
    known = sample(docs, labels, "quality", modulus, remainder, max_rows, id_col, text_col).select(F.xxhash64("id").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [vector(t.as_py(), buckets) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i for i, _ in got], pa.list_(pa.int64())), pa.array([x for _, x in got], pa.list_(pa.float32()))], names=["id", "label", "i", "x"])

    rows = known.mapInArrow(run, schema).toArrow().sort_by("id")
    label = np.array(rows["label"].to_pylist(), float)
    share = min(max(label.mean(), 0.01), 0.99) if len(label) else 0.5
    model = FactorisationMachine.fresh(buckets, rank, float(np.log(share / (1 - share))))
    if 0 < label.sum() < len(label):
        pairs = [(np.array(i.values.to_numpy()), np.array(x.values.to_numpy(), float)) for i, x in zip(rows["i"], rows["x"], strict=True)]
        model.train(pairs, label)
    return model


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs: score is the odds of label 1 as a probability, from the
    whole text alone; null and empty texts are scored by their (zero) statistics. Repeated rows give repeated results;
    other columns are not read."""
    model = fit(docs, labels, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col)
    parts = (model.w, model.v, model.bias, model.buckets)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = FactorisationMachine(*parts)
        for b in pieces(batches):
            got = np.concatenate([fm.probability([vector(t.as_py(), fm.buckets) for t in b.column(1).slice(k, 50)]) for k in range(0, max(1, b.num_rows), 50)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=schema.names)

    out = docs.select(id_col, text_col).mapInArrow(run, schema)
    return out.select(id_col, held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
