"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded; learned filters of WIDTH bytes step by STRIDE over all of it. Segments of 32 steps are
pooled, two neighbours make a chunk (so chunks overlap by half and cover the whole document), a second layer of
learned filters reads each chunk's mean and largest responses, and its largest responses over all chunks are combined
into one probability. Trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

WIDTH, STRIDE, STEPS = 8, 4, 32
SEGMENT = STRIDE * STEPS
EMBED, FILTERS, CHUNK_FILTERS = 6, 16, 24
#: Labelled rows of each class that are learned from at most, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_CHARS, EPOCHS = 1200, 30_000, 20
#: Rows with at least this probability of being good are predicted good.
THRESHOLD = 0.3


def _lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each window (windows x WIDTH), first segment of each text, segments of each text (two at least)."""
    segments = np.array([max(2, -(-len(t) // SEGMENT)) for t in texts])
    held = segments * SEGMENT + WIDTH
    starts = np.concatenate([[0], np.cumsum(held)[:-1]])
    raw = np.zeros(int(held.sum()), dtype=np.uint8)
    for t, s in zip(texts, starts, strict=True):
        raw[s : s + len(t)] = np.frombuffer(t, dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(segments)[:-1]])
    at = np.arange(int(segments.sum()) * STEPS) * STRIDE + np.repeat(starts - first * SEGMENT, segments * STEPS)
    return raw[at[:, None] + np.arange(WIDTH)], first, segments


def _start(rng: np.random.Generator) -> dict:
    draw = lambda n, *shape: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
    return {
        "embed": draw(1, 256, EMBED), "w1": draw(WIDTH * EMBED, WIDTH, EMBED, FILTERS), "b1": np.zeros(FILTERS, np.float32),
        "w2": draw(2 * FILTERS, 2 * FILTERS, CHUNK_FILTERS), "b2": np.zeros(CHUNK_FILTERS, np.float32),
        "w3": draw(CHUNK_FILTERS, CHUNK_FILTERS + 1), "b3": np.zeros(1, np.float32),
    }


def _pooled(h: np.ndarray, first: np.ndarray, segments: np.ndarray) -> tuple:
    """Chunk features, and what the way back needs."""
    h = h.reshape(-1, STEPS, FILTERS)
    total, most = h.sum(1), h.max(1)
    last = np.zeros(len(total), dtype=bool)
    last[first + segments - 1] = True
    s = np.flatnonzero(~last)  # a chunk is this segment and the next one
    chunk = np.concatenate([(total[s] + total[s + 1]) / (2 * STEPS), np.maximum(most[s], most[s + 1])], 1)
    return chunk, s, most


def _combined(p: dict, chunk: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple:
    at = first - np.arange(len(first))  # one chunk fewer than segments in each text before
    u = np.maximum(chunk @ p["w2"] + p["b2"], 0)
    top = np.maximum.reduceat(u, at, axis=0)
    features = np.concatenate([top, np.log1p(sizes)[:, None].astype(np.float32) / 10], 1)
    return u, top, features, features @ p["w3"] + p["b3"], at


def score(p: dict, texts: list[bytes]) -> np.ndarray:
    """Probability that each text is good."""
    if not texts:
        return np.zeros(0)
    windows, first, segments = _lay_out(texts)
    table = np.einsum("be,jef->jbf", p["embed"], p["w1"])
    z = np.broadcast_to(p["b1"], (len(windows), FILTERS)).copy()
    for j in range(WIDTH):
        z += table[j].take(windows[:, j], axis=0)
    np.maximum(z, 0, out=z)
    chunk, _, _ = _pooled(z, first, segments)
    logit = _combined(p, chunk, first, np.array([len(t) for t in texts]))[3]
    return 1 / (1 + np.exp(-logit.astype(np.float64)))


def _gradients(p: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    windows, first, segments = _lay_out(texts)
    n = len(windows)
    e = p["embed"][windows].reshape(n, WIDTH * EMBED)
    h = np.maximum(e @ p["w1"].reshape(WIDTH * EMBED, FILTERS) + p["b1"], 0)
    chunk, s, most = _pooled(h, first, segments)
    u, top, features, logit, at = _combined(p, chunk, first, np.array([len(t) for t in texts]))
    d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(texts)).astype(np.float32)
    g = {"w3": features.T @ d, "b3": d.sum(keepdims=True)}
    d_top = d[:, None] * p["w3"][:-1]
    counts = np.diff(np.append(at, len(u)))
    won = (u == np.repeat(top, counts, axis=0)) & (u > 0)
    d_u = won * np.repeat(d_top, counts, axis=0) / np.maximum(1, np.repeat(np.add.reduceat(won, at, axis=0), counts, axis=0))
    g |= {"w2": chunk.T @ d_u, "b2": d_u.sum(0)}
    d_chunk = d_u @ p["w2"].T
    h3 = h.reshape(-1, STEPS, FILTERS)
    d_total, d_most = np.zeros_like(most), np.zeros_like(most)
    for k in (0, 1):
        d_total[s + k] += d_chunk[:, :FILTERS] / (2 * STEPS)
        mine, other = most[s + k], most[s + 1 - k]
        d_most[s + k] += d_chunk[:, FILTERS:] * np.where(mine > other, 1, np.where(mine == other, 0.5, 0))
    topped = h3 == most[:, None, :]
    d_h = d_total[:, None, :] + topped * (d_most / np.maximum(1, topped.sum(1)))[:, None, :]
    d_z = np.where(h > 0, d_h.reshape(n, FILTERS), 0).astype(np.float32)
    g |= {"w1": (e.T @ d_z).reshape(p["w1"].shape), "b1": d_z.sum(0)}
    d_e = (d_z @ p["w1"].reshape(WIDTH * EMBED, FILTERS).T).reshape(n, WIDTH, EMBED)
    g["embed"] = np.stack([np.bincount(windows.ravel(), weights=d_e[:, :, k].ravel(), minlength=256) for k in range(EMBED)], 1)
    g["embed"][0] = 0  # padding stays silent
    return g


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> dict:
    """Parameters learned by Adam over shuffled batches; classes weigh the same. Without both classes, all texts score 1/2 or the one label."""
    y = np.array(labels, dtype=np.float32)
    rng = np.random.default_rng(seed)
    p = _start(rng)
    p["embed"][0] = 0
    if not len(y) or y.min() == y.max():
        p["w3"][:] = 0
        p["b3"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return p
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    size, total = 32, epochs * -(-len(y) // 32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), size):
            own = order[i : i + size]
            g = _gradients(p, [texts[k] for k in own], y[own], weight[own])
            step += 1
            rate = 0.006 * (1 - step / (total + 1))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    return p


def pick(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], most: int) -> list[tuple[str, int]]:
    """(text, label) of at most rows[y] documents labelled y and of `most` characters, chosen by a hash of doc_id, never held-out ones.

    Only labelled ids that docs has with such a text count. Of several texts of an id the least is taken and of several
    labels the largest, so that as many rows as asked for, and no more, reach the driver, whatever repeats.
    """
    spark = docs.sparkSession
    mine = labels.select(labels["doc_id"], labels[label].cast("int").alias("y")).filter(F.col("y").isin(*rows) & F.col("doc_id").isNotNull() & ~common.held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    short = docs.select(docs["doc_id"], docs["text"]).filter(F.length("text") <= most)
    there = common.staged(mine.join(short.select("doc_id"), "doc_id", "left_semi"), "labelled")
    ids = [r for y, n in rows.items() for r in there.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    common.drop_staged(there)
    table = spark.createDataFrame(ids, "doc_id long, y int")
    own = short.join(F.broadcast(table), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # the sum of rows at most
    own.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [(r["text"], r["y"]) for y in rows for r in own if r["y"] == y]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    found = pick(docs, labels, "quality", {0: rows, 1: rows}, SAMPLE_CHARS)
    return fit([t.encode() for t, _ in found], [y for _, y in found])


def _scored(p: dict, batch: pa.RecordBatch, at: int) -> list[float]:
    out: list[float] = []
    texts = pa.compute.fill_null(batch.column(at), "").to_pylist()
    for a, b in common.blocks_of([len(t) for t in texts], 512 << 10):
        out += score(p, [t.encode() for t in texts[a:b]]).tolist()
    return out


def classify(docs: DataFrame, p: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null texts count as empty; an empty text is scored as padding alone. Rows are independent: repeated rows give
    repeated results, an empty table none. Very long texts are scored whole. Other columns are ignored.
    """
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(p, batch, 1), pa.float64())], names=["doc_id", "score"])
        common.give_back()

    found = common.slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", common.held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, p: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns.

    Null and empty texts are scored as padding alone, very long ones whole. Rows are independent, so ties and repeated
    rows stay or go together; an empty table stays empty.
    """
    common.ready(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s >= threshold for s in _scored(p, batch, at)], pa.bool_()))
        common.give_back()

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
