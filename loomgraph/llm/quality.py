"""Quality: a byte-level convolutional network over overlapping chunks of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.llm.common import blocks, free, held_out

#: Labelled documents that the network learns from, half of each label (in expectation).
SAMPLE = 3000
CHUNK, OVERLAP = 512, 64
#: A byte that begins a string of eight which also begins up to LAGS bytes before has a symbol of its own.
LAGS = 32
PAD = 512
#: Chunks of one text that are worked on at once; bytes of the longest text that the network learns from.
AT_ONCE, LEARN_BYTES = 2048, 1 << 16


def symbols(data: np.ndarray, places: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """Every byte, plus 256 where it begins a string that repeats one close before, in the same document."""
    n = len(data)
    out = data.astype(np.int16)
    inside = np.arange(n) - np.repeat(places[:-1], np.diff(places))
    left = np.repeat(places[1:], np.diff(places)) - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    strings = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(np.uint64).reshape(n) if n else np.zeros(0, np.uint64)
    for low in range(0, n, at_once):
        here, depth = strings[low : low + at_once], inside[low : low + at_once]
        again = np.zeros(len(here), bool)
        for lag in range(1, LAGS + 1):
            skip = max(0, lag - low)
            if skip >= len(here):
                break
            again[skip:] |= (here[skip:] == strings[low + skip - lag : low + len(here) - lag]) & (depth[skip:] >= lag)
        out[low : low + at_once] += 256 * (again & (left[low : low + at_once] >= 8))
    return out


class ByteConvNet:
    """Bytes, told apart by whether they repeat what is close before, are embedded; filters of eight bytes, four
    apart, run over chunks of CHUNK bytes that overlap by OVERLAP; each filter's highest value in a chunk
    is kept; a document's features are the highest and the mean of these over all its chunks and the
    logarithm of its length; one weighted sum of them makes the logit."""

    DIMS, STRIDE = 8, 4

    def __init__(self, filters: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.filters = filters
        self.p = {
            "embed": r.normal(0, 0.5, (PAD + 1, self.DIMS)).astype(f32),
            "conv": r.normal(0, 0.18, (2 * self.STRIDE * self.DIMS, filters)).astype(f32),
            "bias": np.zeros(filters, f32),
            "out": r.normal(0, 0.1, 2 * filters + 1).astype(f32),
            "c": np.zeros(1, f32),
        }
        self.p["embed"][PAD] = 0

    @staticmethod
    def chunks(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each chunk starts, its bytes inside the document, and which chunk each document begins with."""
        step = CHUNK - OVERLAP
        size = np.diff(places)
        many = np.maximum(1, -(-(size - OVERLAP) // step))
        first = np.concatenate([[0], np.cumsum(many)])
        start = np.repeat(places[:-1], many) + (np.arange(first[-1]) - np.repeat(first[:-1], many)) * step
        return start, np.minimum(CHUNK, np.repeat(places[1:], many) - start), first

    def codes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = start[:, None] + np.arange(CHUNK)
        inside = np.arange(CHUNK) < size[:, None]
        return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, PAD)

    def convolve(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Every filter at every position of every chunk; minus infinity past the document's end."""
        m, parts = len(codes), CHUNK // self.STRIDE
        grouped = self.p["embed"][codes].reshape(m * parts, self.STRIDE * self.DIMS)
        half = self.STRIDE * self.DIMS
        a = (grouped @ self.p["conv"][:half]).reshape(m, parts, -1)
        b = (grouped @ self.p["conv"][half:]).reshape(m, parts, -1)
        out = a[:, :-1] + b[:, 1:] + self.p["bias"]
        out[np.arange(parts - 1) * self.STRIDE >= np.maximum(size, 1)[:, None]] = -np.inf
        return out

    def pooled(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, at_once: int = 128) -> np.ndarray:
        out = np.empty((len(start), self.filters), np.float32)
        for k in range(0, len(start), at_once):
            s = slice(k, k + at_once)
            out[s] = np.maximum(self.convolve(self.codes(data, start[s], size[s]), size[s]).max(axis=1), 0)
        return out

    @staticmethod
    def features(pooled: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
        many, size = np.diff(first)[:, None], np.log1p(np.diff(places))[:, None] / 5
        return np.hstack([np.maximum.reduceat(pooled, first[:-1]), np.add.reduceat(pooled, first[:-1]) / many, size])

    def scores(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        start, size, first = self.chunks(data, places)
        if len(places) > 2:
            pooled = self.pooled(symbols(data, places), start, size)
        else:  # one text, which may be long: some chunks at a time, with the bytes around that their symbols depend on
            pooled = np.empty((len(start), self.filters), np.float32)
            for k in range(0, len(start), AT_ONCE):
                s = slice(k, k + AT_ONCE)
                low, high = max(0, int(start[k]) - LAGS), int((start[s] + size[s]).max()) + 8
                part = data[low:high]
                pooled[s] = self.pooled(symbols(part, np.array([0, len(part)])), start[s] - low, size[s])
        logit = self.features(pooled, first, places).astype(np.float64) @ self.p["out"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 4e-3, decay: float = 1e-4) -> ByteConvNet:
        """Adam on the weighted cross-entropy; each step runs over all chunks of its documents."""
        r = np.random.default_rng(11)
        p, half = self.p, self.STRIDE * self.DIMS
        coded = [symbols(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(batch, len(texts)):
                order = r.permutation(len(texts))
            now, order = order[:batch], order[batch:]
            data = np.concatenate([coded[k] for k in now])
            places = np.concatenate([[0], np.cumsum([len(coded[k]) for k in now])])
            start, size, first = self.chunks(data, places)
            pooled, where, windows = [], [], []
            for k in range(0, len(start), 128):
                s = slice(k, k + 128)
                codes = self.codes(data, start[s], size[s])
                out = self.convolve(codes, size[s])
                top = out.argmax(axis=1)
                pooled.append(np.maximum(np.take_along_axis(out, top[:, None], 1)[:, 0], 0))
                windows.append(codes[np.arange(len(codes))[:, None, None], top[:, :, None] * self.STRIDE + np.arange(2 * self.STRIDE)])
            pooled, windows = np.concatenate(pooled), np.concatenate(windows)
            z = self.features(pooled, first, places).astype(np.float32)
            logit = z @ p["out"] + p["c"]
            slope = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[now]) * weights[now] / weights[now].sum()).astype(np.float32)
            dz = slope[:, None] * p["out"]
            doc = np.repeat(np.arange(len(now)), np.diff(first))
            dpool = dz[doc, self.filters : 2 * self.filters] / np.diff(first)[doc][:, None]
            is_top = pooled == z[doc, : self.filters]
            dpool += dz[doc, : self.filters] * is_top / np.maximum(1, np.add.reduceat(is_top.astype(np.float32), first[:-1]))[doc]
            dpool *= pooled > 0
            seen = p["embed"][windows].reshape(len(windows), self.filters, 2 * half)
            dembed = np.zeros_like(p["embed"])
            np.add.at(dembed, windows, (dpool[:, :, None] * p["conv"].T).reshape(*windows.shape, self.DIMS))
            dembed[PAD] = 0
            g = {"embed": dembed, "conv": np.einsum("mf,mfd->df", dpool, seen), "bias": dpool.sum(0), "out": slope @ z, "c": slope.sum(keepdims=True)}
            for k, v in p.items():
                one, two = moments[k]
                grad = g[k] + decay * v
                one += 0.1 * (grad - one)
                two += 0.01 * (grad * grad - two)
                v -= rate * (1 - 0.7 * step / steps) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> ByteConvNet | float:
    """A network that learned label_col (0 or 1) from at most sample documents in expectation, chosen by a
    hash of their ids, half of each label; weights restore the labels' shares. Rows whose id is held out,
    null labels, other values and texts of more than LEARN_BYTES teach nothing (all are scored). Without documents of both labels there is nothing to
    tell apart: the result is the score that all get, 1 where no row is labelled 0, else 0."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    told = told.groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return 0.0 if 0 in counts else 1.0
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    chosen = told.where(unit < F.when(F.col("label") == 0, F.lit(sample / 2 / counts[0])).otherwise(F.lit(sample / 2 / counts[1])))
    # at most about `sample` ids
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= LEARN_BYTES).join(F.broadcast(chosen), "id").select("id", "text", "label").toArrow()
    rows = sorted(zip(rows["id"].to_pylist(), rows["label"].to_pylist(), rows["text"].to_pylist()))
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return 0.0 if 0 in y else 1.0
    weights = np.where(y == 0, counts[0] / (y == 0).sum(), counts[1] / (y == 1).sum()).astype(np.float32)
    return ByteConvNet().fit([r[2].encode() for r in rows], y, weights / weights.mean())


def quality_scores(docs: DataFrame, model: ByteConvNet | float, id_col: str = "doc_id", text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """docs with a column score_col, the probability of label 1 for the whole text; a null text scores as an
    empty one, a row of a null or repeated id by itself, and an empty table gives an empty one. All other columns
    of docs stay, whatever their names; one named score_col gives way."""
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    docs = docs.select(*(docs[c] for c in names))

    def work(batches):
        for rows, data, places in blocks(batches, text_col):
            scores = model.scores(data, places) if isinstance(model, ByteConvNet) else np.full(rows.num_rows, model)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], [*rows.schema.names, score_col])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without those whose score is below threshold; the columns stay as they are. Each row is judged by its own text
    (a null one as an empty one), whatever its id."""
    score = free(docs.columns, "__score")
    return quality_scores(docs, fit_quality(docs, labels), text_col=text_col, score_col=score).where(F.col(score) >= threshold).drop(score)
