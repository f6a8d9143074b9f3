"""Language: binary n-gram classifiers for the bits of error-correcting codewords."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, blocks, held_out

#: Labelled documents that the classifiers learn from (in expectation), shared among the languages.
SAMPLE = 3000
ORDERS, BUCKET_BITS = (2, 3, 4), 16
#: Positions whose weights are gathered at once; bytes of the longest text that the classifiers learn from.
AT_ONCE, LEARN_BYTES = 1 << 18, 1 << 16
IS_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def codewords(languages: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each language: all ways to part up to five languages in two, else random parts of which
    the draw with the largest least distance between rows is taken."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        return np.array([[1 if k == 0 or way >> (k - 1) & 1 else -1 for way in range(2 ** (languages - 1) - 1)] for k in range(languages)])
    r, bits, best, widest = np.random.default_rng(seed), int(12 * np.log2(languages)), None, -1
    for _ in range(200):
        code = np.array([r.permutation(np.arange(languages) % 2) for _ in range(bits)]).T * 2 - 1
        gap = min(int((code[a] != code[b]).sum()) for a in range(languages) for b in range(a))
        if gap > widest:
            best, widest = code, gap
    return best


def ngrams(data: np.ndarray, places: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every run of `order` bytes inside a document, in lower case, and where each document's begin."""
    n = max(0, len(data) - order + 1)
    h = np.zeros(n, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) + data[k : k + n]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    inside = np.ones(n, bool)
    for k in range(1, order):
        cut = places[1:] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    begins = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(places) - order + 1))])
    return h[inside], begins


class LanguageCodes:
    """For each bit of the codewords a classifier: the mean log-odds of the document's n-grams between the languages
    with the bit and those without, over its usual size. Decoding takes the codeword of least loss, where each
    bit's logistic loss is weighed by how often that bit is right for that language."""

    def __init__(self, texts: list[bytes], labels: list[str]):
        self.languages = sorted(set(labels))
        self.code = codewords(len(self.languages))
        y = np.array([self.languages.index(x) for x in labels])
        size = 1 << BUCKET_BITS
        data, places = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        counts = np.zeros((len(ORDERS), len(self.languages), size))
        for o, order in enumerate(ORDERS):
            h, begins = ngrams(LOWER[data], places, order)
            for k, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
                if b > a:  # a document counts by the root of its length
                    counts[o, y[k]] += np.bincount(h[a:b], minlength=size) / np.sqrt(b - a)
        bits = self.code.shape[1]
        self.weights = np.zeros((len(ORDERS), size, -(-bits // 8) * 8), np.float32)
        for o in range(len(ORDERS)):
            share = (counts[o] + 0.05) / (counts[o] + 0.05).sum(axis=1, keepdims=True)
            for b in range(bits):
                if (self.code[:, b] > 0).all():
                    continue
                self.weights[o, :, b] = np.log(share[self.code[:, b] > 0].mean(axis=0) / share[self.code[:, b] < 0].mean(axis=0))
        self.usual, self.trust = np.ones(bits), np.ones(self.code.shape)
        margins = self.margins(data, places)
        self.usual = np.maximum(np.abs(margins).mean(axis=0), 1e-6)
        right = margins * self.code[y] > 0
        for k in range(len(self.languages)):
            self.trust[k] = right[y == k].mean(axis=0) + 1e-3
        self.trust /= self.trust.sum(axis=1, keepdims=True)

    def margins(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        total = np.zeros((len(places) - 1, self.weights.shape[2]))
        if len(places) == 2:  # one text, which may be long, in parts
            for o, order in enumerate(ORDERS):
                many = max(0, len(data) - order + 1)
                for low in range(0, many, AT_ONCE):
                    part = LOWER[data[low : min(low + AT_ONCE, many) + order - 1]]
                    total[0] += self.weights[o][ngrams(part, np.array([0, len(part)]), order)[0]].sum(axis=0, dtype=float) / many
            return total[:, : self.code.shape[1]] / self.usual
        data = LOWER[data]
        for o, order in enumerate(ORDERS):
            h, begins = ngrams(data, places, order)
            part = np.zeros_like(total)
            for low in range(0, len(h), AT_ONCE):
                high = min(len(h), low + AT_ONCE)
                a, b = int(np.searchsorted(begins, low, "right")) - 1, int(np.searchsorted(begins, high, "left"))
                cut = np.maximum(begins[a:b], low) - low
                some = np.flatnonzero(np.diff(np.append(cut, high - low)) > 0)
                part[a + some] += np.add.reduceat(self.weights[o][h[low:high]], cut[some], axis=0)
            total += part / np.maximum(1, np.diff(begins))[:, None]
        return total[:, : self.code.shape[1]] / self.usual

    def predict(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number, the share of likelihood that its codeword has, and whether the next one is near."""
        margins = self.margins(data, places)
        loss = np.stack([(np.logaddexp(0, -4 * margins * row) * trust).sum(axis=1) for row, trust in zip(self.code, self.trust)], axis=1)
        likely = np.exp(self.code.shape[1] * (loss.min(axis=1, keepdims=True) - loss))
        likely /= likely.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(likely, axis=1)
        unclear = top[:, -1] < 2 * top[:, -2] if top.shape[1] > 1 else np.zeros(len(best), bool)
        return best, likely.max(axis=1), unclear


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageCodes | None:
    """Classifiers learned from at most sample documents in expectation, an equal share of each value of lang_col,
    chosen by a hash of their ids. Null ids, texts and languages, held-out ids and texts of more than LEARN_BYTES
    teach nothing; None if none is left."""
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    told = told.where(F.octet_length("text") <= LEARN_BYTES).where("id is not null and text is not null and lang is not null").where(~held_out("id"))
    counts = {r["lang"]: r["n"] for r in told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = docs.sparkSession.createDataFrame([(k, sample / len(counts) / n) for k, n in counts.items()], "of string, share double")
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    rows = told.join(F.broadcast(share), (F.col("lang") == F.col("of")) & (unit < F.col("share"))).select("id", "text", "lang").toArrow()
    rows = sorted(zip(rows["id"].to_pylist(), rows["lang"].to_pylist(), rows["text"].to_pylist()))
    return LanguageCodes([r[2].encode() for r in rows], [r[1] for r in rows]) if rows else None


def predicted_languages(docs: DataFrame, model: LanguageCodes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs. A null text, one without a letter, and any text if
    there is no model get und, score 0 and are not ambiguous. Ids may be null or repeat; each row is read by
    itself. An empty table gives an empty one. Other columns, of any name, play no part."""

    def work(batches):
        for rows, data, places in blocks(batches, "text"):
            n = rows.num_rows
            ascii_letters = np.concatenate([[0], np.cumsum(IS_ASCII_LETTER[data])])[places]
            letters = np.diff(ascii_letters) > 0
            for k in np.flatnonzero(~letters & (np.diff(places) > 0)).tolist():
                letters[k] = any(map(str.isalpha, rows.column("text")[k].as_py()))
            names, score, unclear = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if model and letters.any():
                best, likely, near = model.predict(data, places)
                names[letters] = np.array(model.languages, object)[best[letters]]
                score, unclear = np.where(letters, likely, 0), near & letters
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(unclear)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, ambiguous boolean")
