"""Language-model scores: marginal probability over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks, held_out, stored
from loomgraph.llm.lattice import Pieces, WordLattice, read_pieces

#: Words of at least one HEAD-th of all training tokens, so HEAD at most, have their counts sent to every task.
HEAD = 500_000
ROUNDS = 2
#: Words whose scores a worker remembers, and the bytes of the longest of them.
MEMO, LONGEST_KNOWN = 500_000, 64


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[Pieces, np.ndarray, np.ndarray, int]:
    spelled, scores, kinds, made = read_pieces(path)
    return Pieces(spelled, kinds), scores, kinds, made


@lru_cache(maxsize=1)
def known_words(fit: str) -> dict[bytes, float]:
    """The scores that a worker's tasks have found under one fit."""
    return {}


def first_weights(path: str) -> np.ndarray:
    """log p of each piece from the file's scores: a unigram model's are logarithms already; others give an order, in
    which the k-th piece weighs 1 / (k + 1). The fallback's bytes share a thousandth."""
    _, scores, kinds, made = vocabulary(path)
    p = np.zeros(len(scores))
    text = kinds == 0
    if made == 1:
        p[text] = np.exp(scores[text])
    else:
        p[text] = 1 / (1 + np.argsort(np.argsort(-scores[text], kind="stable")) + 1)
    p[text] /= p[text].sum() or 1
    p[kinds == 1] = 1e-3 / 256
    p[kinds == 2] = 1e-3
    with np.errstate(divide="ignore"):
        return np.log(p / p.sum())


def marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, each after a blank: the bytes, where each starts, its size with the blank."""
    size = np.array([len(w) for w in words], np.int64) + 1
    return np.frombuffer(b"".join([b" " + w for w in words]), np.uint8), np.cumsum(size) - size, size


def words_of(data: np.ndarray, places: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words of a block's texts (splitting bytes at white space is splitting at 0x20 and 0x09 to 0x0D), letters A to Z
    in lower case; and how many each text has."""
    raw = data.tobytes().lower()
    by_text = [raw[a:b].split() for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
    return list(chain.from_iterable(by_text)), np.array([len(w) for w in by_text], np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of docs (text) is there."""

    def work(batches):
        for _, data, places in blocks(batches, "text", 2 << 20):
            counts = Counter(words_of(data, places)[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, texts: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """log p of each piece after so many rounds of expectation and maximization over all words of counts, from the
    file's own weights. Each task sums what it expects of each piece; the sums, one number a piece, meet in a
    group-by and are all that the driver sees."""
    log_p = first_weights(path)
    _, _, kinds, _ = vocabulary(path)
    for _ in range(rounds):

        def work(batches, log_p=log_p):
            pieces = vocabulary(path)[0]
            total = np.zeros(len(log_p))
            lattice = WordLattice(pieces, log_p)
            for rows, _, _ in blocks(batches, "word", 1 << 20):
                out, at, size = marked(rows.column("word").to_pylist())
                total += lattice.expected(out, at, size, rows.column("n").to_numpy().astype(float))
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["piece", "n"])

        found = counts.select("word", "n").mapInArrow(work, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.where(kinds <= 1, 0.01, 0.0)
        for r in found:
            n[r["piece"]] += r["n"]
        n[kinds == 2] = texts + 0.01
        with np.errstate(divide="ignore"):
            log_p = np.log(n / n.sum())
    return log_p


def language_scores(docs: DataFrame, path: str, parts: int = 7, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """For every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words in lower case and one end. The rows that are not held out give the words' counts
    and, over all distinct words, the pieces' probabilities. base_score adds one to every count. score is
    log10 of the text's marginal probability: each word, after a word mark, is summed over all its
    segmentations by forward recursion, and the end follows. Counts of frequent words go to every task; the
    others meet their texts in a join on the word itself, where no key is frequent. The pieces' weights are
    learned: the file's scores are the first weights, which `rounds` of expectation and maximization refine.

    A null text is an empty one, of an end alone. A null id is not held out. Rows that repeat an id are scored
    one by one. Without training rows all counts are 0 and the pieces keep the file's weights; an empty table
    gives an empty one. Other columns, of any name, play no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col, parts).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = stored(word_counts(training), "word-counts")
    texts = training.count()
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, distinct = n + texts, distinct + (texts > 0)
    log_p = fit_pieces(counts, texts, path, rounds) if texts else first_weights(path)
    head = counts.where(F.col("n") * HEAD >= n).toArrow()
    frequent = dict(zip(head["word"].to_pylist(), np.log10(head["n"].to_numpy() + 1.0).tolist()))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent)  # HEAD words at most
    fit = uuid.uuid4().hex
    end_p = log_p[vocabulary(path)[2] == 2].max(initial=-np.inf)

    def work(batches):
        lattice, task, row = WordLattice(vocabulary(path)[0], log_p), TaskContext.get().partitionId(), 0
        known, head, none = known_words(fit), frequent.value, repeat(np.nan)
        for batch, data, places in blocks(batches, "text"):
            words, size = words_of(data, places)
            many = batch.num_rows
            doc = np.repeat(np.arange(many), size)
            new = list(set(words).difference(known))
            if len(known) + len(new) > MEMO:
                known.clear()
                new = list(set(words))
            if new:
                known.update(zip(new, lattice.forward(*marked(new)).tolist()))
            value = np.fromiter(map(known.__getitem__, words), float, len(words))
            for w in [w for w in new if len(w) > LONGEST_KNOWN]:
                del known[w]
            logs = np.fromiter(map(head.get, words, none), float, len(words))
            rare = np.isnan(logs)
            there = ~rare
            others = list(compress(words, rare.tolist()))
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=many))]).tolist()
            tail = [Counter(others[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tail])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((task << 40) + row + np.arange(many)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(size + 1),
                    pa.array(np.bincount(doc[there], minlength=many)),
                    pa.array(np.bincount(doc[there], logs[there], many).astype(float)),  # of nothing, bincount makes integers
                    pa.array((np.bincount(doc, value, many) + end_p) / np.log(10)),
                    pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(tail)), pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(t.values() for t in tail)), pa.int32())),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "tail", "times"],
            )
            row += many

    scored = rows.mapInArrow(work, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, tail array<binary>, times array<int>")
    scored = stored(scored, "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    tail = tail.join(counts.where(F.col("n") * HEAD < n), "word")
    tail = tail.groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_logs"))
    ends = float(np.log10(texts + 1.0))
    each = float(np.log10(n + distinct + 1.0))
    return scored.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) + F.lit(ends) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
    )
