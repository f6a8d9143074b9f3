"""Repeated substrings: common prefixes from a Burrows-Wheeler transform, in increasing order up to a threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.llm.common import as_long, blocks, ByteSums, free, run_hashes, stored

#: Bytes of an anchor.
ANCHOR = 32
#: No byte of UTF-8 text: parts the contexts of a block.
SEPARATOR = 0xFF
#: Bytes of contexts that one transform is made of, and distinct contexts of an anchor that go to one.
BLOCK, GROUP = 1 << 19, 1000
#: Bytes of the anchors, one after the other, by which the contexts of an anchor of more distinct ones meet again.
FINER = (64, 82, 91)
#: Bytes of text whose contexts are found at once.
SEGMENT = 1 << 19
#: Anchors are salted if a sample of one document in SAMPLED has them this often; at most HOT of them.
SAMPLED, HOT_COUNT, HOT, SALTS = 64, 50, 4096, 64


def slid(least: Callable, values: np.ndarray, width: int, fill) -> np.ndarray:
    """least (np.minimum or np.maximum) over every run of width values, from running values of blocks of that width."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, fill, values.dtype)]).reshape(-1, width)
    ahead = least.accumulate(rows, axis=1).reshape(-1)
    back = least.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return least(back[: n - width + 1], ahead[width - 1 : n])


@lru_cache(maxsize=1)
def byte_sums() -> ByteSums:
    return ByteSums(3)


class Contexts:
    """The strings of `length` bytes of a block of texts, grouped by their anchors.

    A string's anchor is its `anchor` bytes of least hash, so equal strings have equal anchors wherever
    they are. Consecutive strings of one anchor make a context, the bytes that they cover. Two strings
    can only be equal if their contexts have one anchor; equal contexts hold equal strings in the same
    places.
    """

    def __init__(self, data: np.ndarray, places: np.ndarray, length: int, most: int = 1 << 15, anchor: int = ANCHOR):
        none = np.zeros(0, np.int64)
        self.start = self.size = self.doc = none
        self.anchor = self.content = none.astype(np.uint64)
        self.self_like = none.astype(bool)
        n, width = len(data) - length + 1, length - anchor + 1
        if n <= 0:
            return
        hashes = byte_sums()
        sums = hashes.sums(data)
        m = len(data) - anchor + 1
        key = (sums[anchor:] - sums[:m]) * hashes.down[:m] * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
        least = slid(np.minimum, key, width, np.uint64(2**64 - 1))
        edge = places[1:-1]  # strings across these are in no document
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.clip(edge - length + 1, 0, n), 1)
        np.add.at(near, np.clip(edge, 0, n), -1)
        whole = np.cumsum(near[:n]) == 0
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= ~whole[:-1]
        new &= whole
        first = np.flatnonzero(new)
        if not len(first):
            return
        last = np.empty(n, bool)
        last[-1] = True
        last[:-1] = new[1:] | ~whole[1:]
        last &= whole
        end = np.flatnonzero(last) + 1
        if (end - first).max() > most:  # a long run of one anchor is cut: that changes no string's anchor
            many = -(-(end - first) // most)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            end = np.minimum(np.repeat(end, many), np.repeat(first, many) + (nth + 1) * most)
            first = np.repeat(first, many) + nth * most
        # anchors that come twice in a context: only there can a context repeat strings of its own
        minima = np.concatenate([np.full(width - 1, 0, np.uint64), least, np.full(width - 1, 0, np.uint64)])
        at = np.flatnonzero(slid(np.maximum, minima, width, np.uint64(0)) == key)
        a, b = np.searchsorted(at, first), np.searchsorted(at, end + width - 1)
        own = np.repeat(np.arange(len(first)), b - a)
        where = at[np.arange(len(own)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[own]]
        alike = np.bincount(own[key[where] == least[first][own]], minlength=len(first))
        self.self_like = alike > 1
        self.doc = np.searchsorted(places, first, "right") - 1
        self.start, self.size = first - places[self.doc], end - first + length - 1
        self.anchor = least[first]
        raw, cut = data.tobytes(), zip(first.tolist(), (first + self.size).tolist())
        self.content = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in cut]), np.uint64)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first depth bytes or more, by doubling; and how many of the first eight
    bytes each shares with the one before."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    ranked = key[order]
    differ = ranked[1:] ^ ranked[:-1]
    shared = np.full(n, 0, np.int64)
    shared[1:] = 8
    for k in range(8):  # the highest differing byte decides
        shared[1:][(differ >> np.uint64(8 * k)) > 0] = 7 - k
    done = 8
    while True:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])).astype(np.uint64)
        if done >= depth or int(rank[order[-1]]) == n:
            return order, shared
        after = np.zeros(n, np.uint64)
        after[: n - done] = rank[done:]
        key = (rank << np.uint64(32)) | after
        order = np.argsort(key)
        ranked = key[order]
        done *= 2


def prefixes_below(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of text, and for each place in it whether the suffix shares fewer than `length` bytes
    with the one before (strings with SEPARATOR are not followed, and count as sharing all).

    The transform's intervals of strings of eight bytes come from the packed sort. Then, string length by
    string length, the intervals found last are extended backward by each byte before their suffixes;
    where the suffix after an extended interval has no value yet, it differs there for the first time.
    Intervals that give no new value are not followed, so that each place is visited once. The search
    ends at the minimum length: what has no value then shares that many bytes at least.
    """
    order, shared = suffix_order(text, length)
    n = len(text)
    before = text[order - 1]  # the transform
    by_byte = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)  # each row's suffix, one byte longer
    to[by_byte] = np.arange(n)
    same = before[by_byte][1:] == before[by_byte][:-1]
    following = np.full(n, n, np.int64)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    leading = np.full(n, -1, np.int64)
    leading[by_byte[1:][same]] = by_byte[:-1][same]
    seed = min(8, length)
    found = np.append(shared < seed, True)
    low = np.flatnonzero(found[:-1])
    high = np.append(low[1:], n)
    for _ in range(seed, length):
        if not len(low):
            break
        one = high - low == 1
        single = low[one]
        single = to[single[before[single] != SEPARATOR]]
        low, high = low[~one], high[~one]
        size = high - low
        rows = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(low)), size)
        kept = before[rows] != SEPARATOR
        rows, owner = rows[kept], owner[kept]
        first = rows[leading[rows] < low[owner]]
        name = owner[leading[rows] < low[owner]] * 256 + before[first]
        ends = following[rows] >= high[owner]
        last = rows[ends]
        name_last = owner[ends] * 256 + before[last]
        low = np.concatenate([single, to[first[np.argsort(name, kind="stable")]]])
        high = np.concatenate([single, to[last[np.argsort(name_last, kind="stable")]]]) + 1
        new = ~found[high]
        low, high = low[new], high[new]
        found[high] = True
    return order, found[:n]


def repeated_in(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For contexts in the order of their places in the corpus: which of each one's strings of `length` bytes come
    before it too, in an earlier context or earlier in itself."""
    size = np.array([len(c) for c in contexts])
    text = np.frombuffer(bytes([SEPARATOR]).join(contexts) + bytes([SEPARATOR]), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    order, parts = prefixes_below(text, length)
    left = np.zeros(len(text), np.int64)  # bytes to the separator
    left[:] = np.repeat(begin + size, size + 1) - np.arange(len(text))
    valid = left[order] >= length
    run = np.cumsum(parts)
    rows, runs = order[valid], run[valid]
    again = np.zeros(len(text), bool)
    if len(rows):
        starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        least = np.minimum.reduceat(rows, starts)
        again[rows] = rows != np.repeat(least, np.diff(np.append(starts, len(rows))))
    return [again[b : b + s - length + 1] for b, s in zip(begin.tolist(), size.tolist())]


def spans_of(again: np.ndarray, start: int, length: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield start + a, start + b - 1 + length


def contexts_of(docs: DataFrame, length: int) -> DataFrame:
    """h, c (anchor and content), doc_id, start, size, own: every context; own if it may repeat strings of its own."""

    def work(batches):
        for rows, data, places in blocks(batches, "text", SEGMENT):
            # a longer text comes alone, and in parts that share no string
            for low in range(0, max(1, len(data) - length + 1), SEGMENT if len(places) == 2 else len(data) + 1):
                part = data[low : low + SEGMENT + length - 1] if len(places) == 2 else data
                found = Contexts(part, np.array([0, len(part)]) if len(places) == 2 else places, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(as_long(found.anchor)),
                        pa.array(as_long(found.content)),
                        rows.column("doc_id").take(pa.array(found.doc)),
                        pa.array(low + found.start),
                        pa.array(found.size.astype(np.int32)),
                        pa.array(found.self_like),
                    ],
                    ["h", "c", "doc_id", "start", "size", "own"],
                )

    return docs.mapInArrow(work, "h long, c long, doc_id long, start long, size int, own boolean")


def with_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text and the list of wanted contexts (h, start, size) of each document that has any."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "size")).alias("wanted")).withColumnRenamed("doc_id", "id")
    return docs.join(lists, docs["doc_id"] == lists["id"]).select("doc_id", "text", "wanted")


def bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, doc_id, start, bytes of each wanted context."""

    def work(batches):
        for rows, data, places in blocks(batches, "text"):
            out: list[tuple] = []
            for doc_id, at, end, contexts in zip(rows.column("doc_id").to_pylist(), places.tolist(), places[1:].tolist(), rows.column("wanted").to_pylist()):
                there = (x for x in contexts if at + x["start"] + x["size"] <= end)  # an id may have several texts
                out.extend((x["h"], doc_id, x["start"], data[at + x["start"] : at + x["start"] + x["size"]].tobytes()) for x in there)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["h", "doc_id", "start", "bytes"])

    return with_wanted(docs, wanted).mapInArrow(work, "h long, doc_id long, start long, bytes binary")


def finer_contexts(contexts: DataFrame, length: int, anchor: int) -> DataFrame:
    """h, c, doc_id, start, size, own, bytes: as contexts_of, of the strings of contexts (doc_id, start, bytes), by anchors of that many bytes."""

    def work(batches):
        for rows, data, places in blocks(batches, "bytes", SEGMENT):
            found = Contexts(data, places, length, anchor=anchor)
            raw, at = data.tobytes(), places[found.doc] + found.start
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(found.anchor)),
                    pa.array(as_long(found.content)),
                    rows.column("doc_id").take(pa.array(found.doc)),
                    pa.array(rows.column("start").to_numpy()[found.doc] + found.start),
                    pa.array(found.size.astype(np.int32)),
                    pa.array(found.self_like),
                    pa.array([raw[a:b] for a, b in zip(at.tolist(), (at + found.size).tolist())], pa.binary()),
                ],
                ["h", "c", "doc_id", "start", "size", "own", "bytes"],
            )

    return contexts.select("doc_id", "start", "bytes").mapInArrow(work, "h long, c long, doc_id long, start long, size int, own boolean, bytes binary")


def met_apart(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of finer contexts, without bringing those of an anchor together: those that an equal one comes before, and of the others
    (h, doc_id, start, bytes, n: distinct contexts of the anchor) those that may share strings."""
    alike = ["h", "c", "size"]
    first = found.groupBy(*alike).agg(F.min(F.struct("doc_id", "start", "bytes")).alias("first"), F.max("own").alias("own"))
    places = first.select(*alike, F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    later = found.drop("bytes").join(places, alike).where("doc_id != first_doc or start != first_start")
    n = first.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    distinct = first.join(n, "h").where("n > 1 or own")
    return later, distinct.select("h", "first.doc_id", "first.start", "first.bytes", "n")


def strings_of(contexts: DataFrame, length: int) -> DataFrame:
    """a, b (a name of 128 bits), doc_id, start of each string of contexts (doc_id, start, bytes)."""

    def work(batches):
        for rows, data, places in blocks(batches, "bytes", SEGMENT):
            many = np.diff(places) - length + 1
            row = np.repeat(np.arange(len(many)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            a, b = string_names(data, places[row] + nth, length)
            doc_id, start = rows.column("doc_id").take(pa.array(row)), rows.column("start").to_numpy()[row] + nth
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), doc_id, pa.array(start)], ["a", "b", "doc_id", "start"])

    return contexts.select("doc_id", "start", "bytes").mapInArrow(work, "a long, b long, doc_id long, start long")


def spans_among(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, start, end: what repeats among the contexts (h, doc_id, start, bytes) of each anchor."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        out = []
        h, doc, at = (rows[c].to_numpy() for c in ("h", "doc_id", "start"))
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])  # of rows that repeat an id
        rows = rows.filter(pa.array(np.concatenate([[True], ~again])))
        for doc_id, start, again in zip(rows["doc_id"].to_pylist(), rows["start"].to_pylist(), repeated_in(rows["bytes"].to_pylist(), length)):
            out.extend((doc_id, a, b) for a, b in spans_of(again, start, length))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["doc_id", "start", "end"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            edges = np.flatnonzero(h[1:] != h[:-1]) + 1  # whole groups; the last may go on
            taken = np.cumsum(pc.binary_length(rows["bytes"]).to_numpy())
            done = 0
            for edge in edges.tolist():
                if taken[edge - 1] - (taken[done - 1] if done else 0) >= BLOCK or edge == edges[-1]:
                    yield spans(rows.slice(done, edge - done))
                    done = edge
            held = rows.slice(done).to_batches()
            size = rows.slice(done)["bytes"].nbytes if done else size
        if held:
            yield spans(pa.Table.from_batches(held))

    rows = contexts.repartition("h").sortWithinPartitions("h", "doc_id", "start")
    return rows.mapInArrow(work, "doc_id long, start long, end long")


def string_names(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the string of `length` bytes at each start: the hashes of its bytes and of their complements."""
    return tuple(as_long(run_hashes(x, start, start + length, 1 << 16)) for x in (data, ~data))


def spans_by_string(strings: DataFrame, length: int) -> DataFrame:
    """The same for single strings (a, b: their 128-bit hash, doc_id, start), without bringing them together."""
    first = strings.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = strings.join(first, ["a", "b"])
    at = later.where("doc_id = least").groupBy("a", "b").agg(F.min("start").alias("at"))
    later = later.join(at, ["a", "b"]).where("doc_id > least or start > at")
    return later.select("doc_id", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """doc_id, start, end: spans (they may overlap) of docs (doc_id, text) that together cover every string of
    `length` bytes which also starts earlier, in a smaller doc_id or earlier in the same one, and no more.

    Contexts meet by anchor, an anchor that a sample shows to be frequent in salted groups first. Of equal
    contexts, all but the first are covered whole. What is left are distinct contexts of one anchor;
    their bytes are fetched, and the transform finds the strings that they share. Where an anchor has more
    than `group` distinct contexts, their strings take longer anchors (FINER) and meet as contexts of these. What has as many
    contexts under the longest anchor meets string by string, by hash and pre-aggregated, dealt over all
    tasks. Contexts are held equal if anchor, a BLAKE2b hash of the bytes and size are.
    """
    found = contexts_of(docs, length)
    sample = contexts_of(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0), length)
    hot = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {HOT_COUNT}").orderBy(F.desc("n"), "h").limit(HOT).select("h", F.lit(True).alias("hot"))
    found = found.join(F.broadcast(hot), "h", "left")  # HOT rows at most
    found = found.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)))

    def first_of_equal(rows: DataFrame, *by: str) -> DataFrame:
        """later: an equal context starts earlier; one: the row stands for all equal ones."""
        equal = Window.partitionBy("h", "c", "size", *by).orderBy("doc_id", "start")
        return rows.withColumn("later", F.rank().over(equal) > 1).withColumn("one", F.row_number().over(equal) == 1)

    in_group = Window.partitionBy("h", "salt")
    # dealt by group once, which serves both windows
    met_once = first_of_equal(found.repartition("h", "salt"), "salt").withColumn("n", F.sum(F.col("one").cast("long")).over(in_group))
    met_once = stored(met_once.where("later or hot or n > 1 or own").drop("salt"), "contexts")
    # of a hot anchor, each salt has sent one of equal contexts; their numbers are added up, never brought together
    met_twice = stored(first_of_equal(met_once.where("hot and not later").drop("later", "one", "n")), "hot-contexts")
    many = met_twice.where("one").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    met_twice = met_twice.join(F.broadcast(many), "h", "left")  # HOT rows at most
    covered = met_once.where("later").unionByName(met_twice.where("later"))
    distinct = met_once.where("hot is null").unionByName(met_twice).where("one and (n > 1 or own)")
    distinct = stored(distinct.select("h", "doc_id", "start", "size", "n"), "distinct-contexts")
    spans = covered.select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))
    few = bytes_of(docs, distinct.where(F.col("n") <= group))
    spans = spans.unionAll(spans_among(few, length))
    many = distinct.where(F.col("n") > group)
    if not many.isEmpty():
        many = stored(bytes_of(docs, many), "many-contexts")
        for anchor in FINER:
            if anchor >= length:
                break
            covered, distinct = met_apart(stored(finer_contexts(many, length, anchor), "finer-contexts"))
            distinct = stored(distinct, "distinct-contexts")
            spans = spans.unionAll(covered.select("doc_id", "start", (F.col("start") + F.col("size")).alias("end")))
            spans = spans.unionAll(spans_among(distinct.where(F.col("n") <= group).drop("n"), length))
            many = distinct.where(F.col("n") > group)
        spans = spans.unionAll(spans_by_string(stored(strings_of(many, length), "strings"), length))
    return spans


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, names: tuple[str, str, str] = ("__kept", "__text", "__spans")) -> DataFrame:
    """docs with three more columns, of these names: __kept, the bytes of the text that are left; __text, these as text,
    without what is left of a character that was cut; and __spans, the maximal runs (start, end) of bytes
    that went, since a string of `length` bytes that also starts earlier covers them.

    Earlier means in a smaller id, or before it in the same text; all is judged on the input. A null text
    is an empty one. A row with a null id is left whole and is no earlier place of anything. Rows that
    repeat an id and its text are one document; under an id with several texts, spans found in any are
    cut from all. An empty table gives an empty one. All other columns of docs stay, whatever their names; ones of these three give way.
    """
    kept_col, left_col, spans_col = names
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    docs = docs.select(*(docs[c] for c in own))
    id_of_lists = free([*own, *names], "__id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    spans = repeated_spans(rows, length, group)
    lists = stored(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias(spans_col)), "spans").withColumnRenamed("doc_id", id_of_lists)
    types = StructType([*docs.schema.fields, *StructType.fromDDL(f"{kept_col} binary, {left_col} string, {spans_col} array<struct<start: bigint, end: bigint>>").fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for rows, data, places in blocks(batches, text_col):
            kept, spans = [], []
            for k, cut in enumerate(rows.column(spans_col).to_pylist()):
                text = data[places[k] : places[k + 1]]
                runs: list[dict] = []
                for x in sorted(cut or (), key=lambda x: x["start"]):
                    end = min(x["end"], len(text))
                    if runs and x["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], end)
                    elif x["start"] < end:
                        runs.append({"start": x["start"], "end": end})
                edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                spans.append(runs)
            columns = [rows.column(n) for n in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array([b.decode("utf-8", "ignore") for b in kept]), pa.array(spans, span_type)], [*own, *names])

    return docs.join(lists, docs[id_col] == lists[id_of_lists], "left").select(*(docs[n] for n in own), spans_col).mapInArrow(work, types)


def text_without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of the text (and what they leave of a cut character), the columns as they are."""
    names = tuple(free(docs.columns, n) for n in ("__kept", "__text", "__spans"))
    cleaned = without_repeats(docs, length, id_col, text_col, names=names)
    return cleaned.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(names[1]))).drop(*names)
