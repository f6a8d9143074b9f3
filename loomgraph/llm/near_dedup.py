"""Near duplicates: circulant MinHash, banding, and exact Jaccard on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, as_long, blocks, mixed, run_hashes, stored, words
from loomgraph.operators.components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Places that the first permutation deals shingles to.
UNIVERSE = 1 << 20


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.factors = np.random.default_rng(2).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, data: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        start, end, before = words(data, places)
        h = run_hashes(LOWER[data], start, end)
        n = max(0, len(h) - self.size + 1)
        joint = np.zeros(n, np.uint64)
        for k in range(self.size):
            joint += h[k : k + n] * self.factors[k]
        joint = mixed(joint)
        out = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= self.size:
                out.append(np.unique(joint[a : b - self.size + 1]))
            elif b > a:
                out.append(mixed(np.array([(h[a:b] * self.factors[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def shingle_words(text: bytes, size: int) -> Iterator[bytes]:
    """The shingles of a text as bytes."""
    found = text.lower().split()
    if found:
        for k in range(max(1, len(found) - size + 1)):
            yield b" ".join(found[k : k + size])


def shared_shingles(one: list[bytes], other: list[bytes], size: int) -> tuple[int, int, int]:
    """Of two texts' words: how many distinct shingles each has and how many they share, words compared as they are;
    zeros where one has fewer words than a shingle, so that nothing is shared. Words become numbers; runs of k words are ranked, then those of k + 1, so equal numbers are equal runs."""
    if min(len(one), len(other)) < size:
        return (1, 1, 1) if one == other else (0, 0, 0)
    numbers: dict[bytes, int] = {}
    a, b = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (one, other))
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, size) for x in (a, b)])
    rank = windows[:, 0]
    for k in range(1, size):
        rank = np.unique(rank * len(numbers) + windows[:, k], return_inverse=True)[1]
    a, b = np.unique(rank[: len(a) - size + 1]), np.unique(rank[len(a) - size + 1 :])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


class CirculantMinHash:
    """Two permutations make all coordinates: the first (a seeded hash to UNIVERSE places) scatters the
    shingles, the second, shifted by k, gives coordinate k. The values of a place under all shifts
    lie side by side, so a set's signature is the least row of a sliding window over the permutation."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, n = bands, rows, bands * rows
        second = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: n - 1]]), n)
        self.first = np.uint64(np.random.default_rng(seed + 1).integers(1, 1 << 63)) * np.uint64(2) + np.uint64(1)
        self.factors = np.random.default_rng(seed + 2).integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray, step: int = 8192) -> np.ndarray:
        place = (mixed(shingles * self.first) >> np.uint64(44)).astype(np.int64)
        least = self.windows[place[:step]].min(axis=0)
        for k in range(step, len(place), step):
            np.minimum(least, self.windows[place[k : k + step]].min(axis=0), out=least)
        return least

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of each signature; keys of different bands differ."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        return mixed((parts * self.factors).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Larger buckets are first compared with their hubs.
SMALL = 16
#: Buckets of up to so many sets are compared pair by pair, by outlines; the sets of larger ones meet by their
#: rarest shingles, in blocks of about so many.
GROUP = 2000
#: Pairs of one hub that are confirmed together.
PART = 500
#: Bits of a shingle's hash that name the class in which its rarity is counted.
RARITY_BITS = 18
#: Classes of an outline, which counts a set's shingles by hash.
CLASSES = 128


def outline(shingles: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


def may_link(outlines: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows whose outlines leave the similarity possible: two sets share at most the
    smaller count of every class; where both counts are at their highest nothing is ruled out."""
    full = outlines == 255
    any_full = full.any()
    for k in range(len(n) - 1):
        most = np.minimum(outlines[k], outlines[k + 1 :]).sum(axis=1, dtype=np.int64)
        fits = 100 * most >= percent * (n[k] + n[k + 1 :] - most)
        if any_full:
            fits |= (full[k] & full[k + 1 :]).any(axis=1)
        yield k, k + 1 + np.flatnonzero(fits)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n (shingles), set_key (128 bits that name the shingle set), bands (a key for each; empty if n is 0), outline."""

    def work(batches):
        shingles, minhash = Shingles(size), CirculantMinHash()
        for rows, data, places in blocks(batches, "text"):
            sets = shingles.sets(data, places)
            full = [s for s in sets if len(s)]
            keys = minhash.band_keys(np.array([minhash.signature(s) for s in full])) if full else np.zeros((0, BANDS), np.uint64)
            n = np.array([len(s) for s in sets], np.int64)
            names = np.array([[mixed(s).sum(dtype=np.uint64), mixed(~s).sum(dtype=np.uint64)] for s in sets], np.uint64)
            for k in np.flatnonzero(n == 1).tolist():  # nothing but one shingle's hash would name these sets
                text = b" ".join(dict.fromkeys(shingle_words(data[places[k] : places[k + 1]].tobytes(), size)))
                names[k] = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), np.uint64)
            starts = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sets), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(as_long(keys.reshape(-1)))),
                    pa.array([outline(s).tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "set_key", "bands", "outline"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, set_key binary, bands array<long>, outline binary")


def within_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of rows (key, rep, n, joined, outline) of one key that no link joins yet and that may be similar enough."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, rep, n, joined = (rows[c].to_numpy() for c in ("key", "rep", "n", "joined"))
        outlines = np.frombuffer(b"".join(rows["outline"].to_pylist()), np.uint8).reshape(-1, CLASSES)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(edges[:-1], edges[1:]):
            if high - low > 1 and (joined[low:high] != joined[low]).any():
                for k, others in may_link(outlines[low:high], n[low:high], percent):
                    others = low + others[joined[low + others] != joined[low + k]]
                    a.append(np.minimum(rep[low + k], rep[others]))
                    b.append(np.maximum(rep[low + k], rep[others]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = rows.select("key", "rep", "n", "joined", "outline")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(whole_buckets(pairs), "a long, b long").distinct()


def whole_buckets(pairs: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """pairs for batches sorted by key: it gets whole buckets; a batch's last one may go on in the next."""

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            key = table["key"].to_numpy()
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            done = int(edges[-1]) if len(edges) else 0
            if done:
                yield pairs(table.slice(0, done))
            held = table.slice(done).to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    return work


def rarities(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles of the texts (text) fall in each class of hashes."""

    def work(batches):
        shingles, counts = Shingles(size), np.zeros(1 << RARITY_BITS, np.int64)
        for _, data, places in blocks(batches, "text"):
            counts += np.bincount((np.concatenate(shingles.sets(data, places)) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["class", "n"])

    found = texts.select("text").mapInArrow(work, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[found["class"].to_numpy()] = found["n"].to_numpy()
    return counts


def within_crowd(crowd: DataFrame, docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """a, b: all pairs of the sets (rep, joined) that no link joins yet and that may be similar enough, whatever bands they share.

    A set's shingles are put in one order for all, rarest classes first. Two sets x, y that are similar
    enough share at least o = percent * (|x| + |y|) / (100 + percent) shingles, so one of the first
    |x| - o + 1 of x is one of the first |y| - o + 1 of y; as o is percent of the larger and
    2 * percent / (100 + percent) of the smaller at least, each set is keyed by a short prefix, and of a
    shingle's sets only those that have it in the still shorter prefix of a smaller set (low) ask
    the others. Boilerplate is in no such prefix. A shingle of many sets is cut into blocks of about GROUP
    that ask and GROUP that are asked, each pair of blocks a bucket of its own.
    """
    ids = crowd.select(F.col("rep").alias("id")).distinct()
    texts = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi"), "crowd-texts")
    counts = texts.sparkSession.sparkContext.broadcast(rarities(texts, size))

    def prefixes(batches):
        shingles = Shingles(size)
        for rows, data, places in blocks(batches, "text"):
            sets = shingles.sets(data, places)
            n = np.array([len(s) for s in sets], np.int64)
            kept = n + percent * n // -100 + (n > 0)
            first = [s[np.argsort(counts.value[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], kind="stable")[:k]] for s, k in zip(sets, kept.tolist())]
            starts = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array([outline(s).tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(as_long(np.concatenate(first))))],
                ["rep", "n", "outline", "first"],
            )

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, rep, n, at, joined = (rows[c].to_numpy() for c in ("key", "rep", "n", "at", "joined"))
        asks = rows["asks"].to_numpy(zero_copy_only=False)
        outlines = np.frombuffer(b"".join(rows["outline"].to_pylist()), np.uint8).reshape(-1, CLASSES)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(edges[:-1], edges[1:]):
            asked = low + np.flatnonzero(~asks[low:high])
            for k in (low + np.flatnonzero(asks[low:high])).tolist():
                common = -(percent * (n[k] + n[asked]) // -(100 + percent))
                others = asked[(n[k] <= n[asked]) & (at[k] <= n[k] - common) & (at[asked] <= n[asked] - common) & (joined[asked] != joined[k])]
                most = np.minimum(outlines[k], outlines[others]).sum(axis=1, dtype=np.int64)
                fits = (100 * most >= percent * (n[k] + n[others] - most)) | ((outlines[k] == 255) & (outlines[others] == 255)).any(axis=1)
                a.append(np.minimum(rep[k], rep[others[fits]]))
                b.append(np.maximum(rep[k], rep[others[fits]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    sets = stored(texts.mapInArrow(prefixes, "rep long, n long, outline binary, first array<long>").join(crowd.select("rep", "joined").distinct(), "rep"), "prefixes")
    rows = sets.select("rep", "n", "joined", F.posexplode("first").alias("at", "shingle"))
    rows = rows.withColumn("low", F.expr(f"at <= n - ceil({2 * percent} * n / {100 + percent}D)"))
    groups = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.count_if("low").alias("lows"), F.min("joined").alias("least"), F.max("joined").alias("most"))
    groups = groups.where("lows > 0 and least != most").select("shingle", F.ceil(F.col("size") / GROUP).alias("blocks"), F.ceil(F.col("lows") / GROUP).alias("low_blocks"))
    rows = stored(rows.join(groups, "shingle"), "prefix-buckets")
    mine = F.xxhash64("rep")
    asking = rows.where("low").withColumn("i", F.pmod(mine, "low_blocks")).withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("asks", F.lit(True))
    asked = rows.withColumn("k", F.pmod(mine, "blocks")).withColumn("i", F.explode(F.expr("sequence(0L, low_blocks - 1)"))).withColumn("asks", F.lit(False))
    rows = asking.unionByName(asked).join(sets.select("rep", "n", "outline"), ["rep", "n"])
    rows = rows.select(F.xxhash64("shingle", "i", "k").alias("key"), "rep", "n", "at", "joined", "asks", "outline")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(whole_buckets(pairs), "a long, b long").distinct()


def links(sets: DataFrame, docs: DataFrame, percent: int, **how) -> DataFrame:
    """a, b: confirmed links that join all distinct sets (rep, n, bands, outline) which links join.

    First every set of a bucket of more than SMALL is compared with the bucket's hub, the set that shares
    buckets with most others: of copies that were each changed in their own way the least changed one. From
    then on only sets that no link joins yet are compared: all those of a bucket of up to GROUP sets, by
    outlines, and in full where these leave it possible. The sets of all larger buckets are compared by
    within_crowd, which misses no link.
    """
    keyed = sets.select("rep", "n", F.explode("bands").alias("key"))

    def shared(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return stored(rows.join(sizes, "key"), "buckets")

    def stars(large: DataFrame) -> DataFrame:
        hubs = large.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"), "n", "joined")).alias("hub"))
        hubs = hubs.select("key", (-F.col("hub.minus")).alias("rep2"), F.col("hub.n").alias("n2"), F.col("hub.joined").alias("joined2"))
        fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
        met = large.join(hubs, "key").where("joined != joined2").where(fits)
        return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()

    rows = shared(keyed)
    score = rows.groupBy("rep").agg(F.sum("size").alias("score"))
    rows = stored(rows.join(score, "rep").join(sets.select("rep", "outline"), "rep"), "buckets")
    first = stored(confirmed(stars(rows.where(F.col("size") > SMALL).withColumn("joined", F.col("rep"))), docs, percent, **how), "hub-links")
    joined = components(first).select(F.col("node").alias("rep"), "component")
    rows = stored(rows.join(joined, "rep", "left").withColumn("joined", F.coalesce("component", "rep")).drop("component"), "buckets")
    pairs = within_buckets(rows.where(F.col("size") <= GROUP), percent)
    crowd = rows.where(F.col("size") > GROUP)
    if not crowd.isEmpty():
        pairs = pairs.unionAll(within_crowd(stored(crowd.select("rep", "joined").distinct(), "crowd"), docs, percent, **how)).distinct()
    return first.unionAll(confirmed(pairs, docs, percent, **how))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The pairs a, b whose full shingle sets, words compared as they are, have 100 * intersection >= percent * union.

    Of each pair the id that more pairs have is the hub. Pairs meet by hub, cut to parts of about PART pairs:
    a hub's text comes once to each part, before those of its others.
    """

    def work(batches):
        hub, words = None, []
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for at, part, other, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "other", "text"))):
                mine = (text or "").encode().lower().split()
                if other is None:
                    hub, words = (at, part), mine
                elif hub == (at, part) and mine and words:
                    n, m, both = shared_shingles(words, mine, size)
                    if both and 100 * both >= percent * (n + m - both):
                        linked.append((min(at, other), max(at, other)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], ["a", "b"])

    pairs = stored(pairs, "pairs")
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")), "compared")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ends, "id", "left_semi")
    texts = stored(texts, "compared-texts")
    a, b = (ends.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")) for end in ("a", "b"))
    first = F.col("n_a") >= F.col("n_b")
    pairs = pairs.join(a, "a").join(b, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("n_a", "n_b").alias("n"))
    pairs = stored(pairs.select("hub", "other", F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / PART)).alias("part")), "hub-pairs")
    hubs = pairs.select("hub", "part").distinct().join(texts, F.col("hub") == F.col("id")).select("hub", "part", F.lit(None).cast("long").alias("other"), "text")
    others = pairs.join(texts, F.col("other") == F.col("id")).select("hub", "part", "other", "text")
    met = hubs.unionAll(others).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("other"))
    return met.mapInArrow(work, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """For every row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of word shingles have a Jaccard similarity of percent / 100 at
    least; component_id is the smallest id that links reach, and the row of that id is kept. Equal sets
    become one node first, so exact copies never meet as pairs. Two documents at a similarity of 0.85
    miss each other in all 25 bands of 5 coordinates with a chance of 4e-7 (0.80: 5e-5); every link is
    confirmed on the full sets.

    A null or blank text has no shingles, is linked with nothing and is kept; a text of fewer words than
    a shingle is one shingle. A row with a null id is linked with nothing: component_id null, kept true.
    Rows that repeat an id are one document, and each gets that document's answer (of an id with several
    texts the nodes of all). An empty table gives an empty one. Other columns, of any name, play no part.
    """
    rows = stored(signatures(docs, id_col, text_col, size), "signatures")
    full = rows.where("n > 0 and doc_id is not null")
    sets = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("outline").alias("outline")), "sets")
    found = links(sets.select("rep", "n", "bands", "outline"), docs, percent, id_col=id_col, text_col=text_col, size=size)
    linked = components(found).withColumnRenamed("node", "rep")
    named = sets.select("set_key", "rep").join(linked, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    all_rows = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = all_rows.join(named, "set_key", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies; the columns stay as they are. Rows of a null id, and null,
    empty and blank texts, stay; rows that repeat an id share its decision."""
    dropped = stored(near_groups(docs, id_col, text_col, percent).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct(), "near-copies")
    return docs.join(dropped, docs[id_col] == dropped["__dropped"], "left_anti")
