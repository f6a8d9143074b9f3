"""Packing: documents cut to a sequence's length and laid into as few sequences as possible."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut_text, stored

#: Distinct words whose ids a worker keeps, those met last; others are encoded when they come. New words that the library takes at once.
MEMO, AT_ONCE = 400_000, 4096
#: Steps of the search for the fillings of one sum.
EACH = 400
#: Pieces of one length that are numbered together.
SALT_ROWS = 4000


class WordIds:
    """Ids of whole texts under word_bpe_49k.json, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer reads a text as lower-case words, single digits and runs of other signs, each encoded
    on its own; a word's ids are looked up, and the library encodes the words met first, those of many texts as one text. Words are kept
    in two tables: when the newer one is half of `memo`, it becomes the older one, whose words are forgotten unless they were met since. A text with
    anything else than printable ASCII, white space and Latin-1 letters, or with the beginning of a
    special token, goes to the library whole, as its normal form may differ from lower case.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.older, self.most = Tokenizer.from_file(path), {}, {}, memo

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """A long text in parts, cut where words end for certain."""
        return b"".join(x for part in cut_text(text) for x in self.of([part]))

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what none before had is encoded for all together."""
        parts = [self.PART.findall(t.lower()) if self.PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        new: set[str] = set()
        for words in parts:
            new.update(set(words or ()).difference(self.memo))
        again = new & self.older.keys()
        self.memo.update((w, self.older[w]) for w in again)
        unmet = list(new - again)
        for k in range(0, len(unmet), AT_ONCE):
            self.memo.update(self.encoded(unmet[k : k + AT_ONCE]))
        found = [self.encode(t) if words is None else b"".join(map(self.memo.__getitem__, words)) for t, words in zip(texts, parts)]
        if 2 * len(self.memo) >= self.most:
            self.memo, self.older = {}, self.memo
        return found

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(whole.ids, "<u4").tobytes(), np.array(whole.word_ids, np.int64)
        edges = (4 * np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))).tolist()
        if len(edges) != len(words) + 1:  # not each a word to the library
            return {w: self.encode(w) for w in words}
        return {w: ids[a:b] for w, a, b in zip(words, edges, edges[1:])}


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """One for all tasks of a worker, so that each finds the words of those before it."""
    return WordIds(vocabulary)


def ids_of_all(words: WordIds, texts: pa.Array, most: int = 1 << 20) -> Iterator[bytes]:
    """The ids of every text (null: empty), short ones about `most` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.cumsum(sizes), 0
    while row < len(sizes):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] - sizes[row] + most, "right")))
        some = [t or "" for t in texts.slice(row, last - row).to_pylist()]
        yield from words.of(some) if len(some) > 1 else map(words.ids, some)
        row = last


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a count of each length: (filling, how many sequences), a filling being (length, times) pairs."""
    open_bins: dict[int, list] = defaultdict(list)
    rests: list[int] = []

    def put(filling, times, rest):
        if not open_bins[rest]:
            insort(rests, rest)
        open_bins[rest].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rests, length)
            if k < len(rests):
                rest = rests[k]
                filling, times = open_bins[rest].pop()
                if not open_bins[rest]:
                    rests.pop(k)
            else:
                rest, filling, times = capacity, (), left
            each = rest // length
            whole = min(times, left // each)
            if whole:
                put((*filling, (length, each)), whole, rest - each * length)
            left -= whole * each
            if whole < times and filling:
                if left:  # fewer than one more sequence takes
                    put((*filling, (length, left)), 1, rest - left * length)
                    whole, left = whole + 1, 0
                if whole < times:
                    put(filling, times - whole, rest)
            elif left and not filling:
                put(((length, left),), 1, rest - left * length)
                left = 0
    return [x for bins in open_bins.values() for x in bins]


def fewest_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: for every size t, documents of more than capacity - t share a sequence with none of t or more, those
    of more than half with none of their kind; what the others of t and more do not find room for beside them
    needs sequences of its own."""
    have = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        have[n] = k
    many, tokens = np.cumsum(have), np.cumsum(have * np.arange(capacity + 1))
    half = capacity // 2
    t = np.arange(half + 1)
    alone, large = many[capacity] - many[capacity - t], many[capacity - t] - many[half]
    room = large * capacity - (tokens[capacity - t] - tokens[half])
    small = tokens[half] - np.where(t > 0, tokens[np.maximum(t - 1, 0)], 0)
    return int((alone + large + np.maximum(0, -((room - small) // capacity))).max())


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the other filling's documents fit into places of the sizes of one's."""
    if not other:
        return True
    tried = set()
    for k, size in enumerate(one):
        if size >= other[0] and size not in tried:
            tried.add(size)
            if dominates((*one[:k], size - other[0], *one[k + 1 :]), other[1:]):
                return True
    return False


class Completions:
    """Undominated ways to fill up a sequence that holds the largest document, with any number of others, the least
    waste first. Which sums the lengths up to each can make is known beforehand as bits of a number, so that
    the search for a sum goes down only where it may be reached; all searches together take `steps` at most."""

    def __init__(self, lengths: list[int], capacity: int, most: int, steps: int):
        self.lengths, self.most, self.steps = sorted(lengths, reverse=True), most, steps
        full = (1 << capacity + 1) - 1
        sums = [1]
        for n in reversed(self.lengths):
            made, by = sums[-1], n
            while by <= capacity:  # any number of times
                made |= made << by & full
                by *= 2
            sums.append(made)
        self.sums = sums[::-1]  # of the lengths from each on
        self.minus = [-n for n in self.lengths]

    def fillings(self, have: np.ndarray, total: int, end: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly that total, the largest documents first, until `end` steps are left."""
        taken: Counter = Counter()
        path: list[int] = []

        def down(rest: int, k: int) -> Iterator[tuple[int, ...]]:
            if not rest:
                yield tuple(path)
                return
            for j in range(max(k, bisect_left(self.minus, -rest)), len(self.lengths)):
                self.steps -= 1
                if self.steps < end or not self.sums[j] >> rest & 1:
                    return
                n = self.lengths[j]
                if have[n] > taken[n] and self.sums[j] >> rest - n & 1:
                    taken[n] += 1
                    path.append(n)
                    yield from down(rest - n, j)
                    path.pop()
                    taken[n] -= 1

        return down(total, 0)

    def of(self, have: np.ndarray, gap: int, waste: int) -> list[tuple[int, ...]]:
        """have: documents of each length, the largest one taken off; waste: the most that is allowed."""
        found: list[tuple[int, ...]] = []
        for lost in range(min(gap, waste) + 1):
            self.steps -= 1
            if self.steps < 0:
                break
            for filling in islice(self.fillings(have, gap - lost, max(0, self.steps - EACH)), 2 * self.most):
                if not any(dominates(f, filling) for f in found):
                    found.append(filling)
                if len(found) == self.most:
                    return found
        return found


def bin_completion(counts: dict[int, int], capacity: int, steps: int = 600_000, width: int = 4) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences for counts of documents by length: branch and bound over completions of the largest
    document left, each taken as often as the counts allow. The incumbent is the best-fit solution; a
    branch ends where its sequences waste more than a solution of one sequence less than the incumbent may.
    Ends at the lower bound, or after so many steps with the best found; work does not grow with the number
    of documents."""
    best = best_fit(counts, capacity)
    total = sum(n * k for n, k in counts.items())
    fewest = fewest_sequences(counts, capacity)
    used = sum(k for _, k in best)
    if used <= fewest:
        return best
    have = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        have[n] = k
    each = np.arange(capacity + 1)
    ways_to = Completions(list(counts), capacity, width, steps)
    path: list[tuple[dict[int, int], int, int]] = []
    choices: list[list[dict[int, int]]] = []
    waste = 0

    def allowed() -> int:
        return (used - 1) * capacity - total - waste

    def branch() -> None:
        largest = int(np.flatnonzero(have)[-1])
        have[largest] -= 1
        if int((have * each).sum()) + largest <= capacity:  # all that is left is one sequence
            found = [tuple(n for n in np.flatnonzero(have).tolist() for _ in range(have[n]))]
        else:
            found = ways_to.of(have, capacity - largest, allowed())
        have[largest] += 1
        choices.append([dict(Counter((largest, *more))) for more in found[::-1]])

    branch()
    while choices and used > fewest and ways_to.steps > 0:
        ways_to.steps -= 1
        if not choices[-1]:
            choices.pop()
            if path:
                way, k, lost = path.pop()
                waste -= lost
                for n, m in way.items():
                    have[n] += m * k
            continue
        way = choices[-1].pop()
        k = min(int(have[n]) // m for n, m in way.items())
        size = sum(n * m for n, m in way.items())
        rest = int((have * each).sum()) - k * size
        lost = k * (capacity - size) if rest else 0  # what the last sequence leaves open is no waste
        path.append((way, k, lost))
        waste += lost
        for n, m in way.items():
            have[n] -= m * k
        so_far = sum(x for _, x, _ in path)
        if not rest:
            if so_far < used:
                best, used = [(tuple(sorted(w.items(), reverse=True)), x) for w, x, _ in path], so_far
            choices.append([])
        elif allowed() < 0:
            choices.append([])
        else:
            branch()
    return best


def token_pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, then end_id, cut after each limit ids."""

    def work(batches):
        words = word_ids(vocabulary)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of_all(words, batch.column(1))):
                ids += end_id.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for k, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, length of 1 to capacity, and more) with sequence_id and offset, gapless from 0.

    How many pieces there are of each length, capacity numbers at most, goes to the driver, where
    bin_completion turns them into fillings; the pieces of a length are numbered, by salted groups whose
    sizes are summed, and each takes the place of its number. So the packing is one over all rows,
    while no piece passes through the driver. Rows of a null id are packed like any other; an empty
    table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, sequence, taken = [], 0, defaultdict(int)
    for filling, times in bin_completion(counts, capacity) if counts else []:
        offset = 0
        for length, each in filling:
            places.append((length, taken[length], taken[length] + times * each, each, sequence, offset))
            taken[length] += times * each
            offset += length * each
        sequence += times
    places = spark.createDataFrame(places, "at_length long, low long, high long, each long, first_sequence long, first_offset long")
    salts = spark.createDataFrame([(n, -(-k // SALT_ROWS)) for n, k in counts.items()], "of_length long, salts long")
    rows = pieces.join(F.broadcast(salts), F.col("length") == F.col("of_length"))  # a row for each of capacity lengths at most
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("of_length", "salts")
    groups = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    rows = rows.join(groups, (rows["length"] == groups["l"]) & (rows["salt"] == groups["s"])).withColumn("number", F.col("number") - 1 + F.col("before"))
    # the places are as many as the fillings' parts, a few for each of capacity lengths
    rows = rows.join(F.broadcast(places), (F.col("length") == F.col("at_length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    at = F.col("number") - F.col("low")
    return rows.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is an empty
    one, of end_id alone; a document longer than capacity is cut into pieces of capacity ids, the last
    one shorter. Rows of a null id or a repeated one are packed one by one. An empty table gives an empty
    one. Other columns, of any name, play no part."""
    return pack(stored(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces"), capacity)
