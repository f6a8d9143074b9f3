"""Collocations by hierarchical pair naming: a phrase of k words is a pair of neighbouring phrases of k - 1 words that are
frequent themselves, and gets one id for all texts; the pair is its way back to its parts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, mixed, run_hashes, stored, text_bytes

#: Bytes of text of a block, whose words and pairs are numbered together; pairs (in expectation) that are counted together.
BLOCK, SHARD = 4 << 20, 1 << 20
BLANK = np.array([b in b" \t" for b in range(256)])
#: What ends a piece of text; no phrase goes beyond it.
END = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
NO_LANG = "und"

LEVEL = "block long, lang string, words long, n long, codes binary, left binary, right binary, counts binary"
DEALT = "shard long, block long, lang string, places binary, left binary, right binary, counts binary"
NAMED = "block long, shard long, places binary, numbers binary, lang array<string>, word array<binary>, left array<long>, right array<long>, f array<long>"


CODEC = pa.Codec("zstd", 6)


def packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers byte by byte of all of them, compressed; rising ones as differences."""
    numbers = numbers.astype(np.int64)
    numbers = np.ascontiguousarray(np.diff(numbers, prepend=0) if rising else numbers)
    planes = numbers.view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(7, "little") + bytes([rising]) + CODEC.compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:7], "little")
    planes = np.frombuffer(CODEC.decompress(data[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    numbers = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    return np.cumsum(numbers) if data[7] else numbers


def packed_words(words: list[bytes]) -> bytes:
    """Words, none of which has a line break, compressed."""
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    return CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).split(b"\n")


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of at least limit bytes that end where a piece ends; the last may be shorter."""
    if len(text) <= limit:
        yield text
        return
    ends = np.flatnonzero(END[np.frombuffer(text, np.uint8)])
    begin = 0
    while len(text) - begin > limit:
        k = np.searchsorted(ends, begin + limit)
        if k == len(ends):
            break
        yield text[begin : ends[k]]
        begin = int(ends[k]) + 1
    yield text[begin:]


def word_codes(data: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of bytes in order as numbers, -1 between pieces; the words, the most frequent first, then by their bytes, so that
    numbers are small; how many each is."""
    data = LOWER[data]
    gap = BLANK[data] | END[data]
    if gap.all():
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    ends_before = np.concatenate([[0], np.cumsum(END[data])])
    piece = ends_before[start]
    size = end - start
    if size.sum() >= 1 << 31:
        raise ValueError("a piece of text has 2 GB at most")
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~gap]))])
    coded = words.dictionary_encode()
    spelled = coded.dictionary.to_pylist()
    indices = coded.indices.to_numpy()
    often = np.bincount(indices, minlength=len(spelled))
    order = np.array(sorted(range(len(spelled)), key=spelled.__getitem__))
    order = order[np.argsort(-often[order], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[indices]
    breaks = np.flatnonzero(np.diff(piece)) + 1
    return np.insert(codes, breaks, -1), [spelled[k] for k in order.tolist()], often[order]


def word_level(docs: DataFrame, text_col: str, lang_col: str | None, block: int) -> DataFrame:
    """A row for every block of text of one language: its words as numbers, and the words with their counts."""

    def rows(lang: str, texts: list[bytes], number: int) -> pa.RecordBatch:
        codes, words, counts = word_codes(np.frombuffer(b"\n".join(texts), np.uint8))
        row = {"block": number, "lang": lang, "words": int(counts.sum()), "n": len(words), "codes": packed(codes + 1), "left": packed_words(words), "right": None, "counts": packed(counts)}
        return pa.RecordBatch.from_pylist([row], SCHEMA)

    def work(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for batch in batches:
            data, places = text_bytes(batch.column(1))
            raw = data.tobytes()
            for lang, a, b in zip(batch.column(0).to_pylist(), places[:-1].tolist(), places[1:].tolist()):
                for part in parts(raw[a:b], block):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    total += len(part) + 1
                    if sizes[lang] >= block or total >= 4 * block:  # of many languages the one that fills most
                        full = max(sizes, key=sizes.__getitem__)
                        yield rows(full, held.pop(full), number)
                        total -= sizes.pop(full)
                        number += 1
        for lang, texts in held.items():
            yield rows(lang, texts, number)
            number += 1

    lang = F.lit(NO_LANG) if lang_col is None else F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(work, LEVEL).where("n > 0")


SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("counts", pa.binary())])


def dealt(level: DataFrame, shards: int, first: bool) -> DataFrame:
    """The words or pairs of every block by shards of a hash, so that equal ones of all blocks meet."""

    def hashed_words(words: list[bytes], lang: str) -> np.ndarray:
        end = np.cumsum([len(w) for w in words])
        start = np.concatenate([[0], end[:-1]])
        return mixed(run_hashes(np.frombuffer(b"".join(words), np.uint8), start, end) ^ np.uint64(zlib.crc32(lang.encode())))

    def work(batches):
        for r in one_by_one(batches):
            counts = unpacked(r["counts"])
            if first:
                words = unpacked_words(r["left"])
                h = hashed_words(words, r["lang"])
            else:
                left, right = unpacked(r["left"]), unpacked(r["right"])
                h = mixed(mixed(left.view(np.uint64)) + right.view(np.uint64))
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            out = []
            for at in np.split(order, cuts):
                row = {"shard": int(shard[at[0]]), "block": r["block"], "lang": r["lang"], "places": packed(at, True), "counts": packed(counts[at])}
                row |= {"left": packed_words([words[k] for k in at.tolist()]), "right": None} if first else {"left": packed(left[at], True), "right": packed(right[at])}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, DEALT_SCHEMA)

    return level.select("block", "lang", "left", "right", "counts").mapInArrow(work, DEALT)


DEALT_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("lang", pa.string()), ("places", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("counts", pa.binary())])
NAMED_SCHEMA = pa.schema(
    [("block", pa.int64()), ("shard", pa.int64()), ("places", pa.binary()), ("numbers", pa.binary()), ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.binary())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))]
)


def grouped(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two numbers: which group of equal rows each is in, and a row of every group."""
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def named(level: DataFrame, least: int, first: bool, shard_pairs: int) -> DataFrame:
    """Of what occurs at least so often in all blocks together: a row a shard with its words or pairs and their counts (block
    is null), where the k-th has the id shard * 2**32 + k; and a row a block and shard that says which of the block's
    own numbers these are."""
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_pairs))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = [unpacked(r["counts"]) for r in rows]
        if first:
            langs, words = pa.array([r["lang"] for r in rows]).dictionary_encode(), [unpacked_words(r["left"]) for r in rows]
            coded = pa.array([w for part in words for w in part], pa.binary()).dictionary_encode()
            left, right = np.repeat(langs.indices.to_numpy(), [len(w) for w in words]).astype(np.int64), coded.indices.to_numpy().astype(np.int64)
        else:
            left, right = np.concatenate([unpacked(r["left"]) for r in rows]), np.concatenate([unpacked(r["right"]) for r in rows])
        group, one = grouped(left, right)
        f = np.zeros(len(one), np.int64)
        np.add.at(f, group, np.concatenate(counts))
        often = f >= least
        number = np.where(often, np.cumsum(often) - 1, -1)
        one, shard = one[often], rows[0]["shard"]
        out = [{"shard": shard, "f": f[often].tolist()}]
        if first:
            out[0] |= {"lang": langs.dictionary.take(pa.array(left[one])).to_pylist(), "word": coded.dictionary.take(pa.array(right[one])).to_pylist()}
        else:
            out[0] |= {"left": left[one].tolist(), "right": right[one].tolist()}
        begin = 0
        for r, c in zip(rows, counts):
            mine = number[group[begin : begin + len(c)]]
            begin += len(c)
            if (mine >= 0).any():
                out.append({"block": r["block"], "shard": shard, "places": packed(unpacked(r["places"])[mine >= 0], True), "numbers": packed(mine[mine >= 0], not first)})
        return pa.Table.from_pylist(out, NAMED_SCHEMA)

    return dealt(level, shards, first).groupBy("shard").applyInArrow(merge, NAMED)


def next_level(level: DataFrame, names: DataFrame) -> DataFrame:
    """The blocks with the pairs of neighbours that names knows in place of what it knows."""
    marks = names.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "places", "numbers")).alias("marks"))  # of one block
    joined = level.select("block", "lang", "n", "codes").join(marks, "block")

    def work(batches):
        for r in one_by_one(batches):
            ids = np.full(r["n"] + 1, -1, np.int64)  # the last is for the gaps, -1
            for m in r["marks"]:
                ids[unpacked(m["places"])] = unpacked(m["numbers"]) + (m["shard"] << 32)
            at = ids[unpacked(r["codes"]) - 1]
            known, codes = np.unique(at[at >= 0], return_inverse=True)
            near = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            if not len(near):
                continue
            place = np.cumsum(at >= 0) - 1
            pairs, new, counts = np.unique(codes[place[near]] * len(known) + codes[place[near + 1]], return_inverse=True, return_counts=True)
            after = np.full(len(at), -1, np.int64)
            after[near] = new
            keep = after >= 0
            keep[1:] |= keep[:-1]  # a gap once
            row = {"block": r["block"], "lang": r["lang"], "words": None, "n": len(pairs), "codes": packed(after[keep] + 1), "left": packed(known[pairs // len(known)], True), "right": packed(known[pairs % len(known)]), "counts": packed(counts)}
            yield pa.RecordBatch.from_pylist([row], SCHEMA)

    return joined.mapInArrow(work, LEVEL)


def first_phrases(names: DataFrame) -> DataFrame:
    """id, lang, phrase, f, heads, tails of the words; heads: f of the first 1, 2, ... words, tails: of the last."""
    rows = names.where("block is null").select("shard", F.posexplode(F.arrays_zip("lang", "word", "f")).alias("k", "x"))
    f = F.array(F.col("x.f"))
    return rows.select(phrase_id(), F.col("x.lang").alias("lang"), F.decode(F.col("x.word"), "UTF-8").alias("phrase"), F.decode(F.col("x.word"), "UTF-8").alias("last"), F.col("x.f").alias("f"), f.alias("heads"), f.alias("tails"))


def phrase_id() -> Column:
    return (F.shiftleft(F.col("shard"), 32) + F.col("k")).alias("id")


def longer_phrases(names: DataFrame, shorter: DataFrame) -> DataFrame:
    """The same for the pairs of names over the phrases that are one word shorter, and which these are (left, right)."""
    rows = names.where("block is null").select("shard", F.posexplode(F.arrays_zip("left", "right", "f")).alias("k", "x"))
    rows = rows.select(phrase_id(), F.col("x.left").alias("left"), F.col("x.right").alias("right"), F.col("x.f").alias("f"))
    a = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.col("heads").alias("h"))
    b = shorter.select(F.col("id").alias("right"), "last", F.col("tails").alias("t"))
    own = F.array("f")
    return rows.join(a, "left").join(b, "right").select(
        "id", "lang", F.concat("begin", F.lit(" "), "last").alias("phrase"), "last", "f", F.concat("h", own).alias("heads"), F.concat("t", own).alias("tails"), "left", "right"
    )


def scored(phrases: DataFrame, words: int, scale: int) -> DataFrame:
    """phrases with l, r and score of the cut that scores lowest, the first of several; in decimals, as products pass 64 bits."""
    whole = F.lit(scale).cast("decimal(19,0)") * F.col("f").cast("decimal(19,0)")
    both = [(F.col("heads")[k - 1], F.col("tails")[words - k - 1]) for k in range(1, words)]
    quotients = [F.call_function("div", whole, left.cast("decimal(20,0)") + right.cast("decimal(20,0)")) for left, right in both]
    cuts = [F.struct(q.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (q, (left, right)) in enumerate(zip(quotients, both), 1)]
    return phrases.withColumn("cut", F.array_min(F.array(*cuts)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, scale: int = 2_000_000, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases of 2 to longest words, by score, then by
    a, both falling, then by their bytes.

    A to Z are read as a to z; pieces of text end at `.,;:!?` and line breaks, words at blanks and tabs. Of a phrase that
    occurs a >= least times, every cut into two has l and r occurrences of its parts and the score scale * a // (l + r); the
    lowest counts. A phrase inside a longer one that also is frequent and has at least percent of its
    occurrences is left out. n: the language's words. Whole texts are read and all counts are exact: what
    occurs less often than least can not be part of a phrase that does not.

    Level by level, a block (some megabytes of text of a language) holds a number for each place, and its distinct
    words or pairs of neighbours. Those of all blocks meet in shards, by a hash; the frequent ones get ids, which
    go back to the blocks that have them. So a pair is sent once a block, however often it is there, and
    a word of a third of all places is one row a block. An id's pair of ids leads to the counts of all its parts,
    and to the phrases that a longer one hides.

    A null text is empty, a null language `und`; ids, repeats of rows and other columns of any name play no
    part; texts without frequent phrases, and empty tables, give nothing. A piece without an end has 2 GB at most.
    """
    if not (least >= 1 and longest >= 2 and top >= 1):
        raise ValueError("least and top are at least 1, longest at least 2")
    level = stored(word_level(docs, text_col, lang_col, block), "words")
    total = level.groupBy("lang").agg(F.sum("words").alias("n"))
    names = stored(named(level, least, True, shard), "named")
    phrases = first_phrases(names)
    found = []
    for words in range(2, longest + 1):
        level = stored(next_level(level, names), "pairs")
        names = stored(named(level, least, False, shard), "named")
        phrases = stored(longer_phrases(names, phrases), "phrases")
        found.append(scored(phrases, words, scale))
    kept = [hidden_by(a, b, percent) for a, b in zip(found, found[1:])] + found[-1:]
    every = None
    for df in kept:
        df = df.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        every = df if every is None else every.unionAll(df)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # each task keeps its own first rows of a language before they meet
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def hidden_by(shorter: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """shorter without the phrases of which a longer one has at least percent of the occurrences. A phrase two words longer
    can not hide what the ones between do not: those are at least as frequent."""
    most = longer.select(F.explode(F.array("left", "right")).alias("part"), "f").groupBy("part").agg(F.max("f").alias("most"))
    joined = shorter.join(most, F.col("id") == F.col("part"), "left")
    hides = F.lit(100).cast("decimal(19,0)") * F.col("most").cast("decimal(19,0)") >= F.lit(percent).cast("decimal(19,0)") * F.col("f").cast("decimal(19,0)")
    return joined.where(~F.coalesce(hides, F.lit(False)))

