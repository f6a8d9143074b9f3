"""SentencePiece encoding and decoding: Viterbi over a stream, with a window of the longest piece."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut_text
from loomgraph.llm.lattice import MARK, read_pieces

#: Words whose ids a worker remembers, the characters of the longest of them, and pairs of pieces that it has compared.
MEMO, LONGEST_KNOWN, PAIRS = 700_000, 64, 1_000_000
#: Places after which the window may move.
SPAN = 64


class Vocabulary:
    """A model file's pieces. Characters without a piece are spelled in bytes, or unknown where there are none."""

    def __init__(self, path: str):
        spelled, self.scores, kinds, self.made = read_pieces(path)
        self.spelled = spelled
        self.ids = {spelled[k].decode(): k for k in np.flatnonzero(kinds == 0).tolist()}
        self.bytes = {spelled[k][0]: k for k in np.flatnonzero(kinds == 1).tolist()}
        self.longest = max(map(len, self.ids), default=1)
        self.least = float(self.scores.min())
        self.unknown = next((k for k, kind in enumerate(kinds) if kind == 3), 0)
        self.trie: dict = {}
        for piece, k in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = k
        self.pairs: dict[int, bool] = {}
        self.text = {k: p for p, k in self.ids.items()}

    def fallback(self, character: str) -> list[int]:
        raw = character.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Few characters by the rule of merged vocabularies: always the best-scored neighbours first, the left of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores[k], -i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def may_meet(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return found


class Encoder:
    """Ids of a text that comes in parts. Of each place in the window it keeps the best path there: its score, its last
    piece and where that begins. A piece longer than `longest` there is not, so once the places up to one
    are worked on, only paths to the next `longest` places survive; the boundary that all of them share is
    final, the ids before it are given out, and the window moves there.

    A unigram model's best path is the one of highest score. For a merged (BPE) model, whose scores only order its
    merges, a path survives only where neighbours are ones that the merges leave apart; one does.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.buffer = vocabulary, ""
        # for each place from the window's start: where the last piece begins (-1: not reached), its id (-1: none, or a
        # character without a piece), and the path's score
        self.best, self.ids, self.scores = [0], [-1], [0.0]
        self.at = 0

    def feed(self, text: str, end: bool = False) -> list[int]:
        self.buffer += text
        out: list[int] = []
        while True:
            ready = len(self.buffer) if end else len(self.buffer) - self.v.longest + 1
            if self.at >= ready:
                break
            stop = min(ready, self.at + SPAN)
            room = min(len(self.buffer), stop - 1 + self.v.longest) + 1 - len(self.best)
            self.best += [-1] * room
            self.ids += [-1] * room
            (self.walk_scores if self.v.made == 1 else self.walk)(stop)
            self.at = stop
            if stop < ready:
                out += self.commit()
        out += self.commit(end)
        return out

    def walk(self, stop: int) -> None:
        """The places up to stop, for a merged model."""
        v, best, ids, buffer, n = self.v, self.best, self.ids, self.buffer, len(self.buffer)
        trie, pairs, may_meet = v.trie, v.pairs, v.may_meet
        for i in range(self.at, stop):
            if best[i] < 0:
                continue
            last, node, j = ids[i], trie, i
            while j < n and (node := node.get(buffer[j])) is not None:
                j += 1
                k = node.get("")
                if k is not None and (last < 0 or (pairs[last << 32 | k] if last << 32 | k in pairs else may_meet(last, k))):
                    best[j], ids[j] = i, k
            if best[i + 1] < 0 and buffer[i] not in v.ids:  # a character without a piece
                best[i + 1] = i

    def walk_scores(self, stop: int) -> None:
        """The places up to stop, for a unigram model."""
        v, best, ids, buffer, n = self.v, self.best, self.ids, self.buffer, len(self.buffer)
        scores = self.scores
        scores += [-math.inf] * (len(best) - len(scores))
        for i in range(self.at, stop):
            if best[i] < 0:
                continue
            node, j = v.trie, i
            while j < n and (node := node.get(buffer[j])) is not None:
                j += 1
                k = node.get("")
                if k is not None and scores[i] + v.scores[k] > scores[j]:
                    best[j], ids[j], scores[j] = i, k, scores[i] + v.scores[k]
            if buffer[i] not in v.ids and scores[i] + v.least - 10 > scores[i + 1]:  # a character without a piece
                best[i + 1], ids[i + 1], scores[i + 1] = i, -1, scores[i] + v.least - 10

    def path(self, place: int) -> list[int]:
        places = [place]
        while places[-1]:
            places.append(self.best[places[-1]])
        return places

    def commit(self, end: bool = False) -> list[int]:
        """The ids up to the last boundary on all surviving paths."""
        best, ids, buffer = self.best, self.ids, self.buffer
        if end:
            shared = len(buffer)
        else:
            alive = [k for k in range(self.at, len(best)) if best[k] >= 0]
            common = set(self.path(alive[0]))
            for k in alive[1:]:
                common &= set(self.path(k))
            shared = max(common)
        out: list[int] = []
        place = shared
        while place:
            k = ids[place]
            out.append(k) if k >= 0 else out.extend(reversed(self.v.fallback(buffer[best[place]])))
            place = best[place]
        if end:
            self.buffer, self.at, self.best, self.ids, self.scores = "", 0, [0], [-1], [0.0]
            return out[::-1]
        base = self.scores[shared] if shared < len(self.scores) else 0.0
        self.buffer, self.at = buffer[shared:], self.at - shared
        self.best = [0, *(b - shared if b >= 0 else b for b in best[shared + 1 :])]
        self.ids = ids[shared:]
        self.scores = [0.0, *(x - base for x in self.scores[shared + 1 :])]
        return out[::-1]


class Codec:
    """Whole texts to ids and back. No piece goes on past the beginning of a word (blanks and what follows), nor past a
    character that no piece has: there all paths meet, so the ids between such boundaries are looked up, and
    only words that are new go through the encoder."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.inner = any(" " in p.lstrip(" ") for p in self.v.ids)
        used = {c for p in self.v.ids for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in used)
        self.part = re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +") if not self.inner else re.compile(r"(?s).+")
        self.memo: dict[str, bytes] = {}

    def new(self, part: str) -> bytes:
        ids = np.array(Encoder(self.v).feed(part, end=True), "<u4").tobytes()
        if len(self.memo) < MEMO and len(part) <= LONGEST_KNOWN:
            self.memo[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; a word mark is put before the text, none in an empty one."""
        if not text:
            return b""
        text = " " + text.replace(MARK, " ")
        return b"".join(map(self.encode_part, [text] if self.inner else cut_text(text)))

    def encode_part(self, text: str) -> bytes:
        memo, parts = self.memo, self.part.findall(text)
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            return b"".join([memo.get(p) or self.new(p) for p in parts])

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.v.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")[1:]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for all tasks of a worker."""
    return Codec(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every row of docs. A null text is an empty one and has none. Ids of rows may be
    null or repeat: each row is encoded by itself. Other columns play no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                found = [c.encode(t.as_py() or "") for t in rows.column("text")]
                ends = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
                ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def codec_summary(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as encode gives them), round_trip: whether decoding gives the text again
    (a text with the word mark itself does not, as that becomes a blank). A null text is an empty one, of no pieces.
    Null and repeated ids: each row is answered by itself. An empty table gives an empty one. Other columns, of any
    name, play no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            ids = [c.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
