"""Token counts under byte_bpe_50k.json by finite-state transducers, compiled from the file's merges."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks, cut_text

#: Characters of a chunk; all chunks of a block are run at once, from every state.
CHUNK = 256
#: Words whose counts a worker remembers, and the bytes of the longest of them.
MEMO, LONGEST_KNOWN = 400_000, 64
#: Compiled states that a worker holds, and pairs of tokens that it has compared.
STATES, PAIRS = 1 << 16, 1 << 18
#: Tokens beyond a node of the trie up to which each is compared with the one before the node.
FEW = 100

# Classes of characters for the split of text into words: the letters that contractions end in apart.
LETTER, ONE, R_OR_V, L, E, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, EDGE = range(11)
# States: what the last word, begun but not ended, is so far. FREE: none, whatever comes begins one. QUOTE: an
# apostrophe that began a word; QUOTE_E, QUOTE_L: such and r or v, l. BLANK, BREAK: one white space character,
# a blank or another; BLANKS, BREAKS: several, of which the last is one.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTE, QUOTE_E, QUOTE_L, BLANK, BREAK, BLANKS, BREAKS = range(11)
#: What a transition emits: a word begins at this character, or at the one before.
HERE, BEFORE = 1, 2


def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and begins[class, state] of the transducer that parts words; a transition emits as many
    words as its begins has bits."""
    goto, begins = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    kind = {LETTER: IN_LETTERS, ONE: IN_LETTERS, R_OR_V: IN_LETTERS, L: IN_LETTERS, E: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: IN_OTHERS}
    for c in range(10):
        for s in range(11):
            white = c in (SPACE, WHITE)
            if s in (QUOTE_E, QUOTE_L):
                if c == (E if s == QUOTE_E else L):
                    goto[c, s] = FREE
                    continue
                s_now, out = IN_LETTERS, BEFORE  # the letter after the apostrophe began a word
            else:
                s_now, out = s, 0
            if s_now in (BLANK, BREAK, BLANKS, BREAKS):
                if white:
                    goto[c, s] = BLANKS if c == SPACE else BREAKS
                    continue
                out |= {BLANK: 0, BREAK: HERE, BLANKS: BEFORE, BREAKS: BEFORE | HERE}[s_now]
                goto[c, s] = QUOTE if c == APOSTROPHE and s_now in (BREAK, BREAKS) else kind[c]
            elif white:
                out |= HERE
                goto[c, s] = BLANK if c == SPACE else BREAK
            elif s_now == QUOTE and c in (ONE, R_OR_V, L):
                goto[c, s] = {ONE: FREE, R_OR_V: QUOTE_E, L: QUOTE_L}[c]
            elif s_now == kind[c] or s_now == QUOTE and kind[c] == IN_OTHERS:
                goto[c, s] = kind[c]
            else:
                out |= HERE
                goto[c, s] = QUOTE if c == APOSTROPHE else kind[c]
            begins[c, s] = out
    for s in (QUOTE_E, QUOTE_L):  # a text may end after the letter
        begins[EDGE, s] = BEFORE
    return goto, begins


def character_classes() -> np.ndarray:
    """The class of every code point; code point 0x110000 stands for a text's edge."""
    classes = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            classes[c] = LETTER if major == "L" else NUMBER
    # fixed values: the characters of the property White_Space
    for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        classes[c] = WHITE
    classes[32] = SPACE
    for letters, c in (("stmd", ONE), ("rv", R_OR_V), ("l", L), ("e", E), ("'", APOSTROPHE)):
        for x in letters:
            classes[ord(x)] = c
    classes[0x110000] = EDGE
    return classes


def word_starts(classes: np.ndarray, goto: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which characters begin words. Each chunk's map from the state before it to the state after it is found from
    all states at once; maps compose, so a prefix scan over the chunks, doubling its reach each time, gives
    the state before every chunk; a second run over all chunks from these states emits the words."""
    n = len(classes)
    m = max(1, -(-n // CHUNK))
    grid = np.full(m * CHUNK, EDGE, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(m, CHUNK).T)
    states = goto.shape[1]
    flat, emits = goto.reshape(-1), begins.reshape(-1)
    maps = np.tile(np.arange(states, dtype=np.int64), (m, 1))
    for row in grid:
        maps = flat[(row.astype(np.int64) * states)[:, None] + maps].astype(np.int64)
    reach = 1
    while reach < m:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.concatenate([[FREE], maps[:-1, FREE]])
    out = np.empty((CHUNK, m), np.uint8)
    for k, row in enumerate(grid):
        at = row.astype(np.int64) * states + state
        out[k] = emits[at]
        state = flat[at].astype(np.int64)
    out = out.T.reshape(-1)[:n]
    starts = (out & HERE) > 0
    starts[:-1] |= (out[1:] & BEFORE) > 0
    return starts


class WordTransducer:
    """The merges as a deterministic transducer over the bytes of a word, whose transitions say by how much the number
    of emitted tokens changes.

    What stands before each byte is one token, the last of the encoding of the bytes so far: of the vocabulary's
    tokens that end there it is the only one that the encoding before it can stand next to, that is, no
    merge of lower rank would have crossed between the two. So a state holds, for every earlier place from
    which the bytes may still grow to a token: the node of the vocabulary's trie that they lead to, the last token
    before that place, and how many tokens more there are now than there. Such states are finitely many;
    they are compiled when first met, into tables of next states and count changes, so that all words of a
    block then step at once. A full table begins anew with the states in use.
    """

    START = ((0, -1, 0),)

    def __init__(self, merges: list[tuple[int, int]], spelled: list[bytes], most: int = STATES):
        self.size, self.most = len(spelled), most
        self.left, self.right = [[*range(256), *(m[k] for m in merges)] for k in (0, 1)]
        self.merged = {a * self.size + b: 256 + k for k, (a, b) in enumerate(merges)}
        self.met: dict[int, bool] = {}
        self.trie: dict[int, int] = {}
        self.final = [-1]
        for token, letters in enumerate(spelled):
            node = 0
            for x in letters:
                node = self.trie.setdefault(node << 8 | x, len(self.final))
                if node == len(self.final):
                    self.final.append(-1)
            if letters:
                self.final[node] = token
        #: The tokens that go on from each node, where they are few; None: many.
        self.below: list[list[int] | None] = [[] for _ in self.final]
        up = {child: key >> 8 for key, child in self.trie.items()}
        for node in range(len(self.final) - 1, 0, -1):  # children come after their parents
            mine, rest = self.below[up[node]], self.below[node]
            if mine is not None:
                if rest is not None:
                    mine += rest + [self.final[node]] * (self.final[node] >= 0)
                if rest is None or len(mine) > FEW:
                    self.below[up[node]] = None
        self.open: dict[int, int] = {}
        self.classes: dict[tuple, int] = {}
        self.goto, self.gain = np.empty((most, 256), np.int32), np.empty((most, 256), np.int16)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}

    def state(self, s: tuple) -> int:
        k = self.ids.get(s)
        if k is None:
            k = self.ids[s] = len(self.states)
            self.states.append(s)
            self.goto[k] = -1
        return k

    def may_meet(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is a, b: the merges that made them are undone, the latest first,
        and at no time does a merge across the middle come before the one undone last."""
        key = a * self.size + b
        answer = self.met.get(key)
        if answer is None:
            bound, answer = len(self.merged) + 256, True
            while True:
                across = self.merged.get(a * self.size + b)
                if across is not None and across < bound:
                    answer = False
                    break
                # equal ranks: the left one was made first, so the right one is undone
                if max(a, b) < 256:
                    break
                if a > b:
                    bound, a = a, self.right[a]
                else:
                    bound, b = b + 1, self.left[b]
            if len(self.met) >= PAIRS:
                self.met.clear()
            self.met[key] = answer
        return answer

    def alike(self, node: int, before: int) -> int:
        """A token that may stand before the same tokens beyond the node as `before` may; -1 if all may follow, -2 if
        none. So places that differ in nothing that can still matter make no states of their own."""
        below = self.below[node]
        if below is None:
            return before
        key = node * self.size + before
        answer = self.open.get(key)
        if answer is None:
            fits = [self.may_meet(before, t) for t in below]
            answer = -1 if all(fits) else -2 if not any(fits) else self.classes.setdefault((node, *fits), before)
            if len(self.open) >= PAIRS:
                self.open.clear()
                self.classes.clear()
            self.open[key] = answer
        return answer

    def compile(self, k: int, x: int) -> None:
        """The transition of state k at byte x."""
        alive, last, gain = [], -1, 0
        trie, final, below = self.trie, self.final, self.below
        for node, before, back in self.states[k]:
            to = trie.get(node << 8 | x)
            if to is None:
                continue
            token = final[to]
            if token >= 0 and (before < 0 or self.may_meet(before, token)):
                last, gain = token, 1 - back
            if below[to] != []:
                if before >= 0:
                    before = self.alike(to, before)
                if before > -2:
                    alive.append((to, before, back))
        new = (*[(to, before, back + gain) for to, before, back in alive], (0, last, 0))
        self.goto[k, x], self.gain[k, x] = self.state(new), gain

    def run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The state after each run of data, and by how much its count has grown; from START or each run's own state. Runs
        of falling size; no more than a quarter of the table's rows."""
        state = np.full(len(begin), self.state(self.START)) if entry is None else np.array([self.state(s) for s in entry])
        count = np.zeros(len(begin), np.int64)
        goto, gain = self.goto.reshape(-1), self.gain.reshape(-1)
        open_at = np.searchsorted(-size, -np.arange(int(size.max(initial=0))))
        for i, n in enumerate(open_at.tolist()):
            at = state[:n] * 256 + data[begin[:n] + i]
            to = goto[at]
            new = np.unique(at[to < 0])
            if len(new):
                if len(self.states) + len(new) > self.most:
                    state = self.renewed(state)
                    at = state[:n] * 256 + data[begin[:n] + i]
                    new = np.unique(at)
                for k in new.tolist():
                    if goto[k] < 0:
                        self.compile(k >> 8, k & 255)
                to = goto[at]
            count[:n] += gain[at]
            state[:n] = to
        return state, count

    def renewed(self, state: np.ndarray) -> np.ndarray:
        used, back = np.unique(state, return_inverse=True)
        kept = [self.states[k] for k in used.tolist()]
        self.clear()
        return np.array([self.state(s) for s in kept])[back]

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many tokens each word (a run of data) has."""
        out = np.zeros(len(begin), np.int64)
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -4 * CHUNK))
        for k in order[:long].tolist():
            out[k] = self.long_count(data[begin[k] : begin[k] + size[k]])
        at_once = self.most // 4
        for low in range(long, len(order), at_once):
            rows = order[low : low + at_once]
            if len(self.states) > self.most // 2:
                self.clear()
            out[rows] = self.run(data, begin[rows], size[rows])[1]
        return out

    def long_count(self, word: np.ndarray) -> int:
        """The count of a long word by chunks, all of them run in step, in pieces of as many chunks as the table bears.

        A chunk's map (state before to state after, and the count's change) is needed for few states: first
        for START, then for what the chunk before it may end in. Links between the maps of neighbours compose
        by a prefix scan, doubling its reach each time, to the state before every chunk; where a chunk's map
        does not have that state yet, it is run from it, until no link is missing.
        """
        total, state, reach = 0, self.START, CHUNK * (self.most // 4)
        for low in range(0, len(word), reach):
            n, state = self.chunk_scan(word[low : low + reach], state)
            total += n
        return total

    def chunk_scan(self, part: np.ndarray, first: tuple) -> tuple[int, tuple]:
        begin = np.arange(0, len(part), CHUNK)
        size = np.minimum(CHUNK, len(part) - begin)
        m = len(begin)
        names: dict[tuple, int] = {}
        columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # state before, state after, count, of every chunk
        entry = [first] + [self.START] * (m - 1)
        while True:
            if len(self.states) > self.most // 2:
                self.clear()
            after, n = self.run(part, begin, size, entry)
            left = [self.states[k] for k in after.tolist()]
            columns.append((np.array([names.setdefault(s, len(names)) for s in entry]), np.array([names.setdefault(s, len(names)) for s in left]), n))
            into, out, counts = (np.stack(x, axis=1) for x in zip(*columns))
            same = out[:-1, :, None] == into[1:, None, :]
            known = same.any(axis=2)
            link = np.where(known, same.argmax(axis=2), len(columns) - 1)
            maps, reach = link.copy(), 1  # from the first of `reach` chunks to the one after them
            while reach < len(maps):
                maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
                reach *= 2
            at = np.concatenate([[0], maps[:, 0]]) if m > 1 else np.zeros(1, np.int64)
            rows = np.arange(m)
            if known[rows[:-1], at[:-1]].all():
                spelled = {k: s for s, k in names.items()}
                return int(counts[rows, at].sum()), spelled[int(out[m - 1, at[m - 1]])]
            spelled = {k: s for s, k in names.items()}
            entry = [first, *(spelled[k] for k in out[rows[:-1], at[:-1]].tolist())]


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        # the file spells bytes as characters: printable ones as themselves, the others from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        as_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        spelled = [b""] * len(vocabulary)
        for token, k in vocabulary.items():
            spelled[k] = bytes(as_byte[c] for c in token)
        self.words = WordTransducer([(vocabulary[a], vocabulary[b]) for a, b in merges], spelled)
        self.special = [x["content"] for x in file["added_tokens"]]
        self.classes, (self.goto, self.begins) = character_classes(), split_transducer()
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text; a special token's string in a text is one token."""
        out = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [x for p in pieces for x in p.split(s)]
            out[k] = len(pieces) - 1
            for p in pieces:
                *before, last = cut_text(p)
                for b in before:
                    out[k] += int(self.words_of([b], np.zeros(1, np.int64), 1)[0])
                parts.append(last)
                owner.append(k)
        return out + self.words_of(parts, np.array(owner), len(texts))

    def words_of(self, parts: list[str], owner: np.ndarray, many: int) -> np.ndarray:
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        edges = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds = self.classes[codes]
        kinds[edges] = EDGE
        starts = word_starts(kinds, self.goto, self.begins)
        starts[edges] = True  # an edge is a "word" of its own, which does not count
        first = np.flatnonzero(starts)
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), out=at[1:])
        begin = at[first]
        size = np.diff(np.append(begin, at[-1]))
        text_of = owner[np.searchsorted(edges, first)]
        real = kinds[first] != EDGE
        begin, size, text_of = begin[real], size[real], text_of[real]
        return np.bincount(text_of, self.lookup(joined.encode(), begin, size), many).astype(np.int64)

    def lookup(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The count of each word: remembered, or by the transducer."""
        known = self.known
        words = [raw[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist())]
        counts = np.array([known.get(w, -1) for w in words], np.int64)
        missed = np.flatnonzero(counts < 0)
        if len(missed):
            place = {words[k]: k for k in missed.tolist()}
            rows = np.array(list(place.values()))
            new = dict(zip(place, self.words.counts(np.frombuffer(raw, np.uint8), begin[rows], size[rows]).tolist()))
            counts[missed] = [new[words[k]] for k in missed.tolist()]
            room = MEMO - len(known)
            if room > 0:
                known.update((w, n) for w, n in list(new.items())[:room] if len(w) <= LONGEST_KNOWN)
        return counts


@lru_cache(maxsize=1)
def token_counter(path: str) -> TokenCounter:
    """One for all tasks of a worker."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, whole texts; a null text is an empty one and has
    no tokens. Ids may be null or repeat: each row is counted by itself. Texts may be of any length, with or without
    blanks. An empty table gives an empty one. Other columns, of any name, play no part."""

    def work(batches):
        counter = token_counter(vocabulary)
        for rows, data, places in blocks(batches, "text"):
            n = counter.count([t or "" for t in rows.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(places)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
