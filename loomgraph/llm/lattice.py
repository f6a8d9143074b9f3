"""Subword lattices: pieces of a SentencePiece vocabulary as byte strings, with a blank for the word mark."""

from __future__ import annotations

import math

import numpy as np

MARK = "▁"
#: Bytes beyond which a word is worked on by itself, place by place.
LONG = 2048


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Spelling, score and kind of each piece of a model file, by id: kind 0 is a piece of text, 1 a single byte (of
    the fallback), 2 the end of a text, 3 anything else (no spelling); and how the model was made (1: unigram)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    spelled, scores, kinds = [], [], []
    for k, p in enumerate(model.pieces):
        if processor.is_byte(k):
            spelled.append(bytes([int(p.piece[3:5], 16)]))
            kinds.append(1)
        elif p.type in (proto.ModelProto.SentencePiece.NORMAL, proto.ModelProto.SentencePiece.USER_DEFINED):
            spelled.append(p.piece.replace(MARK, " ").encode())
            kinds.append(0)
        else:
            spelled.append(b"")
            kinds.append(2 if k == processor.eos_id() else 3)
        scores.append(p.score)
    return spelled, np.array(scores), np.array(kinds), model.trainer_spec.model_type


class Pieces:
    """The pieces as a trie of their bytes from the last to the first, so that a walk back from a place meets those that
    end there. The fallback's bytes are found apart, by value."""

    BITS = 20

    def __init__(self, spelled: list[bytes], kinds: np.ndarray):
        self.edges: dict[int, int] = {}
        ids = [-1]
        for k in np.flatnonzero(kinds == 0).tolist():
            node = 0
            for x in reversed(spelled[k]):
                node = self.edges.setdefault(node << 8 | x, len(ids))
                if node == len(ids):
                    ids.append(-1)
            ids[node] = k
        self.ids = np.array(ids)
        keys = np.array(list(self.edges), np.int64)
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(self.edges.values()), np.int64)[order], 0)
        self.taken = np.zeros(1 << self.BITS, bool)  # tells most pairs that are no edge without a search
        self.taken[self.slot(keys)] = True
        self.of_byte = np.full(256, -1)
        for k in np.flatnonzero(kinds == 1):
            self.of_byte[spelled[k][0]] = k

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have an edge of the byte, and where it leads."""
        keys = node << 8 | byte
        maybe = np.flatnonzero(self.taken[self.slot(keys)])
        at = np.searchsorted(self.keys, keys[maybe])
        there = self.keys[at] == keys[maybe]
        return maybe[there], self.to[at[there]]

    def before(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """Length and id of every piece that ends at place i of the word."""
        found, node = [], 0
        for n in range(1, i + 1):
            node = self.edges.get(node << 8 | word[i - n])
            if node is None:
                break
            if self.ids[node] >= 0:
                found.append((n, int(self.ids[node])))
        fallback = int(self.of_byte[word[i - 1]])
        return found + [(1, fallback)] * (fallback >= 0)


class WordLattice:
    """All segmentations of words at once, words of like lengths in step; those of more than LONG bytes one by one, with
    two numbers for each place."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p

    def batches(self, size: np.ndarray, cells: int = 2_000_000):
        order = np.argsort(size, kind="stable")
        order = order[: np.searchsorted(size[order], LONG, "right")]
        k = 0
        while k < len(order):
            room = size[order[k:]] * np.arange(1, len(order) - k + 1)
            many = max(1, int(np.searchsorted(room, cells, "right")))
            yield order[k : k + many]
            k += many

    def edges(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """(end, length, rows, ids) of every piece that ends at each place, of words whose sizes rise."""
        width = int(size.max(initial=0))
        begin = np.searchsorted(size, np.arange(1, width + 1))
        for i in range(1, width + 1):
            rows = np.arange(begin[i - 1], len(start))
            fallback = self.pieces.of_byte[data[start[rows] + i - 1]]
            there = fallback >= 0
            if there.any():
                yield i, 1, rows[there], fallback[there]
            node = np.zeros(len(rows), np.int64)
            for n in range(1, i + 1):
                on, node = self.pieces.step(node, data[start[rows] + i - n])
                rows = rows[on]
                if not len(rows):
                    break
                ids = self.pieces.ids[node]
                hit = ids >= 0
                if hit.any():
                    yield i, n, rows[hit], ids[hit]

    def forward(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The natural logarithm of each word's probability, over all its segmentations."""
        out = np.empty(len(start))
        for rows in self.batches(size):
            alpha, _ = self.alpha(data, start[rows], size[rows])
            out[rows] = alpha[size[rows], np.arange(len(rows))]
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self.long_alpha(data[start[k] : start[k] + size[k]].tobytes())[-1]
        return out

    def alpha(self, data, start, size) -> tuple[np.ndarray, list]:
        alpha = np.full((int(size.max(initial=0)) + 1, len(start)), -np.inf)
        alpha[0] = 0
        edges = list(self.edges(data, start, size))
        for i, n, rows, ids in edges:
            alpha[i, rows] = np.logaddexp(alpha[i, rows], alpha[i - n, rows] + self.log_p[ids])
        return alpha, edges

    def long_alpha(self, word: bytes) -> np.ndarray:
        alpha, log_p = np.full(len(word) + 1, -np.inf), self.log_p.tolist()
        alpha[0] = 0
        for i in range(1, len(word) + 1):
            alpha[i] = log_sum([alpha[i - n] + log_p[k] for n, k in self.pieces.before(word, i)])
        return alpha

    def expected(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each taken so many times: posterior counts."""
        out = np.zeros(len(self.log_p))
        for rows in self.batches(size):
            s, z, t = start[rows], size[rows], times[rows]
            alpha, edges = self.alpha(data, s, z)
            beta = np.full_like(alpha, -np.inf)
            beta[z, np.arange(len(rows))] = 0
            total = alpha[z, np.arange(len(rows))]
            for i, n, r, ids in reversed(edges):
                step = beta[i, r] + self.log_p[ids]
                out += np.bincount(ids, t[r] * np.exp(np.minimum(0, alpha[i - n, r] + step - total[r])), len(out))
                beta[i - n, r] = np.logaddexp(beta[i - n, r], step)
        for k in np.flatnonzero(size > LONG).tolist():
            word = data[start[k] : start[k] + size[k]].tobytes()
            alpha = self.long_alpha(word)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i in range(len(word), 0, -1):
                for n, piece in self.pieces.before(word, i):
                    step = float(beta[i] + self.log_p[piece])
                    out[piece] += times[k] * math.exp(min(0, float(alpha[i - n] + step - alpha[-1])))
                    beta[i - n] = log_sum([beta[i - n], step])
        return out


def log_sum(terms: list[float]) -> float:
    most = max(terms, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum(math.exp(t - most) for t in terms))
