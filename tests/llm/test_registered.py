"""The registered queries without SQL on the smallest tables, against libraries and plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_dedup import removed

from loomgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, texts):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted({r["doc_id"] for r in rows}) == sorted(texts)
    return rows


def left_over(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts == 2


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows_of(spark, "op1_token_counts", texts):
        n = len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_op2_op3(spark, texts):
    for name in ("op2_quality_classifier", "op3_language_id"):
        rows = rows_of(spark, name, texts)
        assert len(rows) == len(texts)
        for r in rows:
            assert r["held_out"] == left_over(r["doc_id"], 4) and 0 <= r["score"] <= 1
            if "predicted" in r:
                assert r["predicted"] == (r["score"] >= 0.7)
            else:
                assert r["lang_pred"] in ("en", "de", "fr", "es") or not any(map(str.isalpha, texts[r["doc_id"]]))


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = {}, {}
    for r in rows_of(spark, "op5_best_fit_packing", texts):
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, mine in pieces.items():
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        mine.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 4096)) and [r["piece"] for r in mine] == list(range(len(mine)))
        for r in mine:
            cut = ids[r["start"] : r["start"] + 4096]
            assert r["length"] == len(cut) and r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1.02 * math.ceil(sum(length for s in places.values() for _, length in s) / 4096) + 1


def test_op7(spark, texts):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows_of(spark, "op7_sentencepiece", texts):
        ids = p.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_op8(spark, texts):
    tokens = {i: [*re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not left_over(i, 7) for w in ws)
    n, v = counts.total(), len(counts)
    for r in rows_of(spark, "op8_lm_scoring", texts):
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (left_over(r["doc_id"], 7), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_op9(spark, texts):
    expected = removed(sorted(texts.items()), 100)
    for r in rows_of(spark, "op9_suffix_array_dedup", texts):
        kept, spans = expected[r["doc_id"]]
        whole = len(texts[r["doc_id"]].encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (whole, whole - len(kept), spans, hashlib.sha256(kept).hexdigest())
