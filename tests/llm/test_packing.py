from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm.packing import Packer, pack, token_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_tokens_equal_the_tokenizer():
    texts = [None, "", "The cat's, THE cat. <|endoftext|> <|ENDOFTEXT|>\tÉté\u2028x\x01y \x01 e\u0301 12.5!!", "a\x1cb ''s 'S .,"]
    t = Tokenizer.from_file(PATH)
    for x, b in zip(texts, token_bytes(texts, PATH), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(i * 37 % 900))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (62, "big text " * 9000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS start", "6 AS ids"), PATH, 2, capacity=1024).collect()
    texts = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        texts.setdefault(r["doc_id"], []).append(r)
    for i, t in dict(rows).items():
        if i != 61:
            got = [x for r in texts[i] for x in np.frombuffer(r["ids"], "<u4").tolist()]
            assert got == ids_of(t) and [r["start"] for r in texts[i]] == np.cumsum([0, *[r["length"] for r in texts[i]]])[:-1].tolist()
    assert len(texts[61]) == 2
    padding = total = 0
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in rs)
        assert [r["offset"] for r in rs] == np.cumsum([0, *[r["length"] for r in rs]])[:-1].tolist() and n <= 1024
        total += n
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding <= 0.01 * total


@pytest.mark.parametrize("cut", [True, False])
def test_limits_on_segments_and_loss(cut):
    rng = np.random.default_rng(0)
    p, want = Packer(64, 4, 20, 0, cut), {}
    for i in range(400):
        n = int(rng.integers(1, 90))
        want[i] = rng.integers(0, 1000, n).astype("<u4").tobytes()
        p.add(i, want[i], int(rng.integers(0, n + 1)))
    p.finish()
    got, seqs = {}, {}
    for r in p.take().to_pylist():
        got.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for rs in seqs.values():
        assert sum(r["length"] for r in rs) <= 64 and len(rs) <= 4 and sum(r["loss_tokens"] for r in rs) <= 20
    assert {i: b"".join(r["ids"] for r in sorted(rs, key=lambda r: r["start"])) for i, rs in got.items()} == want


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0


def test_limits_that_nothing_fits_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for limits in ({"max_loss": 0}, {"max_segments": 0}, {"capacity": 0}):
        with pytest.raises(ValueError):
            pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, **limits)
