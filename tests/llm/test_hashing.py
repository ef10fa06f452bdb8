from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.hashing import shingle_sets, word_hashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.one_of(st.none(), st.text(alphabet="aAbBéß \t\n\x0b\x1c\u00a0", max_size=40))


def lower(t: str | None) -> list[str]:
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_and_shingles_match_regular_expressions(texts):
    column = pa.array(texts, pa.string())
    hashes, first = word_hashes(column)
    words = [w for t in texts for w in lower(t)]
    assert first.tolist() == np.cumsum([0, *[len(lower(t)) for t in texts]]).tolist()
    assert len({*zip(words, hashes.tolist(), strict=True)}) == len({*words}) == len({*hashes.tolist()})
    for t, s in zip(texts, shingle_sets(column), strict=True):
        ws = lower(t)
        want = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
        assert len(s) == len(want)


def test_long_word_and_slices():
    column = pa.array(["x", "y" * 3_000_000 + " Z", None, "z"]).slice(1)
    hashes, first = word_hashes(column)
    assert first.tolist() == [0, 2, 2, 3] and hashes[1] == hashes[2]
