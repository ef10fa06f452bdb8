from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import attention as A
from tallyspark.llm.fingerprints import edited_fingerprints, fingerprint, fingerprints, likeness
from tallyspark.llm.language_id import identify
from tallyspark.llm import license_scan as L
from tallyspark.llm.license_scan import cue_windows, scan
from tallyspark.llm.lm_scoring import _count, score_texts, spelling
from tallyspark.llm.queries import ORACLES, QUERIES, tokenizer_path
from tallyspark.llm.url_filter import host_levels, host_reputation, prior_weight, url_filter
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    compare(QUERIES[name](spark, SF), ORACLES[name], connect(SF))


def test_urls(spark):
    urls = ["http://A.example.com/en/71?x", "https://example.com/en/6#t", "ftp://x.net/de/", "http://example.net/de/8", "s://foo.org/es/1", None, "no scheme", "http://", "a://b://c/en/", "HTTP://com/en/", "http://xcom/en/", "http://good.io/a", "http://bad.io/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS low", "'h' AS host0")
    seen = spark.createDataFrame([(11, 0)] * 60 + [(12, 1)] * 60 + [(99, None), (None, 1)], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages, seen).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("example.com", "/en/6", "com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7][:2] == ("", "") and got[8][:2] == ("b:", "//c/en/")
    assert got[9][2] == "com/en/" and got[10][2] is None and got[11][3] == "allow" and got[12][3] == "block"
    assert url_filter(pages.where("false"), seen).count() == 0 and host_reputation(spark.createDataFrame([], "host string, bad int")).count() == 0


def test_fingerprints(spark):
    body = " ".join(f"w{i * i % 97}" for i in range(120))
    rows = [(3, body), (1, body.upper()), (2, "Intro words here " + body), (5, None), (4, ""), (6, "two words"), (None, "x"), (3, body), (9, "é" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS anchors0", "2 AS _zone")
    fp = {(r["doc_id"], r["text"]): r["anchors"] for r in fingerprints(df).collect()}
    assert fp[(3, body)] == fp[(1, body.upper())] and fp[(5, "")] == [] and len(fp[(6, "two words")]) == 1
    a, b = fp[(3, body)], fp[(2, "Intro words here " + body)]
    assert a == b[-len(a) :] or set(a) <= set(b)
    out = edited_fingerprints(df).withColumn("fp", fingerprint(F.col("anchors"))).withColumn("like", likeness(F.col("anchors"), F.col("next_anchors"))).collect()
    order = sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r, s in zip(order, order[1:] + order[:1], strict=True):
        half = len(r["text"]) // 2
        assert r["edited_text"] == r["text"][: len(r["text"]) - half] + s["text"][:half]
    one = edited_fingerprints(df.where("doc_id = 6")).first()
    assert one["edited_text"] == "two wotwo"[: 9 - 4] + "two " and edited_fingerprints(df.where("false")).count() == 0


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !!", "de"), (-4, "the with and of " * 5000, None), (None, "und der die ist nicht", "de")], "doc_id long, text string, lang string")
    out = identify(docs.unionByName(odd).withColumn("score", F.lit(7)).withColumn("lang_pred", F.lit("x")).withColumn("_letters", F.lit(0)), ["doc_id", "lang", "score", "lang_pred", "_letters"]).collect()
    assert out[0].__fields__.count("score") == out[0].__fields__.count("lang_pred") == 1 and all(r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and (r["doc_id"] or 0) >= 0]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and by[-4]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out)
    assert identify(docs.where("false"), ["doc_id"]).count() == 0


def _all_windows(ids, first, start):
    count = A.window_counts(first)
    text = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return *A.windows(ids, first, text, k, start), text


@pytest.mark.parametrize("attend", [True, False])
def test_attention_gradients_and_windows(attend):
    rng = np.random.default_rng(0)
    size = 300
    net = A.Attention(np.sort(rng.integers(1, 100, size))[::-1] + 0.5, attend=attend)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] = rng.normal(0, 0.3, net.p["out"].shape)
    ids = rng.integers(0, size, 90)
    x, target, text = _all_windows(ids, np.array([0, 50, 50, 90]), net.start)
    assert sorted(target[target >= 0].tolist()) == list(range(90))
    for row, t in zip(x, target, strict=True):
        for j, place in enumerate(t):
            if place >= 0:
                k = j + A.CONTEXT - A.SCORED
                assert row[k] == (ids[place - 1] if place not in (0, 50) else net.start)
    y, w = ids[np.maximum(target, 0)], (target >= 0).astype(float)

    def loss():
        return -(net.target_log_probs(x, y) * w).sum() / w.sum()

    g, rows_of = net._grads(x, y, w)
    for name, parts in rows_of.items():
        g[name] = np.zeros_like(net.p[name])
        for at, a in parts:
            g[name][at] += a
    for name in net.p:
        if not attend and name in "qkvo":
            continue
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            old = net.p[name][at]
            values = []
            for step in (1e-5, -1e-5):
                net.p[name][at] = old + step
                values.append(loss())
            net.p[name][at] = old
            assert abs((values[0] - values[1]) / 2e-5 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])) + 1e-5


def test_probabilities_of_all_ids_add_up_to_one():
    rng = np.random.default_rng(1)
    net = A.Attention(np.sort(rng.integers(1, 100, 700))[::-1] + 0.5)
    net.p["out"] = rng.normal(0, 0.5, net.p["out"].shape).astype(np.float32)
    x = np.repeat(rng.integers(0, 700, (1, A.CONTEXT)), -(-700 // A.SCORED), axis=0)
    total = np.zeros(A.SCORED)
    for i in range(0, 700):
        total += np.exp(net.target_log_probs(x[:1], np.full((1, A.SCORED), i))[0])
    assert np.allclose(total, 1, atol=1e-3)


def test_attention_scores_held_out_ids_better_than_without():
    """Each id depends on the one five places before it: only attention can see that."""
    rng = np.random.default_rng(2)

    def some(n):
        ids = rng.integers(0, 40, n)
        for i in range(5, n):
            ids[i] = (ids[i - 5] * 7 + 3) % 40 if rng.random() < 0.9 else ids[i]
        return _all_windows(ids, np.array([0, n]), 40)[:2], ids

    (x, target), ids = some(30_000)
    (hx, htarget), hids = some(4_000)
    losses = []
    for attend in (True, False):
        net = A.Attention(np.full(40, 100.0), attend=attend)
        step = net.learner()
        for i in range(500):
            at = np.random.default_rng(i).integers(0, len(x), 64)
            step(x[at], ids[np.maximum(target[at], 0)], (target[at] >= 0).astype(np.float32))
        losses.append(-net.target_log_probs(hx, hids[np.maximum(htarget, 0)])[htarget >= 0].mean())
    assert losses[0] < losses[1] - 0.2, losses


def test_spelling_tells_words_apart():
    own = spelling(tokenizer_path())
    words = ["é", "É", "e\u0301", "x", "\u0085x", "don't", "don’t", "ﬁ", "fi", "<|endoftext|>", "<|ENDOFTEXT|>".lower(), "中", "\u00a0", "a\u00a0b", "ab", "ÀB", "àb", "\ufffd"]
    words = sorted({w.encode() for w in words})
    ids = own.spell(words)
    assert len(set(ids)) == len(words)
    for data, word in zip(ids, words, strict=True):
        i = np.frombuffer(data, "<u4")
        final = ((i >= own.pieces) & (i < 2 * own.pieces)) | (i >= 2 * own.pieces + 256)
        assert final.tolist() == [False] * (len(i) - 1) + [True]
        spelt = b"".join(own.bytes[k % own.pieces] if k < 2 * own.pieces else bytes([(k - 2 * own.pieces) % 256]) for k in i.tolist())
        assert spelt == word


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Zyx zyx"), (None, "a b"), (-3, "Zyx zyx")], "doc_id long, text string")
    rows = docs.unionByName(odd).withColumn("n", F.lit(1)).withColumn("token", F.lit(2))
    import zlib

    plain = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in rows.collect()]
    train = [w for d, w in plain if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = Counter()
    for d, w in plain:
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        want[(d, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 5))] += 1
    out = score_texts(rows, tokenizer_path()).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out)
    assert got == want and all(r["score"] < 0 for r in out)
    assert score_texts(rows.where("false"), tokenizer_path()).count() == 0


def test_counts_split_over_batches():
    batch = pa.RecordBatch.from_pydict({"text": ["a b A", "b c"], "held_out": [False, True]})
    got = Counter()
    for out in _count(iter([batch, batch])):
        for _, n, seen in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[(n, seen)] += 1
    assert got == {(4, 4): 1, (2, 4): 1, (0, 2): 1}


def test_licences(spark):
    files = [("a/LICENSE", "MIT License\nReleased under the MIT License."), ("a/b/c.py", "code"), ("a/b/d.py", "# Licensed under the Apache License, Version 2.0."), ("a/b/COPYING", "licensed under cc by-nc 4.0."), ("x/y.py", "a license to talk about many other things of no use here"), ("top.py", None), (None, "text"), ("a/b/c.py", "code")]
    got = {}
    for r in scan(spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 AS own", "2 AS folder")).collect():
        got.setdefault(r["path"], []).append((r["licence"], r["inherited_from"]))
    assert got["a/LICENSE"] == [("MIT", None)] and got["a/b/d.py"] == [("Apache-2.0", None)] and got["a/b/COPYING"] == [("CC-BY-NC-4.0", None)]
    assert got["a/b/c.py"] == [("CC-BY-NC-4.0", "a/b")] * 2 and got["x/y.py"] == [(None, None)] and got["top.py"] == [(None, None)] and got[None] == [(None, None)]
    assert scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licences_in_windows(spark):
    noise = "one two three four five six seven"
    files = [("a", f"{noise} Released under the MIT License. {noise} {noise}"), ("b", "x\n// SPDX-License-Identifier: MIT\ncode"), ("c", "GNU GENERAL PUBLIC LICENSE"), ("d", f"{noise}\nThis work is licensed under the GNU General Public\nLicense, version 2. {noise}"), ("e", "SPDX-License-Identifier: GPL-2.0"), ("f", "SPDX-License-Identifier: Unknown")]
    got = {r["path"]: r["licence"] for r in scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a": "MIT", "b": "MIT", "c": None, "d": "GPL-2.0", "e": "GPL-2.0", "f": None}


def test_licences_inherited_as_by_brute_force(spark):
    rng = np.random.default_rng(3)
    folders = ["/".join(rng.choice(["a", "b"], k)) for k in rng.integers(0, 5, 40)]
    licence = {f: ("MIT", "Released under the MIT License.") if i % 2 else ("CC-BY-4.0", "Licensed under CC BY 4.0.") for i, f in enumerate(dict.fromkeys(folders[:6]))}
    join = lambda f, name: f"{f}/{name}" if f else name
    files = [(join(f, "LICENSE"), t) for f, (_, t) in licence.items()] + [(join(f, f"{i}.py"), "code") for i, f in enumerate(folders)]
    got = {r["path"]: (r["licence"], r["inherited_from"]) for r in scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for i, f in enumerate(folders):
        up = [x for x in licence if x in ("", f) or f.startswith(x + "/")]
        near = max(up, key=len, default=None)
        assert got[join(f, f"{i}.py")] == ((licence[near][0], near) if up else (None, None))


def test_edited_hash_matches(spark):
    r = QUERIES["op8_fingerprints"](spark, SF).orderBy("doc_id").collect()
    texts = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    for i, row in enumerate(r):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert row["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and row["n_chars"] == len(t)


def test_lm_scores_do_not_depend_on_what_is_held(spark, monkeypatch):
    """Words beyond those held in every task count the same."""
    from tallyspark.llm import lm_scoring as L

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "qzxv jjkq qzxv"), (None, "qzxv"), (-3, "qzxv unseenqq"), (-5, "qzxv wwqk")], docs.schema))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"])
    run = lambda: sorted(((key(r), round(r["base_score"], 6), round(r["score"], 4)) for r in score_texts(docs, tokenizer_path()).collect()), key=repr)
    monkeypatch.setattr(L, "ROUNDS", 1)
    few = []
    for words in (1 << 18, 20):
        monkeypatch.setattr(L, "HELD_WORDS", words)
        few.append(run())
    assert few[0] == few[1]


def test_lm_fits_every_window_of_every_text(monkeypatch):
    """Pieces dealt over all rounds hold each window of each text as often as passes says, as it stands in the whole text."""
    from tallyspark.llm import lm_scoring as L

    rng = np.random.default_rng(3)
    lengths = [1, 2, 15, 16, 17, 1023, 1024, 1025, 1056, 5000, 40_000]
    texts = [rng.integers(0, 500, n).astype("<u4") for n in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts)) + (7 << 40)), pa.array([t.tobytes() for t in texts], pa.binary())], names=["row", "ids"])
    ids, first = L.streams_of(batch.column("ids"))
    count = L.window_counts(first)
    text = np.repeat(np.arange(len(count)), count)
    x, target = L.windows(ids, first, text, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count), 500)
    want = Counter(r.tobytes() for r in np.concatenate([x, np.where(target >= 0, ids[np.maximum(target, 0)], 501)], axis=1).astype(np.int32))
    for times in (1, 2, 3, 4):
        got, parts = Counter(), set()
        for k in range(L.ROUNDS):
            for b in L._dealt(5, k, times)([batch]):
                got.update(r.tobytes() for r in L._windows_of(b.column("x"), b.column("skip").to_numpy(), np.arange(502), 500))
                parts |= set(b.column("part").to_pylist())
        assert got == Counter({w: n * times for w, n in want.items()}) and parts == set(range(5))
    assert [L.passes(n) for n in (0, 1, L.LEAST_WINDOWS // 3, L.LEAST_WINDOWS, 1 << 40)] == [4, 4, 4, 1, 1]


def test_lm_parts_learn_from_their_mean(spark, monkeypatch):
    """Many parts give a model that scores held-out texts better than the counts of ids alone, which no fit leaves."""
    from tallyspark.llm import lm_scoring as L

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    total = lambda: sum(r["score"] for r in score_texts(docs, tokenizer_path()).where("held_out").collect())
    monkeypatch.setattr(L, "PART_WINDOWS", 10_000)
    fitted = total()
    monkeypatch.setattr(L, "ROUNDS", 0)
    assert fitted > 0.95 * total()  # both are negative


def test_lm_scores_held_out_texts_above_their_base(spark):
    """On 1,000 documents held-out texts get more than their unigram base, and that base is a plain count's."""
    folder = SF.replace("sf0.001", "sf0.01")
    got = QUERIES["op2_lm_scoring"](spark, folder).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.5
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    texts = {r["doc_id"]: (r["text"] or "").encode().translate(lower) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    words = {d: [w for w in re.split(rb"[\x20\x09-\x0D]+", t) if w] + [None] for d, t in texts.items()}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(words)
    for r in got.itertuples():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws)


def test_lm_rare_ids_stand_behind_one_entry():
    """Ids beyond TAIL cost the first softmax one entry, and all ids still add up to one."""
    rng = np.random.default_rng(4)
    size = 6000
    net = A.Attention(np.sort(rng.integers(1, 100, size))[::-1] + 0.5)
    assert net.p["head"].shape[1] == np.searchsorted(net.edges, 4096) + 1 < len(net.edges) - 1
    net.p["out"] = rng.normal(0, 0.3, net.p["out"].shape).astype(np.float32)
    x = rng.integers(0, size, (1, A.CONTEXT))
    lp = [net.target_log_probs(x, np.arange(i, i + A.SCORED)[None])[0, 0] for i in range(0, size, A.SCORED)]
    first = np.array([net.target_log_probs(x, np.full((1, A.SCORED), i))[0, 0] for i in range(size)])
    assert np.allclose(lp, first[:: A.SCORED], atol=1e-4) and abs(np.exp(first.astype(float)).sum() - 1) < 1e-3
    for i in range(60):
        target = rng.integers(4096, size, (8, A.SCORED))
        if i == 0:
            before = net.target_log_probs(np.repeat(x, 8, axis=0), target).mean()
            step, at = net.learner(), target
        step(np.repeat(x, 8, axis=0), at, np.ones(at.shape, np.float32))
    assert net.target_log_probs(np.repeat(x, 8, axis=0), at).mean() > before + 1


def test_lm_words_share_the_spelling_of_their_stems(monkeypatch):
    """Marks behind a word need no encoding of their own for each word, and ids are those of the whole word."""
    from tallyspark.llm.lm_scoring import Spelling
    from tallyspark.llm.packing import token_bytes

    own, asked = Spelling(tokenizer_path()), []
    encoded = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda texts: asked.extend(texts) or encoded(texts))
    stems = [f"thr{a}nd{b}" for a in "aeiou" for b in "aeiou"] + ["caf\u00e9", "x1"]
    words = [s + m for s in stems for m in ("", "***", "###", "%%%", ",&&&", "!!", "?")]
    got = own.spell([w.encode() for w in words])
    assert len(asked) == len(set(asked)) == len(stems) + 6
    odd = ["don't", "'s", "a's.", "a'***", "\u00d7**", "<|endoftext|>", "a<|", "***", "a\x01b", "\u4e2d\u6587!", "e\u0301", "e\u0301!"]
    for word, ids in zip(words + odd, got + own.spell([w.encode() for w in odd]), strict=True):
        ids, plain = np.frombuffer(ids, "<u4").copy(), np.frombuffer(token_bytes([word], tokenizer_path())[0], "<u4")
        last = ids[-1] - own.pieces
        if b"".join(own.bytes[k] for k in plain) == word.encode():
            assert [*ids[:-1], last] == plain.tolist()
        else:
            assert (ids[:-1] - 2 * own.pieces).tolist() + [ids[-1] - 2 * own.pieces - 256] == list(word.encode())


def test_whole_licences_and_headers(spark):
    """Full texts and headers are named with and without titles and tags; an opening that two licences share decides nothing alone."""
    full = {}
    for name, text in L.TEXTS:
        if len(text) > len(full.get(name, "")):
            full[name] = text
    wrap = lambda t: "\n".join("// " + t[i : i + 70] for i in range(0, len(t), 70))  # noqa: E731  lines cut inside words too
    lines = lambda t: "\n".join(" * " + " ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11))
    files = [(f"{n}/plain/x.c", t, n) for n, t in full.items()] + [(f"{n}/lines/x.c", lines(t), n) for n, t in full.items()]
    files += [(f"{n}/titled/x.c", f"{n} License\n\nCopyright (c) 2020 Some Body\n\n{t}", n) for n, t in full.items() if n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]
    code = "\n".join(f"int f{i}(int a{i}) {{ return a{i} * {i}; }}" for i in range(60))
    files += [(f"{n}/code/x.c", f"/*\n{lines(t)}\n */\n\n{code}", n) for n, t in full.items() if n in ("Apache-2.0", "GPL-3.0", "MPL-2.0", "MIT")]
    files += [(f"tag{i}/x.c", f"// SPDX-License-Identifier: {n}\n{code}", n) for i, n in enumerate(full)] + [("none/x.c", code, None), ("none/y.txt", "words of no use here " * 50, None)]
    got = {r["path"]: r["licence"] for r in scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert {p: got[p] for p, _, n in files if got[p] != n} == {}
    assert wrap("a") == "// a"


def test_suffixes_and_prior_strength(spark):
    hosts = spark.createDataFrame([("a.b.example.co.uk",), ("example.co.uk",), ("x.example.com",), ("localhost",), ("co.uk",)], "h string")
    domain, suffix = host_levels(F.col("h"))
    assert [tuple(r) for r in hosts.select(domain, suffix).collect()] == [("example.co.uk", "co.uk"), ("example.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("co.uk", "co.uk")]
    alike = prior_weight(spark.createDataFrame([(10, 2)] * 50, "n long, bad long")).first()["weight"]
    apart = prior_weight(spark.createDataFrame([(10, 0), (10, 10)] * 25, "n long, bad long")).first()["weight"]
    rng = np.random.default_rng(0)
    drawn = [(30, int(rng.binomial(30, rng.beta(4, 12)))) for _ in range(400)]
    fitted = prior_weight(spark.createDataFrame(drawn, "n long, bad long")).first()["weight"]
    assert alike == 1000 and apart == 1 and 11 < fitted < 23


def test_runs_around_many_cues(spark):
    """20,000 cue words in a row take linear time; runs equal those of a plain loop."""
    rng = random.Random(0)
    cues, lengths = {"license", "warranty"}, [2, 3, 7]
    for _ in range(10):
        w = [rng.choice(["license", "a", "b", "c", "warranty"]) for _ in range(rng.randrange(40))]
        want = {" ".join(w[s : s + n]) for i, x in enumerate(w) if x in cues for n in lengths for s in range(max(0, i - n + 1), i + 1)}
        got = spark.createDataFrame([(w,)], "w array<string>").select(cue_windows(F.col("w"), lengths).alias("x")).first().x
        assert set(got) == want and len(got) == len(want)
    began = time.perf_counter()
    found = scan(spark.createDataFrame([("d/many", "license word " * 20_000), ("d/one", "Licensed under the Apache License, Version 2.0")], "path string, text string")).collect()
    assert len(found) == 2 and time.perf_counter() - began < 60


def test_urls_without_a_host_share_no_reputation(spark):
    pages = spark.createDataFrame([(i, "no host here") for i in range(200)] + [(200 + i, f"http://good{i % 5}.org/x") for i in range(200)] + [(400, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "page_id long, bad int")
    assert host_reputation(spark.createDataFrame([("", 1), ("a.org", 0)], "host string, bad int")).select("host").collect()[0][0] == "a.org"
    assert {r.verdict for r in url_filter(pages, outcomes).collect()} == {"allow"}


def plain_likeness(a, b):
    first = [{h: i for i, h in reversed(list(enumerate(x)))} for x in (a, b)]
    shifts = Counter(first[1][h] - i for h, i in first[0].items() if h in first[1])
    least = min(3, *map(len, first))
    matched = sum(n for n in shifts.values() if n >= least)
    whole = len(first[0]) + len(first[1])
    return 1.0 if not whole else matched / (whole - matched)


def test_likeness_compares_places(spark):
    rng = random.Random(5)
    whole = list(range(40))
    cases = [([], []), ([1], []), ([1], [1]), (whole, whole), (whole, whole[::-1]), (whole, whole[:20] + whole[25:]), (whole, [99] * 5 + whole), (whole * 2, whole), (whole, rng.sample(whole, 40))]
    cases += [([rng.randrange(30) for _ in range(rng.randrange(50))], [rng.randrange(30) for _ in range(rng.randrange(50))]) for _ in range(60)]
    df = spark.createDataFrame(cases, "a array<int>, b array<int>").select("a", "b", likeness(F.col("a"), F.col("b")).alias("x"))
    for r in df.collect():
        assert abs(r.x - plain_likeness(r.a, r.b)) < 1e-12, (r.a, r.b)
    got = [plain_likeness(*c) for c in cases[:8]]
    assert got[:4] == [1.0, 0.0, 1.0, 1.0] and got[4] < 0.1 and got[5] == 35 / 40 and got[6] == 40 / 41 and got[7] == 1.0
    long = [rng.randrange(1 << 30) for _ in range(30_000)]
    assert spark.createDataFrame([(long, long[1000:])], "a array<int>, b array<int>").select(likeness(F.col("a"), F.col("b")).alias("x")).first().x > 0.9
