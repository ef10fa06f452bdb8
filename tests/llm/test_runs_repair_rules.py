"""Periodic runs, conversation repair and quality rules against plain versions and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

from tallyspark.llm import conversation_repair as cr
from tallyspark.llm import periodic_runs as pr
from tallyspark.llm import quality_rules as qr
from tallyspark.llm import queries
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x, least=12):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            if e - s + q >= max(least, 2 * q):
                out.setdefault((s, e - s + q), q)
            s = max(e, s + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


def test_cover_meets_every_difference_once():
    found = sorted((b - a) % pr.COVER_MODULUS for a, b in product(pr.COVER, pr.COVER) if a != b)
    assert found == list(range(1, pr.COVER_MODULUS))


def test_extensions_and_runs_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(1, 300), rng.choice([1, 2, 3, 40])
        x = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 60)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            x[rng.randrange(n)] = rng.randrange(k)
        w = np.array(x, np.int64)
        i, j = (np.array(v) for v in zip(*[sorted(rng.sample(range(n + 1), 2)) for _ in range(40)], strict=True))
        want = [next((t for t in range(n) if b + t >= n or x[a + t] != x[b + t]), n) for a, b in zip(i, j, strict=True)]
        assert pr.Extensions(w)(i, j).tolist() == want
        least = rng.choice([12, 2, 4])
        assert [(s, q, m) for s, m, q in pr.runs_of(w, least).tolist()] == plain_runs(x, least)


def test_runs_of_a_text_longer_than_the_ready_grid():
    x = np.random.default_rng(0).integers(0, 2, 5000)
    x[2000:] = x[2000:][np.arange(3000) % 1100]
    assert [(s, q, m) for s, m, q in pr.runs_of(x).tolist()] == plain_runs(x.tolist())
    assert pr.runs_of(np.zeros(50_000, np.int64)).tolist() == [[0, 50_000, 1]]


def test_runs_query_on_a_fixture(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("a b c dd é 漢".split()) for _ in range(rng.randrange(80))), "en") for i in range(60)]
    docs += [(60, None, None), (61, "", "en"), (None, "x " * 30, "en"), (3, docs[3][1], "en"), (64, "\t\n \x0b  x x", None), (70, "z " * 9000, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in docs:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 1000 else [(0, 1, n)]
        gone = {i for s, q, m in runs for i in range(s + q, s + m)}
        best = min(((-m, s, q) for s, q, m in runs), default=None)
        four = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, q, m in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert got == sorted(want, key=repr)


def test_runs_keep_other_columns_and_take_empty_tables(spark):
    df = spark.createDataFrame([("a b " * 8, 7, "x")], "text string, n int, collapsed string")
    row = pr.periodic_runs(df).first()
    assert row.n == 7 and row.collapsed == "a b" and [tuple(r) for r in row.runs] == [(0, 16, 2)]
    assert pr.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(df, least=1)


FORM = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """The cheapest, ASCII-least edits by trying all; rows are (initial, fault)."""
    best = None

    def go(k, cost, audit, said, added):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows):
            if FORM.fullmatch(said):
                best = min(best or (10**9, ""), (cost, audit))
        else:
            c, fault = rows[k]
            cut = fault == "truncated"
            go(k + 1, cost + 3, audit + "D", said, 0)
            if fault not in ("blank", "duplicate"):
                if c:
                    go(k + 1, cost + cut, audit + "K", said + c, 0)
                for r in "ua":
                    go(k + 1, cost + 2 + cut, audit + "R", said + r, 0)
        if added < 2:
            for r in "ua":
                go(k, cost + 2, audit + "I", said + r, added + 1)

    best = (3 * len(rows), "D" * len(rows))
    go(0, 0, "", "", 0)
    return best


def test_lightest_repairs_equal_all_tried():
    rng = random.Random(9)
    for _ in range(150):
        rows = [(rng.choice("suat"), rng.choice([None, None, None, "truncated", "blank"])) for _ in range(rng.randrange(5))]
        symbols = "".join("x" if f == "blank" else (c if c in "sua" else "o").upper() if f else c if c in "sua" else "o" for c, f in rows)
        whole = cr.joined_items([cr.block_items(symbols)])
        assert (whole[0].cost, whole[0].audit) == plain_repair(rows), rows


def test_joined_blocks_equal_one_block():
    rng = random.Random(4)
    for _ in range(300):
        symbols = "".join(rng.choice("suaouaUAx") for _ in range(rng.randrange(1, 40)))
        one = cr.joined_items([cr.block_items(symbols)])[0]
        cuts = sorted({0, len(symbols), *(rng.randrange(len(symbols) + 1) for _ in range(5))})
        parts = cr.joined_items([cr.block_items(symbols[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        assert (sum(p.cost for p in parts), "".join(p.audit for p in parts)) == (one.cost, one.audit)


CHAT = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be brief."), (1, 9, "assistant", "no end"),
    (2, 0, "assistant", " \t"), (2, 1, None, None), (None, 0, "user", "Lost?"), (None, None, None, "x"), (3, 5, "", "Empty role."), (3, 6, "user", "A" * 200_000 + "."),
    (4, 0, "user", "Same!"), (4, 1, "user", "Same!"), (4, 2, "sales", "S."), (5, 0, "tool", "T."),
]


def test_repair_query_equals_its_twin(spark, tmp_path):
    chat = CHAT + [(6, t, "user" if t % 2 else "assistant", f"Turn {t % 50}{'.' if t % 7 else ''}") for t in range(300)]
    spark.createDataFrame(chat, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/chat")
    next((tmp_path / "chat").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    con = connect(str(tmp_path))
    compare(queries.op12_conversation_repair(spark, str(tmp_path)), queries.ORACLES["op12_conversation_repair"], con)


def test_a_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_BITS", 3)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(400)}{rng.choice('..x')}") for t in range(200)] + CHAT
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    turns, report = cr.repair(df)
    few = {r.conv_id: r for r in report.collect()}
    lines = {r.conv_id: r.repaired_sha256 for r in cr.digests(turns).collect()}
    monkeypatch.setattr(cr, "BLOCK_BITS", 12)
    turns, report = cr.repair(df)
    assert few == {r.conv_id: r for r in report.collect()} and len(few) == 6
    assert lines == {r.conv_id: r.repaired_sha256 for r in cr.digests(turns).collect()}
    said = "".join(r.role[0] for r in turns.where("conv_id = 1").orderBy("pos", "seq").collect())
    assert said and FORM.fullmatch(said)


def test_repair_of_nothing(spark):
    turns, report = cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert turns.collect() == [] and report.collect() == [] and cr.digests(turns).collect() == []


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(3)
    some = [" ".join(rng.choice("the of a Hund Été x1 ok. ?".split()) + rng.choice(["", "", "\n", "$"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    return [*some, None, "", "\n\n", "a b\na b\n\n \n a b", "word " * 50, " ".join(map(str, range(30_000))) + " tail " * 9, "x" * 100_000, "SHOUT!! NOW!! " * 3 + "a b c d e f g h i j k l m n o", "   ", some[0]]


def test_counts_equal_plain_ones(spark):
    rows = [(t, "kept") for t in texts()]
    df = spark.createDataFrame(rows, "text string, n_words string")
    out = qr.judge(df).collect()
    key = lambda r: r[0] or ""
    got = sorted(((r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=key)
    want = []
    for t, _ in rows:
        c = plain_counts(t)
        want.append((t, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want, key=key)
    assert all(r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept) for r in out)


def test_the_order_of_rules_changes_no_verdict(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    one = [qr.judge(df, rules=r).groupBy("text").agg({"kept": "max"}).collect() for r in (qr.RULES, qr.RULES[::-1])]
    assert sorted(map(repr, one[0])) == sorted(map(repr, one[1]))
    assert {r.name for r in qr.rule_order(df)} == {r.name for r in qr.RULES}
    assert [r.name for r in qr.rule_order(df.limit(0))] == [r.name for r in qr.RULES]
    assert qr.judge(df.limit(0)).collect() == []


def test_rules_that_reject_more_per_cost_come_first():
    figures = [("symbols", 1.0, 0.1), ("letters", 0.1, 0.1), ("shouting", 2.0, 0.9), *((r.name, 1.0, 0.0) for r in qr.RULES if r.name not in ("symbols", "letters", "shouting"))]
    assert [r.name for r in qr.ordered(qr.RULES, figures)][:3] == ["letters", "shouting", "symbols"]


def test_clean_texts_stay_and_junk_goes(spark):
    clean = "The harbour was quiet that morning, and few boats went out before the fog had lifted. We walked along the pier to see whether the market had opened."
    junk = [" ".join(f"{w}$$$" for w in clean.split()), " ".join(f"{w.upper()}!!" for w in clean.split()), " | ".join(clean.split()), "\n".join(["same line here"] * 3 + clean.split()[:2]) + clean, "und " * 60]
    got = {r.text: r.kept for r in qr.judge(spark.createDataFrame([(t,) for t in [clean, *junk]], "text string")).collect()}
    assert got.pop(clean) and not any(got.values())


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_quality_rules"])
def test_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    compare(queries.QUERIES[name](spark, sf), queries.ORACLES[name], connect(sf))
