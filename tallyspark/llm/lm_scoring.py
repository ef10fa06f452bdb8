"""Scoring texts with a causal self-attention language model on subword ids.

A word is the pieces that a public tokenizer gives it, the last one marked as final; a word that its
pieces do not spell exactly (the tokenizer folds case and composes marks) is its bytes instead. One end
id closes a text. So a text is one sequence of ids, no two texts share one, and ids depend on no corpus.
The model (attention.py) starts from the counts of all ids of all training texts, is fitted on all windows
of all training texts, and scores every id of a text once, in overlapping windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.attention import BATCH, CONTEXT, SCORED, Attention, keep_memory, padded_texts, window_counts, windows, windows_at  # noqa: F401  windows: what padded texts are held against in tests
from tallyspark.llm.common import materialize
from tallyspark.llm.hashing import mix, sub_batches, text_bytes, word_hashes, word_spans
from tallyspark.llm.packing import token_bytes

#: Words whose counts every task holds (the most frequent); the counts of others are looked up by a join, with the same result.
HELD_WORDS = 1 << 18
#: Rounds of fitting. All of them together fit every window once; where that is less than LEAST_WINDOWS, up to ROUNDS times.
ROUNDS, LEAST_WINDOWS = 4, 1 << 18
#: Windows fitted in one stream, and most streams side by side: beyond, each becomes longer.
PART_WINDOWS, MOST_PARTS = 80_000, 1000
#: Windows of a text that are dealt together, and windows of a stream whose order is mixed.
DEALT_TOGETHER, MIXED_TOGETHER = 64, 1 << 14
#: Ids whose weights travel together to the mean of all streams.
ROW_BLOCK = 1024
#: Words counted together in a task, and words whose ids a task remembers.
COUNTED_TOGETHER, REMEMBERED = 1 << 21, 400_000
#: Marks that end a word; not the apostrophe, which contractions begin with.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands between words that are encoded together.
_BETWEEN = "\x01"
#: Words, and tokens of the corpus, for each slice of the look-up.
SLICE_WORDS, SLICE_TOKENS = 50_000, 4_000_000
#: Windows scored together.
SCORED_TOGETHER = 512


def training(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves anything but 1 when divided by 5; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n, seen): words of some texts at a time, counted in training texts and in all."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        tokens, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = [np.bincount(back, weights=np.concatenate([h[i] for h in held]), minlength=len(tokens)).astype(np.int64) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(tokens), *map(pa.array, sums)], names=["token", "n", "seen"])

    total = 0
    for whole in batches:
        for batch in sub_batches(whole, "text", 4 << 20):
            hashes, first = word_hashes(batch.column("text"))
            tokens, back = np.unique(hashes.view(np.int64), return_inverse=True)
            trains = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(back, weights=np.repeat(trains, np.diff(first)), minlength=len(tokens))
            held.append((tokens, n, np.bincount(back, minlength=len(tokens))))
            total += len(hashes)
            if total >= COUNTED_TOGETHER:
                yield out()
                held, total = [], 0
    if held:
        yield out()


class Spelling:
    """Ids of words: pieces that go on, final pieces, bytes that go on, final bytes, and the end."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        mark = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self._mark = mark if len(mark) == 1 else []
        vocabulary = self._tokenizer.get_vocab()
        self.path, self.pieces = tokenizer_path, max(vocabulary.values()) + 1
        # Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes = [b""] * self.pieces
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(byte.get(c, 0) for c in piece.removesuffix("</w>"))
        self.end = 2 * self.pieces + 512
        self.size = self.end + 1
        self._ids: dict[int, bytes] = {}
        self._parts: dict[bytes, bytes] = {}
        self._final: dict[bytes, bytes] = {}

    def _parts_of(self, word: bytes) -> tuple[bytes, ...]:
        """The word, or its stem and the marks behind it, which the tokenizer never joins to a letter or digit."""
        stem = word.rstrip(_MARKS)
        if len(stem) < len(word) and (stem[-1:].isalnum() or (stem[-2:-1] == b"\xc3" and stem[-1:] not in (b"\x97", b"\xb7"))) and b"<|" not in word:
            return stem, word[len(stem) :]
        return (word,)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's ids of each text; many go in one call, told apart by a mark that is one id."""
        if not self._mark:
            return token_bytes(texts, self.path)
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if "<|" not in t and _BETWEEN not in t]
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self._tokenizer.encode_batch_fast([f" {_BETWEEN} ".join([texts[k] for k in some])], add_special_tokens=False)[0].ids, "<u4")
            cuts, data = [-1, *np.flatnonzero(ids == self._mark[0]).tolist(), len(ids)], ids.tobytes()
            for k, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                out[k] = data[4 * a + 4 : 4 * b]
        others = sorted(set(range(len(texts))).difference(plain))
        for k, data in zip(others, token_bytes([texts[k] for k in others], self.path), strict=True):
            out[k] = data
        return out

    def spell(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of words with A-Z lower-cased."""
        split = list(map(self._parts_of, words))
        if len(self._parts) > REMEMBERED:
            self._parts.clear()
        new = list({part for parts in split for part in parts if part not in self._parts})
        texts = [w.decode("utf-8", "replace") for w in new]
        for part, text, data in zip(new, texts, self._encoded(texts), strict=True):
            # Pieces spell printable ASCII exactly.
            if not (text.isascii() and text.isprintable()) and b"".join([self.bytes[k] for k in np.frombuffer(data, "<u4").tolist()]) != part:
                data = b""
            self._parts[part] = data
        out = []
        for word, parts in zip(words, split, strict=True):
            data = [self._parts[part] for part in parts]
            if all(data):
                whole = b"".join(data)
                last = whole[-4:]
                if last not in self._final:
                    self._final[last] = (int.from_bytes(last, "little") + self.pieces).to_bytes(4, "little")
                out.append(whole[:-4] + self._final[last])
            else:
                ids = np.frombuffer(word, np.uint8).astype("<u4") + np.uint32(2 * self.pieces)
                ids[-1] += 256
                out.append(ids.tobytes())
        return out

    def texts(self, column: pa.Array, tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The ids of every text of a column, whose word hashes are given; those of words are remembered by hash."""
        own = tokens.tolist()
        new = set(own).difference(self._ids)
        if len(self._ids) + len(new) > REMEMBERED:
            self._ids.clear()
            new = set(own)
        if new:
            fresh = np.fromiter(new, np.int64, len(new))
            uniques, at = np.unique(tokens, return_index=True)
            at = at[np.searchsorted(uniques, fresh)]
            raw, offsets = text_bytes(column)
            starts, ends, _ = word_spans(raw, offsets)
            data = raw.tobytes()
            words = [data[a:b].lower() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._ids.update(zip(fresh.tolist(), self.spell(words), strict=True))
        parts, end = list(map(self._ids.__getitem__, own)), np.uint32(self.end).tobytes()
        cuts = first.tolist()
        return [b"".join(parts[a:b]) + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_spellings: dict[str, Spelling] = {}


def spelling(path: str) -> Spelling:
    """The spelling of a tokenizer, made once in every worker."""
    if path not in _spellings:
        _spellings[path] = Spelling(path)
    return _spellings[path]


def streams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the index of each one's first id and the end."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int64)


def _id_counts(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(streams_of(batch.column("ids"))[0], minlength=size)
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])

    return count


def passes(n_windows: int) -> int:
    """How often every window is fitted."""
    return max(1, min(ROUNDS, -(-LEAST_WINDOWS // max(n_windows, 1))))


def _dealt(parts: int, number: int, times: int):
    """(part, key, skip, x): pieces of texts as 32-bit ids, those of round `number`; over all rounds each piece comes `times` times.

    A piece holds DEALT_TOGETHER windows, after the ids that these look back on (their windows are skipped).
    """
    step = 4 * SCORED * DEALT_TOGETHER

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("ids").to_pylist()
            count = np.array([-(-len(d) // step) for d in data], np.int64)
            text = np.repeat(np.arange(len(data)), count)
            k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            key = mix(mix(batch.column("row").to_numpy().view(np.uint64)[text] + np.uint64(1)) ^ k.astype(np.uint64))
            at = np.flatnonzero(((key % np.uint64(ROUNDS)).astype(np.int64) - number * times) % ROUNDS < times)
            x = [data[t][max(0, c * step - 4 * CONTEXT) : (c + 1) * step] for t, c in zip(text[at].tolist(), k[at].tolist(), strict=True)]
            part = (mix(key[at] + np.uint64(7)) % np.uint64(parts)).astype(np.int32)
            skip = np.where(k[at] > 0, CONTEXT // SCORED, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key[at].view(np.int64)), pa.array(skip), pa.array(x, pa.binary())], names=["part", "key", "skip", "x"])

    return deal


def _windows_of(pieces: pa.Array, skip: np.ndarray, rank: np.ndarray, start: int) -> np.ndarray:
    """Windows of pieces as ranks: CONTEXT inputs, then SCORED targets with start + 1 beyond the text."""
    ids, first = streams_of(pieces)
    padded, places = padded_texts(rank[ids], first, start)
    count = window_counts(first)
    k = np.arange(len(places)) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate(windows_at(padded, places[k >= np.repeat(skip, count)]), axis=1)


def _fit_parts(shared, rate: float):
    """Each part's windows as a stream of steps from the shared model; out come its changes: shared weights, and blocks of rows."""

    def changes(part: int, net: Attention, old: dict, n: int) -> pa.RecordBatch:
        dense = np.concatenate([(net.p[k] - old[k]).ravel() for k in old if k not in net.ROWS]).astype("<f4")
        block, rows, data = [-1], [b""], [dense.tobytes()]
        size = net.size
        moved = np.concatenate([net.p["emb"][:size] - old["emb"][:size], net.p["out"] - old["out"], (net.p["bias"] - old["bias"])[:, None]], axis=1)
        edge = np.concatenate([net.p["emb"][size:] - old["emb"][size:], np.zeros((2, moved.shape[1] - old["emb"].shape[1]), np.float32)], axis=1)
        moved = np.concatenate([moved, edge])
        touched = np.flatnonzero(moved.any(axis=1))
        for b in np.unique(touched // ROW_BLOCK):
            own = touched[touched // ROW_BLOCK == b]
            block.append(int(b))
            rows.append(own.astype("<u4").tobytes())
            data.append(moved[own].astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([part] * len(block), pa.int64()), pa.array(block, pa.int64()), pa.array([float(n)] * len(block)), pa.array(rows, pa.binary()), pa.array(data, pa.binary())], names=["part", "block", "n", "rows", "data"])

    def fit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        first, rank = shared.value
        part, held = None, []
        for batch in batches:
            parts, skip = batch.column("part").to_numpy(), batch.column("skip").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    if part is not None:
                        _steps(step, net, order, held, True)
                        yield changes(part, net, first.p, n)
                    part, n, held = int(parts[a]), 0, []
                    net, order = first.copy(), np.random.default_rng(part)
                    step = net.learner(rate)
                for c in range(a, b, 256):
                    held.append(_windows_of(batch.column("x").slice(c, min(256, b - c)), skip[c : min(b, c + 256)], rank, net.start))
                    n += len(held[-1])
                    if sum(map(len, held)) >= MIXED_TOGETHER:
                        held = _steps(step, net, order, held, False)
        if part is not None:
            _steps(step, net, order, held, True)
            yield changes(part, net, first.p, n)

    return fit_parts


def _steps(step, net: Attention, order: np.random.Generator, held: list[np.ndarray], last: bool) -> list[np.ndarray]:
    """Steps on all full batches of the windows held, in mixed order, at last on the rest too; what is left."""
    rows = np.concatenate(held) if held else np.zeros((0, CONTEXT + SCORED), np.int32)
    rows = rows[order.permutation(len(rows))]
    while len(rows) >= BATCH or (last and len(rows)):
        some, rows = rows[:BATCH], rows[BATCH:]
        target = some[:, CONTEXT:]
        step(some[:, :CONTEXT], np.minimum(target, net.size - 1), (target < net.size).astype(np.float32))
    return [rows]


def _mean(width: int):
    """The mean change of a block over all parts: of each row over those that changed it."""

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        block, n = int(group["block"].iloc[0]), group["n"].to_numpy()
        if block < 0:
            total = sum(w * np.frombuffer(d, "<f4").astype(float) for w, d in zip(n, group["data"], strict=True)) / n.sum()
            rows, out = b"", total
        else:
            at = np.frombuffer(b"".join(group["rows"]), "<u4")
            weight = np.repeat(n, [len(r) // 4 for r in group["rows"]])
            data = np.frombuffer(b"".join(group["data"]), "<f4").reshape(-1, width)
            seen, back = np.unique(at, return_inverse=True)
            total = np.stack([np.bincount(back, weights=weight * data[:, d], minlength=len(seen)) for d in range(width)], axis=1)
            rows, out = seen.astype("<u4").tobytes(), total / np.bincount(back, weights=weight)[:, None]
        return pd.DataFrame({"block": [block], "rows": [rows], "data": [out.astype("<f4").tobytes()]})

    return mean


def fit(texts: DataFrame, counts: np.ndarray, n_windows: int, seed: int = 0) -> tuple[Attention, np.ndarray]:
    """The model and the rank of every id, from the training texts (row, ids) and the counts of all their ids.

    Every window of every text is fitted. Each round deals its share of them to parts; every part goes on
    from the shared model in mini-batches of its own stream, and Spark forms the mean of what the parts
    changed; the driver gets one model a round, whatever the input. Copies of a text count as often as they occur.
    """
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts) + 2, np.int64)
    rank[order] = np.arange(len(counts))
    rank[len(counts) :] = len(counts), len(counts) + 1
    net = Attention(counts[order] + 0.5, seed)
    times = passes(n_windows)
    parts = min(MOST_PARTS, max(1, round(times * n_windows / PART_WINDOWS)))
    width = 2 * net.p["emb"].shape[1] + 1
    for k in range(ROUNDS):
        shared = texts.sparkSession.sparkContext.broadcast((net, rank))
        some = texts.select("row", "ids").mapInArrow(_dealt(parts, k, times), "part int, key long, skip int, x binary")
        some = some.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key")
        moved = some.mapInArrow(_fit_parts(shared, 1 - k / ROUNDS), "part long, block long, n double, rows binary, data binary")
        for r in moved.groupBy("block").applyInPandas(_mean(width), "block long, rows binary, data binary").toLocalIterator():
            net.change(np.frombuffer(r["rows"], "<u4"), np.frombuffer(r["data"], "<f4"))
        shared.unpersist()
    return net, rank


_DOC = "doc_id long, held_out boolean, h long, row long, n_tokens long, n_known long, base double, n_ids long, ids binary, slice long, data binary"
_ASKED = np.dtype([("token", "<i8"), ("row", "<i8")])


def score_texts(docs: DataFrame, tokenizer_path: str, seed: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    The model learns from rows that training() names. base_score is the unigram score of the words;
    score the attention model's log10 probability of the text, its end included. Null and empty texts
    are the end alone. Repeated rows are scored each. No training rows give the model of no counts.
    An empty table gives no rows. Other columns are ignored. Words are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", ~training(F.col("doc_id")))
    size = spelling(tokenizer_path).size
    counted = docs.select("text", "held_out").mapInArrow(_count, "token long, n long, seen long")
    table = materialize(counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "words")
    bins = table.groupBy(F.floor(F.log2("seen") * 8).alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.min("seen").alias("least")).collect()
    n_texts = docs.where(~F.col("held_out")).count()
    n, v = sum(b["n"] for b in bins) + n_texts, sum(b["v"] for b in bins) + (1 if n_texts else 0)
    # Words of the highest bins are held, as many bins as fit.
    bins = sorted(bins, key=lambda b: -b["bin"])
    fits = np.cumsum([b["words"] for b in bins]) <= HELD_WORDS
    least = min((b["least"] for b, f in zip(bins, fits, strict=True) if f), default=2**62)
    top = table.where(F.col("seen") >= least).select("token", "n").toArrow()
    order = np.argsort(top["token"].to_numpy(), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((top["token"].to_numpy()[order], top["n"].to_numpy()[order]))
    slices = max(16, -(-sum(b["words"] for b in bins) // SLICE_WORDS), n // SLICE_TOKENS)
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row's ids and what held words add to its base score; and the other words, packed by slice."""
        keep_memory()
        own, row, (held_tokens, held_n) = spelling(tokenizer_path), TaskContext.get().partitionId() << 40, shared.value
        held_base = base(held_n)
        names, types = ["doc_id", "held_out", "h", "row", "n_tokens", "n_known", "base", "n_ids", "ids", "slice", "data"], [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.binary()]
        asked, waiting = [], 0

        def out() -> pa.RecordBatch:
            data = np.concatenate(asked)
            where = np.mod(data["token"], slices)
            order = np.argsort(where, kind="stable")
            where, data = where[order], data[order]
            cut = np.flatnonzero(np.diff(where)) + 1
            of = where[np.concatenate([[0], cut])]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(of), t) for t in types], pa.array(of), pa.array([d.tobytes() for d in np.split(data, cut)], pa.binary())], names=names)

        for whole in batches:
            for batch in sub_batches(whole, "text", 1 << 20):
                hashes, first = word_hashes(batch.column("text"))
                tokens, k = hashes.view(np.int64), batch.num_rows
                rows = row + np.arange(k)
                row += k
                text = np.repeat(np.arange(k), np.diff(first))
                at = np.minimum(np.searchsorted(held_tokens, tokens), max(0, len(held_tokens) - 1))
                held = held_tokens[at] == tokens if len(held_tokens) else np.zeros(len(tokens), bool)
                known = np.bincount(text[held], weights=held_n[at[held]] > 0, minlength=k).astype(np.int64) + int(n_texts > 0)
                sums = np.bincount(text[held], weights=held_base[at[held]], minlength=k) + base(n_texts)
                ids = own.texts(batch.column("text"), tokens, first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("held_out"), batch.column("h"), pa.array(rows), pa.array(np.diff(first) + 1), pa.array(known),
                    pa.array(sums), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                ], names=names)
                other = np.flatnonzero(~held)
                if len(other):
                    some = np.empty(len(other), _ASKED)
                    some["token"], some["row"] = tokens[other], rows[text[other]]
                    asked.append(some)
                    waiting += len(some)
                if waiting >= 500_000:
                    yield out()
                    asked, waiting = [], 0
        if asked:
            yield out()

    def look_up(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        """What the words asked for in one slice add to each row."""
        data = np.frombuffer(b"".join(asked["data"]), _ASKED) if len(asked) else np.zeros(0, _ASKED)
        words = words.sort_values("token")
        c = words["n"].to_numpy(np.int64)[np.searchsorted(words["token"].to_numpy(np.int64), data["token"])]
        rows, back = np.unique(data["row"], return_inverse=True)
        add = lambda x: np.bincount(back, weights=x, minlength=len(rows))
        return pd.DataFrame({"row": rows, "more_base": add(base(c)), "more_known": add(c > 0).astype(np.int64)})

    got = materialize(docs.withColumn("h", F.xxhash64("text", F.lit(seed))).mapInArrow(ask, _DOC), "streams")
    rows, trains = got.where("row is not null"), got.where("row is not null and not held_out")
    n_windows = trains.agg(F.sum(F.ceil(F.col("n_ids") / SCORED))).first()[0] or 0
    found = trains.select("ids").mapInArrow(_id_counts(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    model = docs.sparkSession.sparkContext.broadcast(fit(trains, counts, n_windows, seed))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        net, rank = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, first = streams_of(batch.column("ids"))
                padded, places = padded_texts(rank[ids], first, net.start)
                text = np.repeat(np.arange(batch.num_rows), window_counts(first))
                out = np.zeros(batch.num_rows)
                for i in range(0, len(places), SCORED_TOGETHER):
                    x, target = windows_at(padded, places[i : i + SCORED_TOGETHER])
                    lp = net.target_log_probs(x, np.minimum(target, net.size - 1))
                    out += np.bincount(text[i : i + SCORED_TOGETHER], weights=np.where(target < net.size, lp, 0).sum(axis=1, dtype=float), minlength=len(out))
                kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out / math.log(10))], names=[*kept, "score"])

    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    asked = got.where("slice is not null").select("slice", "data")
    words = table.where(F.col("seen") < least).select("token", "n", F.pmod("token", F.lit(slices)).alias("of"))
    more = asked.groupBy("slice").cogroup(words.groupBy("of")).applyInPandas(look_up, "row long, more_base double, more_known long")
    more = more.groupBy("row").agg(F.sum("more_base").alias("more_base"), F.sum("more_known").alias("more_known"))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
