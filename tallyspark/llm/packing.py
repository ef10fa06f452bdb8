"""Vector bin packing of tokenised examples into fixed-length training sequences.

Bin-centric dot-product heuristic: the open sequence has a vector of what is left of three limits
(tokens, segments, loss-bearing tokens); of the waiting examples that fit, the one whose demand has
the largest dot product with it comes next. When none fits, the best one is cut to fill the rest.
Each task packs its own rows as a stream with a bounded number of waiting examples: no shuffle, and
a task that is run again on its split gives the same sequences.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Waiting examples of a task, and words whose ids a worker remembers.
WAITING = 128
REMEMBERED_WORDS = 800_000

#: Stands between words that are encoded together.
_MARK = "\x01"
_CLOSERS = frozenset([b".", b",", b";", b":", b"!", b"?"])
_ids: dict[bytes, bytes] = {}
_tokenizers: dict[str, object] = {}

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, segment int, offset long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("segment", pa.int32()), ("offset", pa.int64())])


def token_bytes(texts: list[str | None], tokenizer_path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text; null is empty.

    The tokenizer drops ASCII white space and never joins across it, so ids of words are remembered.
    """
    tokenizer = _tokenizers.get(tokenizer_path)
    if tokenizer is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = _tokenizers[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
        _ids.clear()
    if len(_ids) > REMEMBERED_WORDS:
        _ids.clear()
    # The tokenizer lower-cases; only its special tokens tell capitals apart.
    words = [(b if b"<|" in b else b.lower()).split() for b in (t.encode("utf-8") if t else b"" for t in texts)]
    new = {w for w in set(chain.from_iterable(words)) if w not in _ids}
    # A mark of punctuation after a letter or digit is a token of its own: such words share their stems' ids.
    closed = [w for w in new if w[-1:] in _CLOSERS and w[-2:-1].isalnum() and b"<|" not in w]
    new = list(new.difference(closed).union(x for w in closed for x in (w[:-1], w[-1:]) if x not in _ids))
    mark = tokenizer.encode(_MARK, add_special_tokens=False).ids
    plain = [w for w in new if b"<|" not in w and _MARK.encode() not in w] if len(mark) == 1 else []
    for i in range(0, len(plain), 4096):  # many words in one call, told apart by a mark that is one id
        some = plain[i : i + 4096]
        ids = np.array(tokenizer.encode(f" {_MARK} ".join(w.decode("utf-8") for w in some), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == mark[0]).tolist()
        data = ids.tobytes()
        for w, a, b in zip(some, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
            _ids[w] = data[4 * a : 4 * b]
    for w in new:
        if w not in _ids:
            _ids[w] = np.array(tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
    for w in closed:
        _ids[w] = _ids[w[:-1]] + _ids[w[-1:]]
    return [b"".join(map(_ids.__getitem__, ws)) for ws in words]


class Packer:
    """Packs examples (doc_id, ids, loss_from) of one task; tokens from index loss_from on bear loss."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_id: int, cut: bool = True):
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_segments, self.max_loss, self.cut = capacity, max_segments, max_loss, cut
        self.next_id = first_id
        self.items: list[list] = []  # [doc_id, ids, at, loss_from]
        self.need = np.zeros((WAITING + 1, 3))
        self.bin: list[tuple] = []
        self.left = np.array([capacity, max_segments, max_loss])
        self.out: list[tuple] = []

    def _loss(self, item: list, a: int, b: int) -> int:
        return max(0, b - max(a, item[3]))

    def _longest(self, item: list, left) -> int:
        """The longest head of the item that keeps to what is left."""
        _, _, at, loss_from = item
        n = min(len(item[1]) // 4 - at, int(left[0]))
        return min(n, max(0, loss_from - at) + int(left[2])) if left[1] > 0 else 0

    def _measure(self, i: int) -> None:
        item = self.items[i]
        n = len(item[1]) // 4
        self.need[i] = n - item[2], 1, self._loss(item, item[2], n)

    def _put(self, i: int, n: int) -> None:
        """Put the next n tokens of waiting item i into the open sequence."""
        item = self.items[i]
        a = item[2]
        loss = self._loss(item, a, a + n)
        self.bin.append((item[0], a, n, item[1][4 * a : 4 * (a + n)], len(item[1]) // 4, loss))
        self.left -= (n, 1, loss)
        item[2] = a + n
        if item[2] * 4 == len(item[1]):
            last = len(self.items) - 1
            self.items[i], self.need[i] = self.items[last], self.need[last]
            self.items.pop()
        else:
            self._measure(i)

    def _close(self) -> None:
        at = 0
        for k, (doc_id, start, n, ids, total, loss) in enumerate(self.bin):
            self.out.append((doc_id, start, n, ids, total, loss, self.next_id, k, at))
            at += n
        self.next_id += 1
        self.bin, self.left = [], np.array([self.capacity, self.max_segments, self.max_loss])

    def add(self, doc_id, ids: bytes, loss_from: int) -> None:
        self.items.append([doc_id, ids, 0, loss_from])
        self._measure(len(self.items) - 1)
        while len(self.items) > WAITING:
            self._step()

    def _step(self) -> None:
        """Place one example, whole or cut, or close the open sequence."""
        need = self.need[: len(self.items)]
        score = (need / self.limits) @ (self.left / self.limits)
        fits = (need <= self.left).all(axis=1)
        if fits.any():
            i = int(np.where(fits, score, -1).argmax())
            self._put(i, int(need[i, 0]))
        else:
            i = int(score.argmax())
            n = self._longest(self.items[i], self.left) if self.cut or not self.bin else 0
            if n:
                self._put(i, n)
            else:
                self._close()
                return
        if self.left.min() <= 0:
            self._close()

    def finish(self) -> None:
        """Place the rest; what cannot fill a sequence goes into sequences of powers of two, where cuts are allowed."""
        while self.items and (not self.cut or self.need[: len(self.items), 0].sum() >= self.left[0]):
            self._step()
        if self.cut and (self.bin or self.items):
            rest = [(p[0], p[1], p[3], p[4], p[5], p[2]) for p in self.bin]
            for item in self.items:
                n = len(item[1]) // 4
                while item[2] < n:
                    m = n - item[2]
                    rest.append((item[0], item[2], item[1][4 * item[2] :], n, self._loss(item, item[2], n), m))
                    item[2] = n
            self.items, self.bin = [], []
            self.left = np.array([self.capacity, self.max_segments, self.max_loss])
            total = sum(p[5] for p in rest)
            queue = [[d, s, ids, t, loss] for d, s, ids, t, loss, _ in rest]
            while total:
                room = min(self.capacity, 1 << (total.bit_length() - 1))
                total -= room
                while room and self.left[1] > 0:
                    d, s, ids, t, loss = queue[0]
                    n = min(room, len(ids) // 4)
                    tail = min(loss, len(ids) // 4)
                    borne = max(0, n - (len(ids) // 4 - tail))
                    while borne > self.left[2]:
                        n -= borne - int(self.left[2])
                        borne = int(self.left[2])
                    if n <= 0:
                        break
                    self.bin.append((d, s, n, ids[: 4 * n], t, borne))
                    self.left -= (n, 1, borne)
                    room -= n
                    if 4 * n == len(ids):
                        queue.pop(0)
                    else:
                        queue[0] = [d, s + n, ids[4 * n :], t, loss - borne]
                total += room
                self._close()
        elif self.bin:
            self._close()

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, max_segments: int = 512, max_loss: int | None = None, prompt: str | None = None, cut: bool = True) -> DataFrame:
    """Sequences of at most capacity tokens, max_segments pieces and max_loss loss-bearing tokens.

    docs: doc_id long, text string, and the column named by prompt, if one is named: its tokens come
    before the text's and bear no loss. Each row's ids end with end_id. Returns PIECE_SCHEMA: a row
    per piece with its ids (little-endian unsigned 32-bit), the row's ids before it (start) and the
    place in its sequence (offset). With cut=False rows are cut only if longer than a sequence.

    Null and empty texts give the end id alone. Repeated rows are packed each. Very long texts are
    cut over sequences. An empty table gives no pieces. Other columns are ignored. Limits below 1 are refused.
    """
    most_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, most_loss) < 1:
        raise ValueError("capacity, max_segments and max_loss must be 1 at least")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")).alias("prompt"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, max_segments, most_loss, TaskContext.get().partitionId() << 40, cut)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                before = token_bytes(some.column("prompt").to_pylist(), tokenizer_path) if prompt else [b""] * some.num_rows
                for doc_id, head, ids in zip(some.column("doc_id").to_pylist(), before, token_bytes(some.column("text").to_pylist(), tokenizer_path), strict=True):
                    packer.add(doc_id, head + ids + end, len(head) // 4)
                if sum(len(r[3]) for r in packer.out) > 1 << 22:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return source.mapInArrow(run, PIECE_SCHEMA)
