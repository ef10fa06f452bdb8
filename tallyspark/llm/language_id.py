"""Language identification with a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response
in a window feeds a softmax over the languages. A text's probabilities are the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.hashing import sub_batches, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Training windows of one language at most, and windows taken from one text at most.
WINDOWS_PER_LANGUAGE = 2000
WINDOWS_PER_TEXT = 2
EPOCHS, BATCH, RATE = 5, 64, 0.01
_PAD = max(WIDTHS) - 1


class ByteCNN:
    """weights[w]: (width, 256, FILTERS) responses to bytes; then a linear layer to the languages."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0] = 0  # byte 0 stands for what lies beyond the text
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self._tables = None

    def _responses(self, b: np.ndarray) -> list[np.ndarray]:
        n = b.shape[1] - _PAD
        return [sum(c[j][b[:, j : j + n]] for j in range(w)) for w, c in zip(WIDTHS, self.conv, strict=True)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross entropy; a filter's gradient flows to the bytes under its largest response."""
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.out, self.bias]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                b, y = windows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
                responses = self._responses(b)
                at = [r.argmax(axis=1) for r in responses]
                pooled = np.concatenate([r.max(axis=1) for r in responses], axis=1)
                x = np.maximum(pooled, 0)
                p = _softmax(x @ self.out + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                dx = (p @ self.out.T) * (pooled > 0)
                grads = [np.zeros_like(c) for c in self.conv]
                f = np.arange(FILTERS)
                for k, (w, g) in enumerate(zip(WIDTHS, grads, strict=True)):
                    for j in range(w):
                        bytes_ = np.take_along_axis(b, at[k] + j, axis=1)
                        np.add.at(g[j], (bytes_, np.broadcast_to(f, bytes_.shape)), dx[:, k * FILTERS : (k + 1) * FILTERS])
                    g[:, 0] = 0
                grads += [x.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, a, c in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    c += 0.01 * (g * g - c)
                    q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to byte pairs: all widths' first two bytes side by side; the third of three; the last two of four."""
        if self._tables is None:
            pair = lambda c, j: (c[j][:, None, :] + c[j + 1][None, :, :]).reshape(65536, FILTERS)
            two, three, four = self.conv
            self._tables = np.concatenate([pair(two, 0), pair(three, 0), pair(four, 0)], axis=1), three[2].copy(), pair(four, 2)
        return self._tables

    def probabilities(self, b: np.ndarray) -> np.ndarray:
        """Softmax of windows (n, WINDOW + _PAD) of bytes."""
        first, third, last = self.tables()
        out = np.empty((len(b), len(self.languages)), np.float32)
        for i in range(0, len(b), 64):
            c = b[i : i + 64].astype(np.int64)
            pairs = c[:, :-1] * 256 + c[:, 1:]
            r = first[pairs[:, :WINDOW]]
            r[..., FILTERS : 2 * FILTERS] += third[c[:, 2 : 2 + WINDOW]]
            r[..., 2 * FILTERS :] += last[pairs[:, 2 : 2 + WINDOW]]
            out[i : i + 64] = _softmax(np.maximum(r.max(axis=1), 0) @ self.out + self.bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of the windows that begin at starts, zero beyond the end of their text."""
    at = starts[:, None] + np.arange(WINDOW + _PAD)
    held = at < ends[:, None]
    return np.where(held, raw[np.where(held, at, 0)] if len(raw) else 0, 0).astype(np.uint8)


def _text_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows that cover each text without overlap."""
    n = -(-np.diff(offsets) // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, offsets[:-1][text] + k * WINDOW, offsets[1:][text]


def train(labelled: DataFrame, seed: int = 0) -> ByteCNN:
    """A network from labelled rows (text, lang) without nulls.

    It is fitted on a bounded sample: per language the WINDOWS_PER_LANGUAGE different windows, at most
    WINDOWS_PER_TEXT of a text, whose hashes are smallest. Tasks drop windows far above that hash, which the
    number of windows gives, before the shuffle. No rows give a network without languages. Repeated
    rows count once. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text", 1 << 20):
                raw, offsets = text_bytes(batch.column("text"))
                text, start, end = _text_windows(offsets)
                rank = ((start - offsets[:-1][text]) // WINDOW * 2654435761 + batch.column("h").to_numpy()[text]) & 0xFFFFFFFF
                order = np.lexsort((rank, text))
                place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
                keep = np.sort(order[place < WINDOWS_PER_TEXT])
                data = _windows(raw, start[keep], end[keep])
                langs = batch.column("lang").take(pa.array(text[keep]))
                yield pa.RecordBatch.from_arrays([langs, pa.array(rank[keep] ^ (batch.column("h").to_numpy()[text[keep]] >> 7)), pa.array([d.tobytes() for d in data], pa.binary())], names=["lang", "rank", "bytes"])

    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text", F.lit(seed)).alias("h"))
    n = rows.groupBy("lang").agg(F.sum(F.least(F.ceil(F.octet_length("text") / WINDOW), F.lit(WINDOWS_PER_TEXT))).alias("n"))
    share = F.least(F.lit(1.0), 1.5 * WINDOWS_PER_LANGUAGE / F.greatest("n", F.lit(1)))
    cuts = rows.mapInArrow(cut, "lang string, rank long, bytes binary").withColumn("key", F.xxhash64("rank", "bytes"))
    cuts = cuts.join(F.broadcast(n.select("lang", (share * 2.0**64 - 2.0**63).alias("most"))), "lang").where(F.col("key").cast("double") <= F.col("most"))
    over = Window.partitionBy("lang").orderBy("key", "bytes")
    sample = cuts.select("lang", "key", "bytes").dropDuplicates().withColumn("r", F.row_number().over(over)).where(F.col("r") <= WINDOWS_PER_LANGUAGE).select("lang", "key", "bytes").toPandas()
    sample = sample.sort_values(["lang", "key", "bytes"], kind="stable")
    languages = sorted(sample["lang"].unique())
    model = ByteCNN(languages, seed)
    if len(languages) > 1:
        data = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW + _PAD)
        model.fit(data, sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), seed)
    return model


def predict(docs: DataFrame, model: ByteCNN, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (the mean probability of that language, 0 to 1).

    Only the text decides. Null texts, and texts without a letter, are `und` with score 0, as is every
    text if the model has no language. Texts of any length are read whole. Repeated rows are judged each,
    an empty table gives no rows, and columns of docs named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    flag = "_" * (1 + max(map(len, names))) + "letters"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in sub_batches(whole, text, 1 << 20):
                raw, offsets = text_bytes(batch.column(text))
                best, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                letters = batch.column(flag).to_pylist()
                if model.languages:
                    at, start, end = _text_windows(offsets)
                    total = np.zeros((batch.num_rows, len(model.languages)))
                    for i in range(0, len(at), 1024):
                        np.add.at(total, at[i : i + 1024], model.probabilities(_windows(raw, start[i : i + 1024], end[i : i + 1024])))
                    total /= np.maximum(1, np.bincount(at, minlength=batch.num_rows))[:, None]
                    for i, has in enumerate(letters):
                        if has:
                            k = int(total[i].argmax())
                            best[i], score[i] = model.languages[k], min(1.0, float(total[i, k]))
                columns = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str], seed: int = 0) -> DataFrame:
    """keep + text of every row of docs (doc_id, text, lang) with held_out, lang_pred and score.

    The network learns from rows that are not held out and have a text and a lang.
    """
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where(~F.col("held_out")).select("text", "lang"), seed)
    return predict(rows.select(*keep, "held_out", "text"), model)
