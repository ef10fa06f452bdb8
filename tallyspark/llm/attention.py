"""A causal self-attention model over subword ids, trained and applied in numpy.

Ids are numbered by rank, the most frequent first. The output layer is a softmax in levels, all
learned with the rest from the hidden state: the class of the next id, then the id among those of its
class. Frequent ids are classes of their own, rarer ones share classes that grow with the rank; the
classes from rank TAIL on stand behind one entry of the first softmax and have one of their own.
"""

from __future__ import annotations

import numpy as np

#: Model width, inputs that a window holds, and positions that it scores (its last ones).
WIDTH, CONTEXT, SCORED = 16, 32, 16
#: Ranks below the first number lie in classes of the second size; ranks from TAIL on in the tail.
BANDS, TAIL = ((32, 1), (512, 64), (4096, 256), (1 << 31, 1024)), 4096
#: Learning rates of shared weights (Adam) and of rows of single ids (Adagrad), and windows of a step.
RATE, ROW_RATE, BATCH = 0.015, 0.4, 256


def class_edges(size: int) -> np.ndarray:
    """First rank of every class, and the number of ranks."""
    edges = [0]
    for below, width in BANDS:
        while edges[-1] < min(below, size):
            edges.append(min(edges[-1] + width, below, size))
    return np.array(edges, np.int64)


class Attention:
    """One masked attention layer, a feed-forward layer and the output in levels.

    counts: how often each rank occurs; they are where the biases start. Input len(counts) is the start
    of a text and len(counts) + 1 is padding, which no position attends to. Windows overlap: their
    first CONTEXT - SCORED inputs are context only. With attend=False every position sees its own
    input alone, for comparisons.
    """

    ROWS = ("emb", "out", "bias")

    def __init__(self, counts: np.ndarray, seed: int = 0, attend: bool = True):
        rng = np.random.default_rng(seed)
        g = lambda *s, scale=0.15: (rng.standard_normal(s, np.float32) * np.float32(scale))
        self.size, self.attend = len(counts), attend
        self.start, self.pad = self.size, self.size + 1
        self.edges = class_edges(self.size)
        self.of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges)).astype(np.int64)
        # Classes from self.tail on stand behind entry self.tail of the head.
        self.tail = int(np.searchsorted(self.edges[:-1], TAIL))
        mass = np.add.reduceat(counts, self.edges[:-1])
        heads = np.append(mass[: self.tail], mass[self.tail :].sum()) if self.tail < len(mass) else mass
        self.p = {
            "emb": g(self.size + 2, WIDTH, scale=0.3), "pos": g(CONTEXT, WIDTH, scale=0.1),
            "q": g(WIDTH, WIDTH), "k": g(WIDTH, WIDTH), "v": g(WIDTH, WIDTH), "o": g(WIDTH, WIDTH),
            "w1": g(WIDTH, 2 * WIDTH), "b1": np.zeros(2 * WIDTH, np.float32), "w2": g(2 * WIDTH, WIDTH),
            "head": g(WIDTH, len(heads), scale=0.05), "head_bias": np.log(heads / heads.sum()).astype(np.float32),
            "out": np.zeros((self.size, WIDTH), np.float32), "bias": np.log(counts / mass[self.of]).astype(np.float32),
        }
        if self.tail < len(mass):
            self.p |= {"tail": g(WIDTH, len(mass) - self.tail, scale=0.05), "tail_bias": np.log(mass[self.tail :] / heads[-1]).astype(np.float32)}

    def _hidden(self, x: np.ndarray) -> dict:
        """x: (n, CONTEXT) inputs. Values of the SCORED last positions of every window; z is the hidden state and a column of ones.

        q and k, and v and o, act through their products alone. s are weights before division by their sum.
        """
        p, n = self.p, len(x)
        e = p["emb"].take(x, axis=0)
        e += p["pos"]
        last = np.ascontiguousarray(e[:, CONTEXT - SCORED :]).reshape(-1, WIDTH)
        h = np.ones((len(last), WIDTH + 1), e.dtype)
        h[:, :WIDTH] = last
        f = {"e": e, "last": last, "h": h}
        if self.attend:
            f["qk"], f["vo"] = (p["q"] * np.float32(WIDTH**-0.5)) @ p["k"].T, p["v"] @ p["o"]
            q = (last @ f["qk"]).reshape(n, SCORED, WIDTH)
            s = np.matmul(q, e.transpose(0, 2, 1))
            _exp(s)
            s *= _SEEN
            padded = np.flatnonzero(x[:, 0] == self.pad)
            s[padded] *= (x[padded] != self.pad)[:, None, :]
            part = 1 / np.maximum(s.reshape(-1, CONTEXT) @ np.ones(CONTEXT, s.dtype), np.float32(1e-30))[:, None]
            a = np.matmul(s, e).reshape(-1, WIDTH)
            a *= part
            h[:, :WIDTH] += a @ f["vo"]
            f |= {"q": q, "s": s, "a": a, "part": part}
        r = h @ np.concatenate([p["w1"], p["b1"][None]])
        np.maximum(r, 0, out=r)
        z = h.copy()
        z[:, :WIDTH] += r @ p["w2"]
        return f | {"r": r, "z": z}

    def _classes(self, target: np.ndarray):
        """Places of the targets by class, and (classes, bounds, places) of every run of classes of one size above 1.

        Classes are those of the run that the targets need; bounds[i] to bounds[i + 1] of the places are those of classes[i].
        """
        of = self.of[target]
        order = np.argsort(of.astype(np.int16), kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(self.edges)))
        need, widths, runs = np.flatnonzero(np.diff(cuts)), np.diff(self.edges), []
        for own in np.split(need, np.flatnonzero((np.diff(widths[need]) != 0) | (np.diff(need) != 1)) + 1):
            if len(own) and widths[own[0]] > 1:
                runs.append((own, np.append(cuts[own], cuts[own[-1] + 1])))
        return of, order, runs

    def _levels(self, z: np.ndarray, target: np.ndarray):
        """(rows of z, place of their target, weights (WIDTH + 1, entries), or a run's weights and bounds, its name) of every softmax."""
        p = self.p
        of, order, runs = self._classes(target)
        yield "head", None, np.minimum(of, p["head"].shape[1] - 1), np.concatenate([p["head"], p["head_bias"][None]]), None
        rows = np.flatnonzero(of >= self.tail)
        if len(rows):
            yield "tail", rows, of[rows] - self.tail, np.concatenate([p["tail"], p["tail_bias"][None]]), None
        for own, cuts in runs:
            lo, hi = self.edges[own[0]], self.edges[own[-1] + 1]
            rows = order[cuts[0] : cuts[-1]]
            width = (hi - lo) // len(own)
            yield lo, rows, (target[rows] - lo) % width, np.concatenate([p["out"][lo:hi], p["bias"][lo:hi, None]], axis=1).reshape(len(own), width, -1), cuts - cuts[0]

    def target_log_probs(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities (n, SCORED) of the target ids that follow each scored position."""
        z, t = self._hidden(x)["z"], target.ravel()
        got = np.zeros(len(t), z.dtype)
        for _, rows, at, w, cuts in self._levels(z, t):
            own = z if rows is None else z[rows]
            y = own @ w if cuts is None else _by_class(own, w.transpose(0, 2, 1), cuts)
            lp = _log_softmax(y, at)
            if rows is None:
                got += lp
            else:
                got[rows] += lp
        return got.reshape(target.shape)

    def _grads(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, dict]:
        """Gradients of the mean loss: of the shared weights, and {name: [(rows, gradient)]} of rows of single ids."""
        p, f, n, t = self.p, self._hidden(x), len(x), target.ravel()
        z = f["z"]
        weight = (weight.ravel() / max(1.0, float(weight.sum()))).astype(z.dtype)
        g, rows_of = {k: np.zeros_like(p[k]) for k in ("tail", "tail_bias") if k in p}, {"out": [], "bias": []}
        for name, rows, at, w, cuts in self._levels(z, t):
            own = z if rows is None else z[rows]
            y = own @ w if cuts is None else _by_class(own, w.transpose(0, 2, 1), cuts)
            # The gradient by the scores is y, after this, times part.
            part = _softmax_error(y, at, weight if rows is None else weight[rows])[:, None]
            if cuts is None:
                change = (own * part).T @ y
                g[name], g[f"{name}_bias"] = change[:WIDTH], change[WIDTH]
                back = y @ w[:WIDTH].T
            else:
                change, own = np.empty_like(w), own * part
                for c in range(len(w)):
                    np.matmul(y[cuts[c] : cuts[c + 1]].T, own[cuts[c] : cuts[c + 1]], out=change[c])
                change = change.reshape(-1, WIDTH + 1)
                rows_of["out"].append((slice(name, name + len(change)), change[:, :WIDTH]))
                rows_of["bias"].append((slice(name, name + len(change)), change[:, WIDTH]))
                back = _by_class(y, w, cuts)[:, :WIDTH]
            if rows is None:
                dz = back * part
            else:
                dz[rows] += back * part
        r = f["r"]
        du = dz @ p["w2"].T
        du *= r > 0
        change = f["h"].T @ du
        g["w2"], g["w1"], g["b1"] = r.T @ dz, change[:WIDTH], change[WIDTH]
        dh = dz
        dh += du @ p["w1"].T
        if self.attend:
            e, a, s = f["e"], f["a"], f["s"]
            change = a.T @ dh
            g["v"], g["o"] = change @ p["o"].T, p["v"].T @ change
            da = dh @ f["vo"].T
            da *= f["part"]
            inner = np.einsum("ij,ij->i", da, a).reshape(n, SCORED, 1)
            da = da.reshape(n, SCORED, WIDTH)
            ds = np.matmul(da, e.transpose(0, 2, 1))
            ds -= inner
            ds *= s
            dq = np.matmul(ds, e).reshape(-1, WIDTH)
            change = (f["last"].T @ dq) * np.float32(WIDTH**-0.5)
            g["q"], g["k"] = change @ p["k"], change.T @ p["q"]
            de = np.matmul(s.transpose(0, 2, 1), da)
            de += np.matmul(ds.transpose(0, 2, 1), f["q"])
            dh += dq @ f["qk"].T
        else:
            de = np.zeros((n, CONTEXT, WIDTH), z.dtype)
        de[:, CONTEXT - SCORED :] += dh.reshape(n, SCORED, WIDTH)
        g["pos"] = (np.ones(n, z.dtype) @ de.reshape(n, -1)).reshape(CONTEXT, WIDTH)
        found = np.zeros(self.size + 2, bool)
        found[x] = True
        seen = np.flatnonzero(found)
        number = np.empty(self.size + 2, np.int64)
        number[seen] = np.arange(0, len(seen) * WIDTH, WIDTH)
        place = (number[x][:, :, None] + np.arange(WIDTH)).ravel()
        rows_of["emb"] = [(seen, np.bincount(place, weights=de.ravel(), minlength=len(seen) * WIDTH).reshape(-1, WIDTH).astype(z.dtype))]
        return g, rows_of

    def copy(self) -> Attention:
        """The same model with weights of its own."""
        other = object.__new__(Attention)
        other.__dict__ = self.__dict__ | {"p": {k: a.copy() for k, a in self.p.items()}}
        return other

    def change(self, rows: np.ndarray, data: np.ndarray) -> None:
        """Add changes: to the shared weights laid end to end (no rows), or to rows of emb, out and bias side by side."""
        if not len(rows):
            for k, a in self.p.items():
                if k not in self.ROWS:
                    a += data[: a.size].reshape(a.shape)
                    data = data[a.size :]
            return
        data = data.reshape(len(rows), -1)
        self.p["emb"][rows] += data[:, :WIDTH]
        own = rows < self.size
        self.p["out"][rows[own]] += data[own, WIDTH : 2 * WIDTH]
        self.p["bias"][rows[own]] += data[own, 2 * WIDTH]

    def learner(self, rate: float = 1.0):
        """A function that takes one step on (x, target, weight), with its own running means."""
        shared = [k for k in self.p if k not in self.ROWS and (self.attend or k not in "qkvo")]
        ends = np.cumsum([self.p[k].size for k in shared])
        m, v = (np.zeros(ends[-1], self.p["pos"].dtype) for _ in range(2))
        sums = {k: np.zeros_like(self.p[k]) for k in self.ROWS}
        t = 0

        def step(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
            nonlocal t, m, v
            t += 1
            g, rows_of = self._grads(x, target, weight)
            a = np.concatenate([g[k].ravel() for k in shared])
            m += 0.1 * (a - m)
            v += 0.01 * (a * a - v)
            a = (rate * RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            for k, part in zip(shared, np.split(a, ends[:-1]), strict=True):
                self.p[k] -= part.reshape(self.p[k].shape)
            for k, parts in rows_of.items():
                for at, a in parts:
                    sums[k][at] += a * a
                    self.p[k][at] -= np.float32(rate * ROW_RATE) * a / (np.sqrt(sums[k][at]) + np.float32(1e-7))

        return step


#: Inputs that a scored position may see: itself and what came before.
_SEEN = (np.arange(CONTEXT)[None, :] <= (np.arange(SCORED) + CONTEXT - SCORED)[:, None]).astype(np.float32)


def _exp(y: np.ndarray) -> np.ndarray:
    """Exponentials in place; values above 60 count as 60."""
    if y.size and y.max() > 60:
        np.minimum(y, 60, out=y)
    return np.exp(y, out=y)


def _by_class(z: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows cuts[c] to cuts[c + 1] of z times w[c], for every c."""
    out = np.empty((len(z), w.shape[2]), z.dtype)
    for c in range(len(w)):
        np.matmul(z[cuts[c] : cuts[c + 1]], w[c], out=out[cuts[c] : cuts[c + 1]])
    return out


def _log_softmax(y: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the target of each row; y is overwritten."""
    got = np.minimum(y[np.arange(len(y)), target], 60)
    return got - np.log(_exp(y) @ np.ones(y.shape[1], y.dtype))


def _softmax_error(y: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The factor of each row that makes y, which is overwritten, the gradient of the weighted cross entropy by y."""
    total = _exp(y) @ np.ones(y.shape[1], y.dtype)
    y[np.arange(len(y)), target] -= total
    return weight / total


def window_counts(first: np.ndarray) -> np.ndarray:
    """Number of windows of each text; first: index of each text's first id, and the end."""
    return -(-np.diff(first) // SCORED)


def windows(ids: np.ndarray, first: np.ndarray, text: np.ndarray, k: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Window k of each text: x (n, CONTEXT) inputs, and target places (n, SCORED) in ids with -1 beyond the text.

    Texts lie end to end. Every place is the target of exactly one of its text's windows; the inputs are what
    came before, `start` before the first id and start + 1 before that.
    """
    length, begin = np.diff(first)[text][:, None], first[:-1][text][:, None]
    place = (k * SCORED)[:, None] + np.arange(SCORED)
    target = np.where(place < length, begin + place, -1)
    before = (k * SCORED)[:, None] + np.arange(CONTEXT) - (CONTEXT - SCORED) - 1
    inside = (before >= 0) & (before < length)
    x = np.where(inside, ids[np.where(inside, begin + before, 0)] if len(ids) else 0, start + 1)
    x[before == -1] = start
    return x, target


def padded_texts(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with all that their windows see before and behind them, end to end, and the place of every window.

    CONTEXT + 1 values from a window's place are its inputs and, the last SCORED of them, its targets: start + 1 beyond the text.
    """
    count, front = window_counts(first), CONTEXT - SCORED + 1
    begin = np.concatenate([[0], np.cumsum(front + count * SCORED)])
    out = np.full(begin[-1], start + 1, np.int32)
    out[begin[:-1] + front - 1] = start
    out[np.arange(len(ids)) + np.repeat(begin[:-1] + front - first[:-1], np.diff(first))] = ids
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return out, np.repeat(begin[:-1], count) + k * SCORED


def windows_at(padded: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (n, CONTEXT) inputs and (n, SCORED) targets of the windows at some places of padded_texts."""
    rows = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + 1)[places] if len(places) else np.zeros((0, CONTEXT + 1), np.int32)
    return rows[:, :CONTEXT], rows[:, CONTEXT + 1 - SCORED :]


def keep_memory() -> None:
    """The C library keeps as much freed memory as the largest block it gave back; without this, each step's arrays are mapped anew."""
    np.empty(24 << 20, np.uint8)
