"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word itself (words seen often enough in
training) plus the sum of embeddings of its hashed character n-grams, divided by the
root of their number. Both are turned into gate inputs once per distinct word, so a
step of the recurrence is a table look-up, one small product and a few elementwise
operations. Arrays are laid out feature by window (features first), so that every
operation runs over contiguous windows.
"""

from __future__ import annotations

import io

import numpy as np

from .chunks import take_ragged
from .words import Words

DIM, HIDDEN, ATTENTION = 16, 8, 8
NGRAMS = (2, 3, 4)
NGRAM_SLOTS = 1 << 13
WINDOW, STRIDE = 32, 16      # words
LANES = 1024                 # windows run side by side
_START, _END = 1, 2          # bytes that no word holds


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, hash of each distinct word, its n-gram slots, flat, and their counts)."""
    import pandas as pd
    codes, uniques = pd.factorize(words.hashes)
    first = np.zeros(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lens = words.ends[first] - words.starts[first]
    padded = np.zeros(int((lens + 2).sum()), np.uint8)
    ends = np.cumsum(lens + 2)
    begins = ends - lens - 2
    padded[begins], padded[ends - 1] = _START, _END
    at = np.arange(int(lens.sum())) + np.repeat(begins + 1 - (np.cumsum(lens) - lens), lens)
    padded[at] = take_ragged(words.bytes, words.starts[first], lens)
    slots, owner = [], []
    word = np.repeat(np.arange(len(uniques)), lens + 2)
    wide = padded.astype(np.uint64)
    for n in NGRAMS:
        if len(padded) < n:
            continue
        h = np.full(len(padded) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ wide[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        inside = word[:len(h)] == word[n - 1:]
        slots.append((h[inside] >> np.uint64(40)).astype(np.int64) % NGRAM_SLOTS)
        owner.append(word[:len(h)][inside])
    if not slots:
        return codes, uniques, np.zeros(0, np.int64), np.zeros(len(uniques), np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return codes, uniques, np.concatenate(slots)[order], np.bincount(owner, minlength=len(uniques))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all overlapping windows: one every STRIDE words, the last
    reaching the end; a text without words has one empty window."""
    per_text = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), per_text)
    ends = np.cumsum(per_text)
    return text, (np.arange(len(text)) - np.repeat(ends - per_text, per_text)) * STRIDE


def window_codes(codes: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray, pad: int) -> np.ndarray:
    """(WINDOW, windows) word codes; ``pad`` past a text's end."""
    at = offsets[text] + first + np.arange(WINDOW)[:, None]
    there = at < offsets[text + 1]
    return np.where(there, np.append(codes, pad)[np.where(there, at, len(codes))], pad)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """``vocabulary``: sorted hashes of the words with an embedding of their own."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": f(len(vocabulary) + 1, DIM, scale=0.1), "gram": f(NGRAM_SLOTS, DIM, scale=0.1),
            "wx": f(2, DIM, 3 * HIDDEN, scale=DIM ** -0.5), "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": f(2, 3 * HIDDEN, HIDDEN, scale=HIDDEN ** -0.5), "wa": f(ATTENTION, 2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
            "ba": np.zeros((ATTENTION, 1), np.float32), "va": f(ATTENTION, scale=0.5),
            "wo": f(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32)}
        self.slope, self.bias = 1.0, 0.0

    # ------------------------------------------------------------- inputs

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding row of each word; the last row is that of all unknown words."""
        at = np.searchsorted(self.vocabulary, hashes)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == hashes[known]
        return np.where(known, at, len(self.vocabulary))

    def inputs(self, rows: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(words + 1, DIM): the inputs of distinct words; zeros last, for padding."""
        out = np.zeros((len(rows) + 1, DIM), np.float32)
        out[:-1] = self.p["word"][rows]
        ends = np.cumsum(sizes)
        for a in range(0, len(rows), LANES):
            n = sizes[a:a + LANES]
            begin = int(ends[a] - sizes[a])
            some = np.flatnonzero(n)
            if len(some):
                sums = np.add.reduceat(self.p["gram"][slots[begin:int(ends[min(a + LANES, len(rows)) - 1])]],
                                       (ends[a:a + LANES] - n - begin)[some], axis=0)
                out[a + some] += sums / np.sqrt(n[some])[:, None].astype(np.float32)
        return out

    # ------------------------------------------------------------ forward

    def forward(self, x: np.ndarray, codes: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep``, also what backward() needs."""
        steps, lanes = codes.shape
        states = np.empty((steps, 2 * HIDDEN, lanes), np.float32)
        kept: list = [[None] * steps, [None] * steps]
        for d in (0, 1):
            gates = np.ascontiguousarray((x @ self.p["wx"][d] + self.p["b"][d]).T)
            u, h = self.p["u"][d], np.zeros((HIDDEN, lanes), np.float32)
            own = states[:, d * HIDDEN:(d + 1) * HIDDEN]
            for t in (range(steps) if d == 0 else range(steps - 1, -1, -1)):
                a = gates.take(codes[t], axis=1)
                g = u @ h
                rz = a[:2 * HIDDEN]
                rz += g[:2 * HIDDEN]
                rz *= 0.5
                np.tanh(rz, out=rz)
                rz += 1
                rz *= 0.5
                n = a[2 * HIDDEN:]
                n += rz[:HIDDEN] * g[2 * HIDDEN:]
                np.tanh(n, out=n)
                if keep:
                    kept[d][t] = (h, rz, n, g[2 * HIDDEN:])
                h = h - n
                h *= rz[HIDDEN:]
                h += n
                own[t] = h
        mid = np.tanh(np.einsum("ah,thn->tan", self.p["wa"], states, optimize=True) + self.p["ba"])
        e = np.einsum("a,tan->tn", self.p["va"], mid, optimize=True)
        e = np.where(codes == len(x) - 1, np.float32(-30), e)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,thn->hn", alpha, states, optimize=True)
        logit = self.p["wo"] @ pooled + self.p["bo"][0]
        return (logit, (states, kept, mid, alpha, pooled)) if keep else logit

    def logits(self, x: np.ndarray, codes: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty(len(text), np.float32)
        for a in range(0, len(text), LANES):
            s = slice(a, a + LANES)
            out[s] = self.forward(x, window_codes(codes, offsets, text[s], first[s], len(x) - 1))
        return out

    def text_logits(self, words: Words) -> np.ndarray:
        """The largest window logit of each text."""
        codes, hashes, slots, sizes = distinct_words(words)
        x = self.inputs(self.rows(hashes), slots, sizes)
        text, first = windows(words.counts())
        if not len(text):
            return np.zeros(0, np.float32)
        out = self.logits(x, codes, words.offsets, text, first)
        out = np.maximum.reduceat(out, np.flatnonzero(np.diff(text, prepend=-1)))
        empty = words.counts() == 0
        if empty.any():  # by itself, for a product's last bits depend on what else is in it
            out[empty] = self.forward(np.zeros((1, DIM), np.float32), np.zeros((WINDOW, 1), np.int64))
        return out

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit.astype(np.float64) + self.bias, -500, 500)))

    # ----------------------------------------------------------- backward

    def backward(self, x, codes, dlogit, saved) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters (but the embeddings) and of the inputs x."""
        states, kept, mid, alpha, pooled = saved
        p, steps = self.p, codes.shape[0]
        g = {"wo": pooled @ dlogit, "bo": dlogit.sum(keepdims=True)}
        dpool = p["wo"][:, None] * dlogit
        ds = alpha[:, None] * dpool
        da = np.einsum("thn,hn->tn", states, dpool, optimize=True)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["va"] = np.einsum("tan,tn->a", mid, de, optimize=True)
        dmid = (1 - mid * mid) * p["va"][:, None] * de[:, None]
        g["ba"] = dmid.sum(axis=(0, 2))[:, None]
        g["wa"] = np.einsum("tan,thn->ah", dmid, states, optimize=True)
        ds += np.einsum("ah,tan->thn", p["wa"], dmid, optimize=True)
        dx = np.zeros_like(x)
        g["u"], g["wx"], g["b"] = np.zeros_like(p["u"]), np.zeros_like(p["wx"]), np.zeros_like(p["b"])
        flat = codes.ravel()
        for d in (0, 1):
            dh = np.zeros_like(kept[d][0][0])
            dgates = np.empty((steps, 3 * HIDDEN, codes.shape[1]), np.float32)
            for t in (range(steps - 1, -1, -1) if d == 0 else range(steps)):
                h, rz, n, gn = kept[d][t]
                r, z = rz[:HIDDEN], rz[HIDDEN:]
                dh = dh + ds[t, d * HIDDEN:(d + 1) * HIDDEN]
                dz = dh * (h - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                dgates[t] = np.concatenate([dr, dz, dn])
                back = np.concatenate([dr, dz, dn * r])
                g["u"][d] += back @ h.T
                dh = dh * z + p["u"][d].T @ back
            flat_gates = dgates.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
            g["b"][d] = flat_gates.sum(axis=0)
            by_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for k in range(3 * HIDDEN):
                by_word[:, k] = np.bincount(flat, flat_gates[:, k], len(x))
            g["wx"][d] = x.T @ by_word
            dx += by_word @ p["wx"][d].T
        dx[-1] = 0
        return g, dx

    # ------------------------------------------------------- as bytes

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, scale=np.array([self.slope, self.bias]), **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as z:
            net = cls.__new__(cls)
            net.vocabulary = z["vocabulary"]
            net.slope, net.bias = z["scale"].tolist()
            net.p = {k: z[k] for k in z.files if k not in ("vocabulary", "scale")}
        return net


class Adam:
    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        fix = np.float32(self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += (g - m) * np.float32(0.1)
            v += (g * g - v) * np.float32(0.001)
            self.params[k] -= fix * m / (np.sqrt(v) + np.float32(1e-8))


EPOCHS, WARM, BATCH, RATE, DECAY = 12, 2, 256, 0.01, 1e-4
VOCABULARY, MIN_TEXTS = 20_000, 4
WINDOWS_A_TEXT = 48          # of a training text, evenly spread


def train(words: Words, labels: np.ndarray, seed: int = 7) -> Network:
    """Multiple-instance training: a text is as toxic as its worst window. A quarter
    of the texts is kept back to set the scale on which 0.7 parts the classes."""
    r = np.random.default_rng(seed)
    codes, hashes, slots, sizes = distinct_words(words)
    text, first = windows(words.counts())
    spread = np.zeros(len(text), bool)
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    per_text = np.diff(np.append(begin, len(text)))
    for b, n in zip(begin, per_text, strict=True):
        spread[b + np.unique(np.linspace(0, n - 1, min(n, WINDOWS_A_TEXT)).astype(int))] = True
    text, first = text[spread], first[spread]
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    order = r.permutation(len(labels))
    held = np.zeros(len(labels), bool)
    for label in (0, 1):
        own = order[labels[order] == label]
        held[own[:len(own) // 4]] = True

    owner = np.repeat(np.arange(len(words)), words.counts())
    fit_words = ~held[owner]
    seen = np.unique(np.stack([codes[fit_words], owner[fit_words]]), axis=1)[0]
    texts_with = np.bincount(seen, minlength=len(hashes))
    frequent = np.flatnonzero(texts_with >= MIN_TEXTS)
    frequent = frequent[np.argsort(-texts_with[frequent], kind="stable")][:VOCABULARY]
    net = Network(np.sort(hashes[frequent]), seed)
    rows = net.rows(hashes)
    adam = Adam(net.p, RATE)
    starts = np.cumsum(sizes) - sizes

    fit = np.flatnonzero(~held)
    positive = max(1, int(labels[fit].sum()))
    weight = np.where(labels == 1, np.clip(len(fit) / (3 * positive), 1, 4), 1).astype(np.float32)
    for epoch in range(EPOCHS):
        adam.rate = RATE * min(1, 2 * (1 - epoch / EPOCHS))
        now = net.logits(net.inputs(rows, slots, sizes), codes, words.offsets, text, first)
        chosen = []
        for i in fit:
            a, b = begin[i], begin[i + 1] if i + 1 < len(begin) else len(text)
            if labels[i] and epoch >= WARM:
                own = a + np.argsort(-now[a:b])[:2]
                chosen += [int(own[0]), *(int(k) for k in own[1:] if now[k] > 0.5)]
            elif labels[i]:
                chosen += (a + r.integers(0, b - a, 2)).tolist()
            else:
                chosen += [a + int(np.argmax(now[a:b])), int(r.integers(a, b))]
        chosen = r.permutation(np.array(chosen))
        for s in range(0, len(chosen), BATCH):
            pick = chosen[s:s + BATCH]
            local = window_codes(codes, words.offsets, text[pick], first[pick], len(hashes))
            used, inverse = np.unique(local, return_inverse=True)
            used = used[used < len(hashes)]
            inverse = inverse.reshape(local.shape)
            n = sizes[used]
            own_slots = take_ragged(slots, starts[used], n)
            x = net.inputs(rows[used], own_slots, n)
            logit, saved = net.forward(x, inverse, keep=True)
            y, w = labels[text[pick]], weight[text[pick]]
            dlogit = ((_sigmoid(logit) - (0.95 * y + 0.025)) * w / len(pick)).astype(np.float32)
            grads, dx = net.backward(x, inverse, dlogit, saved)
            dx = dx[:-1]
            grads["word"] = DECAY * net.p["word"]
            np.add.at(grads["word"], rows[used], dx)
            grads["gram"] = DECAY * net.p["gram"]
            np.add.at(grads["gram"], own_slots, np.repeat(dx / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
            adam.step(grads)
    last = np.maximum.reduceat(net.logits(net.inputs(rows, slots, sizes), codes, words.offsets, text, first), begin)
    check = held if len(set(labels[held].tolist())) == 2 else np.ones(len(labels), bool)
    net.slope, net.bias = _scale(last[check], labels[check])
    return net


def _scale(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """slope and bias that put 0.7 where the fewest errors are, false alarms counting
    twice: the middle of the best gap between neighbouring values."""
    order = np.argsort(logit)
    value, y = logit[order].astype(np.float64), label[order]
    missed = np.concatenate([[0], np.cumsum(y)])
    alarms = np.concatenate([[0], np.cumsum(1 - y)])
    cost = missed + 2 * (alarms[-1] - alarms)
    best = np.flatnonzero(cost == cost.min())
    k = int(best[len(best) // 2])
    low = value[k - 1] if k else value[0] - 1
    high = value[k] if k < len(value) else value[-1] + 1
    slope = 1.0
    return slope, float(np.log(0.7 / 0.3) - slope * (low + high) / 2)
