"""A small causal self-attention model in numpy: windows, forward pass, gradients, fitting.

The model reads words as the first and last of their subword ids and predicts the class of the next word's first subword: which of
``GROUPS`` groups, and which class within it. A window has ``QUERIES`` words to predict from and the ``CONTEXT`` words before
them; windows overlap by that context, and every word is predicted once.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

QUERIES, CONTEXT, WIDTH, HIDDEN, GROUPS = 16, 16, 16, 24, 8
SPAN = QUERIES + CONTEXT
CLASSES = GROUPS * GROUPS
ROWS = 4096  # rows of the embedding tables; ids share them by remainder
START, PAD = ROWS, ROWS + 1
MASK = np.where(np.arange(SPAN)[None, :] <= CONTEXT + np.arange(QUERIES)[:, None], 0.0, -1e9).astype(np.float32)
FAR = np.float32(-1e9)
SCALE = np.float32(1 / np.sqrt(WIDTH))


def windows_of(sizes: np.ndarray, first: np.ndarray, last: np.ndarray, target: np.ndarray):
    """Windows over texts laid end to end: (first ids, last ids) per window and place, (target, valid) per window and query.

    ``sizes``: words per text, one more target than words each, as a text is ended by a token of its own. The first input of a text is ``START``.
    """
    blocks = -(-(sizes + 1) // QUERIES)
    total = max(int(blocks.sum()) * QUERIES + len(sizes) * CONTEXT, SPAN)
    begin = np.cumsum(blocks * QUERIES + CONTEXT) - blocks * QUERIES  # where each text's start token stands
    inputs = [np.full(total, PAD, np.int32), np.full(total, PAD, np.int32)]
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = begin[text] + 1 + np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for table, ids in zip(inputs, (first, last)):
        table[place] = ids % ROWS
        table[begin] = START
    wanted, valid = np.zeros(total, np.int16), np.zeros(total, bool)
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    wanted[place], valid[place] = target, True
    at = np.repeat(begin, blocks) + QUERIES * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    inputs = [sliding_window_view(table, SPAN)[at - CONTEXT] for table in inputs]
    wanted, valid = (sliding_window_view(table, QUERIES)[at] for table in (wanted, valid))
    return *inputs, wanted, valid, place, at[:, None] + np.arange(QUERIES)


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept as an axis; one product with ones is faster than a reduction over few values."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(*x.shape[:-1], 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, in place. Values over 30 count as 30, so that nothing overflows."""
    np.exp(np.minimum(x, np.float32(30), out=x), out=x)
    x /= _row_sums(x)
    return x


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _times(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``x @ by`` for windows ``x``: one product over all rows is faster than one for each window."""
    return (_flat(x) @ by).reshape(*x.shape[:-1], by.shape[1])


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, by one exponential; beyond 15 it is 1 in this precision."""
    np.exp(np.clip(x, np.float32(-15), np.float32(15), out=x) * np.float32(-2), out=x)
    x += 1
    np.divide(np.float32(2), x, out=x)
    x -= 1
    return x


def _id_sums(ids: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The sum of the rows of each id; ``columns`` has the rows' columns, one after another. A column's sums stay in the fastest cache."""
    sums = np.empty((len(columns), ROWS + 2), np.float32)
    for own, column in zip(sums, columns):
        own[:] = np.bincount(ids, column, ROWS + 2)
    return sums.T.copy()


class Model:
    """Parameters by name; the last two are the embeddings, a row per subword id."""

    NAMES = ("query", "key", "value", "near", "own", "seen", "bias", "out", "offset", "first", "last")

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)

        def some(*shape, scale=1.0):
            return (rng.standard_normal(shape) * scale / np.sqrt(shape[0])).astype(np.float32)

        self.first, self.last = (rng.standard_normal((2, ROWS + 2, WIDTH)) * 0.3).astype(np.float32)
        self.query, self.key, self.value = some(WIDTH, WIDTH), some(WIDTH, WIDTH), some(WIDTH, WIDTH)
        self.near = np.zeros((QUERIES, SPAN), np.float32)
        self.own, self.seen, self.bias = some(WIDTH, HIDDEN), some(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.out, self.offset = some(HIDDEN, GROUPS + CLASSES, scale=0.5), np.zeros(GROUPS + CLASSES, np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, vector[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def forward(self, first: np.ndarray, last: np.ndarray, target: np.ndarray) -> dict:
        x = self.first.take(first, axis=0)
        x += self.last.take(last, axis=0)
        xq = np.ascontiguousarray(x[:, CONTEXT:])
        q, both = _times(xq, self.query * SCALE), _times(x, np.hstack([self.key, self.value]))
        k, v = both[..., :WIDTH], both[..., WIDTH:]
        score = q @ k.transpose(0, 2, 1)
        score += self.near + MASK
        padded = first == PAD
        some = np.flatnonzero(padded.any(axis=1))
        score[some] += np.where(padded[some], FAR, np.float32(0))[:, None, :]
        score = _softmax(score)
        seen = score @ v
        hidden = _flat(xq) @ self.own
        hidden += _flat(seen) @ self.seen
        hidden += self.bias
        hidden = _tanh(hidden)
        logits = hidden @ self.out
        logits += self.offset
        logits = logits.reshape(-1, GROUPS)  # of each query the groups, then the classes of each
        rows, wanted = np.arange(target.size), target.ravel()
        group, within = np.divmod(wanted.astype(np.int64), GROUPS)
        parts = []
        for place, aim in ((rows * (1 + GROUPS), group), (rows * (1 + GROUPS) + 1 + group, within)):
            part, at = _softmax(logits.take(place, axis=0)), rows * GROUPS + aim
            parts.append((place, part, part.ravel()[at], at))
        return {"x": x, "xq": xq, "q": q, "k": k, "v": v, "weight": score, "seen": seen, "hidden": hidden, "parts": parts,
                "p": parts[0][2] * parts[1][2]}

    def log10(self, first, last, target) -> np.ndarray:
        """log10 of the probability of each target, one per query."""
        return np.log10(np.maximum(self.forward(first, last, target)["p"], 1e-30)).reshape(target.shape)

    def gradients(self, first, last, target, valid, embeddings: bool, loss: bool = True) -> tuple[dict[str, np.ndarray], float | None]:
        """Gradients of the mean loss over valid queries, by name, and that loss, if asked for."""
        f = self.forward(first, last, target)
        keep = valid.ravel()
        scale = np.float32(1.0 / max(keep.sum(), 1))
        back = np.zeros((len(keep) * (1 + GROUPS), GROUPS), np.float32)
        by = (keep * scale)[:, None]
        for place, part, _, at in f["parts"]:
            part.ravel()[at] -= 1
            part *= by
            back[place] = part
        back, ones = back.reshape(len(keep), -1), np.ones(len(keep), np.float32)
        g = {"out": f["hidden"].T @ back, "offset": ones @ back}
        inner = back @ self.out.T
        inner *= 1 - f["hidden"] ** 2
        x, n = f["x"], len(first)
        xq = _flat(f["xq"])
        g["own"], g["seen"], g["bias"] = xq.T @ inner, _flat(f["seen"]).T @ inner, ones @ inner
        to_seen = (inner @ self.seen.T).reshape(n, QUERIES, WIDTH)
        weight = f["weight"]
        to_score = to_seen @ f["v"].transpose(0, 2, 1)
        to_score -= _row_sums(to_score * weight)
        to_score *= weight
        g["near"] = to_score.sum(axis=0)
        to_q = to_score @ f["k"]
        to_q *= SCALE
        to_both = np.empty((*x.shape[:2], 2 * WIDTH), np.float32)
        to_both[..., :WIDTH] = to_score.transpose(0, 2, 1) @ f["q"]  # q holds the scale already
        to_both[..., WIDTH:] = weight.transpose(0, 2, 1) @ to_seen
        g["query"] = xq.T @ _flat(to_q)
        g["key"], g["value"] = np.hsplit(_flat(x).T @ _flat(to_both), 2)
        if embeddings:
            to_x = _times(to_both, np.vstack([self.key.T, self.value.T]))
            to_x[:, CONTEXT:] += (inner @ self.own.T + _flat(to_q) @ self.query.T).reshape(n, QUERIES, WIDTH)
            columns = _flat(to_x).T.astype(np.float64, order="C")
            g["e_first"], g["e_last"] = (_id_sums(ids.ravel().astype(np.int64), columns) for ids in (first, last))
        if not loss:
            return g, None
        return g, -float(np.log(np.maximum(f["p"][keep], 1e-30)).mean()) if keep.any() else 0.0


class Fit:
    """Adam over a model's parameters."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.one: dict[str, np.ndarray] = {}
        self.two: dict[str, np.ndarray] = {}

    def learn(self, first, last, target, valid, rate: float | None = None) -> None:
        grads, _ = self.model.gradients(first, last, target, valid, True, loss=False)
        self.step += 1
        for name, g in grads.items():
            if name not in self.one:
                self.one[name], self.two[name] = np.zeros_like(g), np.zeros_like(g)
            one, two = self.one[name], self.two[name]  # 10 times the mean, 100 times that of the squares
            one *= 0.9
            one += g
            two *= 0.99
            g *= g
            two += g
            scale = 0.1 / np.sqrt(1 - 0.99 ** self.step)
            step = np.sqrt(two, out=g)
            step += 1e-8 / scale
            np.divide(one, step, out=step)
            step *= 0.1 / scale * (rate or self.rate) / (1 - 0.9 ** self.step)
            own = {"e_first": "first", "e_last": "last"}.get(name, name)
            setattr(self.model, own, getattr(self.model, own) - step)
