"""A small causal self-attention model in numpy: training, and scoring in overlapping windows.

One layer, one head. A position is the sum of two embeddings; it attends to itself and to earlier positions, with a learned bias for each
distance; a hidden layer over the position and what it attended to predicts the next token's group of classes, and its class in that group. Frequent tokens
are classes of their own, the others share classes by frequency, within which a token's probability is its smoothed share of the corpus counts. So
probabilities add up to one over all tokens at a small part of the cost of a full vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE, HIDDEN = 16, 32
CLASSES, SHARED = 128, 32  # classes in all, and those that hold more than one token
GROUP = 16  # neighbouring classes that make a group
WINDOW, STRIDE = 32, 16  # a window's later half is scored, its earlier half is context; the first one is scored whole
POSITIONS_AT_ONCE = 1 << 12
LIMIT = 40.0
SMOOTHING = 0.1
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, WINDOW])


def _exp(z: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """The last axis' powers in place, zero for what is not ``seen``, and their sums. Logits end at LIMIT, so no row's largest has to be found; divided by the sums they add
    up to one all the same."""
    np.clip(z, -LIMIT, LIMIT, out=z)
    np.exp(z, out=z)
    if seen is not None:
        z *= seen.astype(z.dtype)
    return z @ np.ones(z.shape[-1], z.dtype)


def _sums(z: np.ndarray) -> np.ndarray:
    """Sums over the first axis. A product is faster than numpy's sum over rows this short."""
    return np.ones(len(z), z.dtype) @ z


def _turned(z: np.ndarray) -> np.ndarray:
    """The last two axes exchanged, in memory too: many small products of such are faster than of a view."""
    return np.ascontiguousarray(z.transpose(0, 2, 1))


def _sums_by_row(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and the sum of the values of each."""
    order = np.argsort(ids, kind="stable")
    ids = ids.take(order)
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[new], np.add.reduceat(values.take(order, axis=0), new, axis=0)


class Vocabulary:
    """Token classes from corpus counts, and each token's log probability within its class."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        single = CLASSES - SHARED
        self.of = np.empty(len(counts), dtype=np.int64)
        self.of[order[:single]] = np.arange(min(single, len(counts)))
        rest = order[single:]
        # Shared classes grow with rank, so each holds about as much probability.
        edges = np.unique(np.geomspace(1, len(rest) + 1, SHARED + 1).astype(np.int64)) if len(rest) else np.array([1])
        self.of[rest] = single + np.minimum(np.searchsorted(edges, np.arange(1, len(rest) + 1), side="right") - 1, SHARED - 1)
        smooth = counts + SMOOTHING
        totals = np.bincount(self.of, weights=smooth, minlength=CLASSES)
        self.inside = np.log(smooth / totals[self.of])
        self.prior = np.log(np.maximum(totals, 1e-9) / totals.sum())


class Attention:
    """Parameters and the two directions of computation."""

    def __init__(self, tokens: int, prior: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "a": normal(tokens, SIZE, scale=0.3),
            "b": normal(tokens, SIZE, scale=0.3),
            "q": normal(SIZE, SIZE, scale=0.25),
            "k": normal(SIZE, SIZE, scale=0.25),
            "v": normal(SIZE, SIZE, scale=0.25),
            "near": np.zeros(WINDOW, np.float32),
            "w1": normal(2 * SIZE, HIDDEN, scale=0.2),
            "c1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, CLASSES, scale=0.1),
            "c2": prior.astype(np.float32),
            "w3": normal(HIDDEN, CLASSES // GROUP, scale=0.1),
            "c3": np.logaddexp.reduceat(prior, np.arange(0, CLASSES, GROUP)).astype(np.float32),
        }

    def vectors(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = self.p["a"].take(a, axis=0)
        x += self.p["b"].take(b, axis=0)
        return x

    def _attend(self, x: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
        """For positions ``first`` on of windows x (n, length, SIZE): their queries, keys, values, weights before they are divided by their sums, and these."""
        p, (n, length, _) = self.p, x.shape
        flat = x.reshape(-1, SIZE)
        q = (x[:, first:].reshape(-1, SIZE) @ (p["q"] * np.float32(SIZE**-0.5))).reshape(n, -1, SIZE)
        k, v = (flat @ p["k"]).reshape(x.shape), (flat @ p["v"]).reshape(x.shape)
        back = np.arange(first, length)[:, None] - np.arange(length)
        s = q @ _turned(k)
        s += p["near"][np.maximum(back, 0)]
        return q, k, v, s, _exp(s, back >= 0)

    def _outputs(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of hidden rows h in the order of their target's group: what precedes the two softmaxes, over groups and over the target group's classes,
        and where each group's rows begin."""
        p = self.p
        begin = np.searchsorted(target // GROUP, np.arange(CLASSES // GROUP + 1))
        groups = h @ p["w3"]
        groups += p["c3"]
        classes = np.empty((len(h), GROUP), h.dtype)
        for j, (s, e) in enumerate(zip(begin, begin[1:], strict=False)):
            if e > s:
                own = slice(j * GROUP, (j + 1) * GROUP)
                np.matmul(h[s:e], p["w2"][:, own], out=classes[s:e])
                classes[s:e] += p["c2"][own]
        return groups, classes, begin

    def log_class(self, x: np.ndarray, first: int, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the target classes at positions ``first`` on."""
        p = self.p
        _, _, v, s, total = self._attend(x, first)
        o = s @ v
        o /= total[..., None]
        order = np.argsort((target.ravel() // GROUP).astype(np.uint8), kind="stable")
        wanted = target.ravel()[order]
        h = np.concatenate([x[:, first:], o], axis=2).reshape(-1, 2 * SIZE) @ p["w1"]
        h += p["c1"]
        np.maximum(h, 0, out=h)
        found = np.zeros(len(order), h.dtype)
        groups, classes, _ = self._outputs(h.take(order, axis=0), wanted)
        for z, hit in ((groups, wanted // GROUP), (classes, wanted % GROUP)):
            total = _exp(z)
            found += np.log(z[np.arange(len(z)), hit] / total)
        out = np.empty_like(found)
        out[order] = found
        return out.reshape(target.shape)

    def step(self, a: np.ndarray, b: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions of windows by their weights (0 or false: none), and its slopes."""
        p = self.p
        x = self.vectors(a, b)
        q, k, v, s, total = self._attend(x, 0)
        s *= (1 / total)[..., None]
        o = s @ v
        order = np.argsort((target.ravel() // GROUP).astype(np.uint8), kind="stable")
        wanted = target.ravel()[order]
        flat = x.reshape(-1, SIZE)
        both = np.concatenate([flat, o.reshape(-1, SIZE)], axis=1)
        h = both @ p["w1"]
        h += p["c1"]
        np.maximum(h, 0, out=h)
        h = h.take(order, axis=0)
        share = (weight.ravel()[order] / max(1.0, float(weight.sum()))).astype(h.dtype)
        groups, classes, begin = self._outputs(h, wanted)
        loss = 0.0
        for e, hit in ((groups, wanted // GROUP), (classes, wanted % GROUP)):
            total = _exp(e)
            at = (np.arange(len(e)), hit)
            loss -= float(np.log(np.maximum(e[at] / total, 1e-30)) @ share)
            e *= (share / total)[:, None]
            e[at] -= share
        g = {"w3": h.T @ groups, "c3": _sums(groups), "w2": np.zeros_like(p["w2"]), "c2": np.zeros_like(p["c2"])}
        dh = groups @ p["w3"].T
        for j, (i, e) in enumerate(zip(begin, begin[1:], strict=False)):
            if e > i:
                own = slice(j * GROUP, (j + 1) * GROUP)
                g["w2"][:, own] = h[i:e].T @ classes[i:e]
                g["c2"][own] = _sums(classes[i:e])
                dh[i:e] += classes[i:e] @ p["w2"][:, own].T
        dh *= h > 0
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        dpre = dh.take(place, axis=0)
        g |= {"w1": both.T @ dpre, "c1": _sums(dh)}
        dboth = dpre @ p["w1"].T
        dx, do = (np.ascontiguousarray(d) for d in (dboth[:, :SIZE], dboth[:, SIZE:]))
        do = do.reshape(x.shape)
        ds = do @ _turned(v)
        dv = s.transpose(0, 2, 1) @ do
        ds -= np.einsum("nij,nij->ni", ds, s)[:, :, None]
        ds *= s
        scale = np.float32(SIZE**-0.5)
        dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q
        length = x.shape[1]
        back = np.arange(length)[:, None] - np.arange(length)
        sums = ds.sum(axis=0)
        g["near"] = np.bincount(back[back >= 0], weights=sums[back >= 0], minlength=WINDOW).astype(np.float32)
        for name, d in (("q", dq), ("k", dk), ("v", dv)):
            d = d.reshape(-1, SIZE)
            g[name] = flat.T @ d
            dx += d @ p[name].T
        for name, ids in (("a", a), ("b", b)):
            g[name] = (ids.ravel(), dx)
        return loss, g


class Adam:
    """Moves a model's weights by slopes; embeddings only where a batch uses them."""

    def __init__(self, model: Attention, rate: float = 0.01):
        self.model, self.rate, self.t = model, rate, 0
        self.mean = {n: np.zeros_like(w) for n, w in model.p.items()}
        self.square = {n: np.zeros_like(w) for n, w in model.p.items()}

    def learn(self, a: np.ndarray, b: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
        """One step on a batch; its loss before it."""
        loss, slopes = self.model.step(a, b, target, weight)
        self.t += 1
        now = np.float32(self.rate * min(1.0, self.t / 50) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for name, g in slopes.items():
            if name in "ab":
                # Ids of 16 bits are sorted by digits.
                rows, g = _sums_by_row(g[0].astype(np.uint16) if len(self.mean[name]) <= 1 << 16 else g[0], g[1])
                mean, square = self.mean[name].take(rows, axis=0), self.square[name].take(rows, axis=0)
            else:
                rows, mean, square = slice(None), self.mean[name], self.square[name]
            mean = 0.9 * mean + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            self.mean[name][rows], self.square[name][rows] = mean, square
            self.model.p[name][rows] -= now * mean / (np.sqrt(square) + 1e-8)
        return loss


def train(model: Attention, batches: Iterator[tuple[np.ndarray, ...]], rate: float = 0.01) -> float:
    """Adam over the given batches. Returns the mean loss of the last batches."""
    adam = Adam(model, rate)
    losses = [adam.learn(*batch) for batch in batches]
    return float(np.mean(losses[-50:])) if losses else 0.0


def score(model: Attention, words: Vocabulary, x: np.ndarray, row: np.ndarray, target: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log probability of each target token.

    Sequence i holds positions first[i] to first[i + 1]; position j has vector ``x[row[j]]`` and is to predict ``target[j]``. Sequences longer than a
    window are scored in windows that overlap by half, each position once, with at least STRIDE and up to WINDOW positions before it.
    """
    out = np.zeros(len(row))
    classes = words.of[target]
    lengths = np.diff(first)
    begin = first[:-1][lengths > 0]
    lengths = lengths[lengths > 0]
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    later = np.repeat(begin, more) + STRIDE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    ends = np.repeat(begin + lengths, more)
    fits = _LENGTHS[np.searchsorted(_LENGTHS, np.minimum(lengths, WINDOW))]
    groups = [(int(n), 0, begin[fits == n], (begin + lengths)[fits == n]) for n in np.unique(fits)]
    groups.append((WINDOW, STRIDE, later, ends))
    for length, skip, starts, stops in groups:
        at_once = max(1, POSITIONS_AT_ONCE // length)
        for at in range(0, len(starts), at_once):
            s = starts[at : at + at_once]
            position = s[:, None] + np.arange(length)
            real = position < stops[at : at + at_once, None]
            position = np.where(real, position, s[:, None])
            scored, real = position[:, skip:], real[:, skip:]
            found = model.log_class(x.take(row[position], axis=0), skip, classes[scored])
            out[scored[real]] = found[real]
    return out + words.inside[target]
