"""A gated recurrent language model in numpy, with a class-factored output softmax.

P(unit | past) = P(class | state) * P(unit | class, state).  Units are numbered so
that the members of a class are neighbours.  Texts are laid end to end on lanes;
the state is carried from window to window along a lane and reset after the end
unit, so a text's log-likelihood covers it whole, however long it is.  Training
propagates errors back through one window at a time.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np

Weights = dict[str, np.ndarray]


def classes(counts: np.ndarray, n: int) -> np.ndarray:
    """First unit of each class; ``counts`` fall, and classes have like shares of their square roots."""
    share = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.searchsorted(share, share[-1] * np.arange(1, n) / n)
    return np.unique(np.r_[0, np.minimum(cut, len(counts) - 1)])


def start(counts: np.ndarray, first: np.ndarray, hidden: int, seed: int = 1) -> Weights:
    """Random weights with biases that make the model the unigram model of ``counts``."""
    rng, units = np.random.default_rng(seed), len(counts)
    p = (counts + 0.5) / (counts + 0.5).sum()
    by_class = np.add.reduceat(p, first)
    f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {"x": f(units, 3 * hidden, scale=0.3), "h": f(hidden, 3 * hidden, scale=hidden**-0.5), "c": f(len(first), hidden, scale=0.02), "cb": np.log(by_class).astype(np.float32), "w": f(units, hidden, scale=0.02), "wb": np.log(p / np.repeat(by_class, np.diff(np.r_[first, units]))).astype(np.float32)}


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Texts for each of at most ``n`` lanes, the longest first to the emptiest lane; lanes by falling length."""
    heap = [(0, i) for i in range(min(n, len(lengths)))]
    heapify(heap)
    out: list[list[int]] = [[] for _ in heap]
    for t in np.argsort(-lengths, kind="stable").tolist():
        size, i = heap[0]
        out[i].append(t)
        heapreplace(heap, (size + int(lengths[t]), i))
    return sorted(out, key=lambda ts: -int(lengths[ts].sum()))


def windows(texts: list[np.ndarray], n_lanes: int, width: int, end: int, rows: int = 0):
    """(units, text numbers) of each window, both (steps, lanes); past a lane's end the text number is -1.

    A window has ``width`` steps or, while half of its lanes go on, as many more as fit into ``rows`` places.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(lengths):
        return
    plan = lanes(lengths, n_lanes)
    order = np.array([t for ts in plan for t in ts])
    flat, which = np.concatenate([texts[t] for t in order]), np.repeat(order, lengths[order])
    size = np.array([int(lengths[ts].sum()) for ts in plan])
    begin = np.cumsum(size) - size
    at = 0
    while at < size[0]:
        live = int((size > at).sum())
        steps = max(width, min(rows // live, int(size[live // 2]) - at))
        place = at + np.arange(min(steps, int(size[0]) - at))[:, None]
        real = place < size[:live]
        index = np.where(real, place + begin[:live], 0)
        yield np.where(real, flat[index], end), np.where(real, which[index], -1)
        at += steps


class _Tape:
    """What steps leave for the way back, in memory that windows use again: fresh pages cost more than what is written to them.

    Each gate's values of a step lie together, as numpy goes over short rows of wider ones several times as slowly.
    """

    def __init__(self, steps: int, lanes: int, size: int):
        self.gates, self.new, self.given, self.own = (np.empty(steps * lanes * k * size, np.float32) for k in (2, 1, 3, 1))
        self.size = size

    def views(self, steps: int, lanes: int) -> list[np.ndarray]:
        """(gates, new states, errors of what units give, what states give the new ones) of a window, (parts, steps, lanes, hidden)."""
        return [x[: k * steps * lanes * self.size].reshape(k, steps, lanes, self.size) for x, k in ((self.gates, 2), (self.new, 1), (self.given, 3), (self.own, 1))]


def _parts(x: np.ndarray, size: int) -> np.ndarray:
    """Columns of both gates and of new states apart: (3, rows, hidden)."""
    return np.ascontiguousarray(x.reshape(len(x), 3, size).transpose(1, 0, 2))


def _forward(w: Weights, units: np.ndarray, h: np.ndarray, end: int, tape: list[np.ndarray] | None) -> np.ndarray:
    """States before each step and after the last, (steps + 1, lanes, hidden)."""
    lanes, size = h.shape
    states = np.empty((len(units) + 1, lanes, size), np.float32)
    states[0] = h
    x, by_state = _parts(w["x"], size), _parts(w["h"], size)
    # a sigmoid is half a tanh of half of it, and halves are exact
    x[:2] *= np.float32(0.5)
    by_state[:2] *= np.float32(0.5)
    gates, new, _, own = tape or _Tape(1, lanes, size).views(1, lanes)
    two, ends = np.empty((2, lanes, size), np.float32), units == end
    some, together = ends.any(axis=1).tolist(), max(1, 1024 // lanes)
    for t in range(len(units)):
        if t % together == 0:
            block = np.take(x, units[t : t + together], axis=1, mode="clip")
        given = block[:, t % together]
        h, after = states[t], states[t + 1]
        zr, c, a = gates[:, t if tape else 0], new[0, t if tape else 0], own[0, t if tape else 0]
        np.matmul(h, by_state[:2], out=two)
        np.matmul(h, by_state[2], out=a)
        np.add(given[:2], two, out=zr)
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r = zr
        np.multiply(r, a, out=c)
        c += given[2]
        np.tanh(c, out=c)
        np.subtract(h, c, out=after)
        after *= z
        after += c
        if some[t]:
            after[ends[t]] = 0
    return states


def _backward(w: Weights, units: np.ndarray, states: np.ndarray, errors: np.ndarray, end: int, tape: list[np.ndarray]) -> np.ndarray:
    """Gradient of ``h`` from the states' errors; the errors of what units give stay on the tape."""
    lanes, size = states.shape[1:]
    gates, new, given, own = tape
    by_state = np.ascontiguousarray(_parts(w["h"], size).transpose(0, 2, 1))
    dh, u, two = np.zeros((lanes, size), np.float32), np.empty((lanes, size), np.float32), np.empty((2, lanes, size), np.float32)
    for t in reversed(range(len(units))):
        (z, r), c, (dz, dr, dn), a = gates[:, t], new[0, t], given[:, t], own[0, t]
        dh[units[t] == end] = 0
        np.subtract(1, z, out=dn)
        dn *= dh
        np.subtract(states[t], c, out=dz)
        dz *= z
        dz *= dn
        np.multiply(c, c, out=u)
        np.subtract(1, u, out=u)
        dn *= u
        np.subtract(1, r, out=dr)
        dr *= r
        dr *= a
        dr *= dn
        # from here on the error of what states give the new ones
        np.multiply(dn, r, out=a)
        dh *= z
        np.matmul(given[:2, t], by_state[:2], out=two)
        np.matmul(a, by_state[2], out=u)
        dh += two[0]
        dh += two[1]
        dh += u
        dh += errors[t]
    before = states[:-1].reshape(-1, size).T
    return np.concatenate([before @ d.reshape(-1, size) for d in (given[0], given[1], own[0])], axis=1)


def _sums(rows: np.ndarray, numbers: np.ndarray, below: int, few: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """The different ``numbers`` and for each the sum of its ``rows``.

    The first ``few`` rows of all numbers are added at once, the next row of each at a time; the rest of those that have more, number by number.
    """
    rows = np.take(rows, _order(numbers, below), axis=0)
    count = np.bincount(numbers, minlength=below)
    found = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    begin, size = (np.cumsum(count) - count)[found], count[found]
    out = np.take(rows, begin, axis=0)
    for j in range(1, few):
        more = int(np.searchsorted(-size, -j))
        if not more:
            break
        out[:more] += np.take(rows, begin[:more] + j, axis=0)
    for i in range(int(np.searchsorted(-size, -few))):
        rest = rows[begin[i] + few : begin[i] + size[i]]
        out[i] += np.ones(len(rest), np.float32) @ rest
    return found, out


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """Stable order of ``numbers``; 16 bits at most are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _most(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Bound of each unit's absolute logit: a state's values lie between -1 and 1."""
    return np.abs(weights).sum(axis=1) + np.abs(bias)


def _outputs(w: Weights, states: np.ndarray, units: np.ndarray, real: np.ndarray, first: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, Weights]:
    """(places, values, gradients): places of all ``real`` rows by class and, of each, the natural log-likelihood
    of its unit given its state or, with ``learn``, the error of the state.

    Biases are weights of a last state that is one.
    """
    last = np.r_[first[1:], len(w["wb"])]
    n = len(first)
    class_of = np.repeat(np.arange(n), last - first)
    places = np.flatnonzero(real)
    places = places[_order(class_of[units[places]], n)]
    units, size = units[places], states.shape[1]
    edges = np.searchsorted(class_of[units], np.arange(n + 1))
    rows = np.ones((len(places), size + 1), np.float32)
    rows[:, :size] = np.take(states, places, axis=0)
    by_class, by_unit = np.c_[w["c"], w["cb"]], np.c_[w["w"], w["wb"]]
    most = np.maximum(np.maximum.reduceat(_most(w["w"], w["wb"]), first), _most(w["c"], w["cb"]).max())
    out = np.empty((len(rows), size) if learn else len(rows), np.float32)
    grads = {k: np.zeros_like(w[k]) for k in ("c", "cb", "w", "wb")} if learn else {}
    for k in range(n):
        # rows of a class lie together: the classes and its units are two softmaxes side by side
        piece, a, b = slice(int(edges[k]), int(edges[k + 1])), int(first[k]), int(last[k])
        s = rows[piece]
        if not len(s):
            continue
        both = np.concatenate([by_class, by_unit[a:b]])
        logit = s @ both.T
        sides, own = (logit[:, :n], logit[:, n:]), np.arange(len(s)) * len(both) + (units[piece] - a + n)
        # rows are only lowered by their largest values where the bound does not rule out an overflow
        if most[k] > 60:
            for x in sides:
                x -= x.max(axis=1, keepdims=True)
        if not learn:
            out[piece] = logit[:, k] + np.take(logit, own)
        np.exp(logit, out=logit)
        mask = np.zeros((len(both), 2), np.float32)
        mask[:n, 0] = mask[n:, 1] = 1
        total = logit @ mask
        if not learn:
            np.log(total, out=total)
            out[piece] -= total[:, 0]
            out[piece] -= total[:, 1]
            continue
        logit[:, k] -= total[:, 0]
        logit.reshape(-1)[own] -= total[:, 1]
        factor = 1 / total
        for i, x in enumerate(sides):
            x *= factor[:, i : i + 1]
        grad = logit.T @ s
        grads["c"] += grad[:n, :size]
        grads["cb"] += grad[:n, size]
        grads["w"][a:b], grads["wb"][a:b] = grad[n:, :size], grad[n:, size]
        np.matmul(logit, both[:, :size], out=out[piece])
    return places, out, grads


def score(w: Weights, first: np.ndarray, texts: list[np.ndarray], end: int, n_lanes: int = 512, width: int = 32) -> np.ndarray:
    """log10 likelihood of each text; every text ends with the end unit."""
    out = np.zeros(len(texts))
    size, h = len(w["h"]), None
    for units, text in windows(texts, n_lanes, width, end, n_lanes * width):
        h = np.zeros((units.shape[1], size), np.float32) if h is None else h[: units.shape[1]]
        states = _forward(w, units, h, end, None)
        text = text.ravel()
        places, got, _ = _outputs(w, states[:-1].reshape(-1, size), units.ravel(), text >= 0, first, False)
        out += np.bincount(text[places], weights=got, minlength=len(texts))
        h = states[-1]
    return out / np.log(10)


def train(w: Weights, first: np.ndarray, texts: list[np.ndarray], end: int, memory: Weights | None = None, n_lanes: int = 256, width: int = 16, rate: float = 0.06) -> tuple[Weights, Weights]:
    """One pass over ``texts`` with Adagrad; returns new weights and the sums of squares."""
    w = {k: v.copy() for k, v in w.items()}
    memory = {k: np.full_like(v, 1e-4) for k, v in w.items()} if memory is None else memory
    size, h, kept = len(w["h"]), None, None
    for units, text in windows(texts, n_lanes, width, end):
        h = np.zeros((units.shape[1], size), np.float32) if h is None else h[: units.shape[1]]
        # the first window has the most lanes and steps
        kept = kept or _Tape(*units.shape, size)
        tape = kept.views(*units.shape)
        states = _forward(w, units, h, end, tape)
        places, back, grads = _outputs(w, states[:-1].reshape(-1, size), units.ravel(), text.ravel() >= 0, first, True)
        # back to the order of steps; places past a lane's end take the row of zeros behind the others
        row = np.full(units.size, len(places))
        row[places] = np.arange(len(places))
        errors = np.take(np.concatenate([back, np.zeros((1, size), np.float32)]), row, axis=0).reshape(*units.shape, size)
        grads["h"] = _backward(w, units, states, errors, end, tape)
        given = tape[2].reshape(3, -1, size).transpose(1, 0, 2).reshape(-1, 3 * size)
        touched, grad_x = _sums(given, units.ravel(), len(w["wb"]))
        scale = np.float32(1 / max(1, len(places)))
        for k, g in grads.items():
            g *= scale
            memory[k] += g * g
            w[k] -= rate * g / np.sqrt(memory[k])
        grad_x *= scale
        memory["x"][touched] += grad_x * grad_x
        w["x"][touched] -= rate * grad_x / np.sqrt(memory["x"][touched])
        h = states[-1]
    return w, memory
