"""A small causal self-attention model over subword slots, in numpy.

One attention layer over windows of ``LENGTH`` slots, with a bias by distance, a hidden layer on
the attended and the own embedding, and an output in two steps of 32 classes each (a slot is
``32 * high + low``).  All arrays have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import numpy as np

LENGTH, CONTEXT = 32, 8
STRIDE = LENGTH - CONTEXT
SIDE = 32
SLOTS = SIDE * SIDE
START = SLOTS  # the slot before a text
WIDTH, HIDDEN = 16, 32
_I = np.arange(LENGTH)
_DISTANCE = np.maximum(_I[:, None] - _I, 0)
_MASK = np.where(_I[:, None] >= _I, 0, -1e9).astype(np.float32)

SHAPES = {
    "embed": (SLOTS + 1, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "bias": (LENGTH,),
    "mix": (WIDTH, HIDDEN),
    "mix_bias": (HIDDEN,),
    "high": (HIDDEN, SIDE),
    "high_bias": (SIDE,),
    "low": (HIDDEN, SIDE),
    "low_bias": (SIDE, SIDE),
}

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int = 7) -> Params:
    """Random weights; the output biases give the slots' own frequencies."""
    rng = np.random.default_rng(seed)
    params = {
        name: (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
        for name, shape in SHAPES.items()
    }
    params["embed"] = (0.3 * rng.standard_normal(SHAPES["embed"])).astype(np.float32)
    table = (counts + 0.5).reshape(SIDE, SIDE)
    params["high_bias"] = np.log(table.sum(axis=1) / table.sum()).astype(np.float32)
    params["low_bias"] = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    params["bias"] = (-0.1 * np.arange(LENGTH)).astype(np.float32)
    params["mix_bias"] = np.zeros(HIDDEN, np.float32)
    params["high"] *= 0.1
    params["low"] *= 0.1
    return params


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in SHAPES])


def views(values: np.ndarray) -> Params:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = values[at : at + n].reshape(shape)
        at += n
    return out


def unflat(values: np.ndarray) -> Params:
    return views(values.astype(np.float32))


BLOCK = 64
# Rows of one product; small products run faster for each row.
ROWS = 256
# Below these sizes exponents are taken as they are, above them less the largest of their row.
CLOSE, NEAR = 40, 80
_EYE = np.eye(SIDE, dtype=np.float32)
_HALVES = np.repeat(np.eye(2, dtype=np.float32), SIDE, axis=0)
_ONES = np.ones((LENGTH, WIDTH), np.float32)
_BOTH = np.ascontiguousarray(_HALVES.T)


class Room:
    """Arrays by name and shape that are used again for each block; new ones would cost page faults."""

    def __init__(self) -> None:
        self.whole: dict[str, np.ndarray] = {}
        self.found: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        if (name, shape) not in self.found:
            size = int(np.prod(shape))
            if name not in self.whole or len(self.whole[name]) < size:
                self.found = {k: v for k, v in self.found.items() if k[0] != name}
                self.whole[name] = np.empty(size, np.float32)
            self.found[name, shape] = self.whole[name][:size].reshape(shape)
        return self.found[name, shape]


def _cut(x: np.ndarray) -> np.ndarray:
    """Rows in equal parts, for products by parts."""
    return x.reshape(-1, ROWS if len(x) % ROWS == 0 else max(len(x), 1), x.shape[-1])


def _times(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.matmul(_cut(x), y, out=_cut(out))
    return out


def _across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over the rows of ``x`` and ``y`` of their products."""
    return (_cut(x).transpose(0, 2, 1) @ _cut(y)).sum(axis=0)


def _looked_up(table: np.ndarray, index: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(table, index, axis=0, out=out, mode="clip")


def _turned(x: np.ndarray, room: Room) -> np.ndarray:
    out = room("turned", len(x), WIDTH, LENGTH)
    np.copyto(out, x.transpose(0, 2, 1))
    return out


def _within(x: np.ndarray, limit: float) -> bool:
    return max(x.max(), -x.min()) < limit


class Forward:
    """What depends on a slot alone, and the steps of the forward pass for a block of windows."""

    def __init__(self, params: Params, room: Room) -> None:
        self.room = room
        # From the embedding to the query, the key and the value.
        parts = params["query"] * np.float32(1 / np.sqrt(WIDTH)), params["key"], params["value"]
        self.embed, self.project = params["embed"], np.hstack(parts)
        self.tables = [self.embed @ x for x in parts]
        self.offset = (params["bias"][_DISTANCE] + _MASK).astype(np.float32)
        self.plain = _within(params["bias"], CLOSE)
        if self.plain:
            self.factor = np.exp(self.offset)
        self.mix, self.mix_bias = params["mix"], np.empty((BLOCK * LENGTH, HIDDEN), np.float32)
        self.mix_bias[:] = params["mix_bias"]
        self.out = np.hstack([params["high"], params["low"]])
        self.biases = np.empty((SIDE, 2 * SIDE), np.float32)
        self.biases[:, :SIDE], self.biases[:, SIDE:] = params["high_bias"], params["low_bias"]
        # No entry of the hidden layer is above one.
        self.bounded = np.abs(self.out).sum(axis=0).max() + np.abs(self.biases).max() < NEAR

    def attend(self, inputs: np.ndarray, first: int = 0) -> tuple[np.ndarray, ...]:
        """Queries from the first place on, keys, values, attention, its sums (as wide as a value), what is seen."""
        room, m = self.room, len(inputs)
        query, key, value = self.tables
        q = _looked_up(query, inputs[:, first:], room("q", m, LENGTH - first, WIDTH))
        k, v = (_looked_up(t, inputs, room(x, m, LENGTH, WIDTH)) for x, t in (("k", key), ("v", value)))
        att = np.matmul(q, _turned(k, room), out=room("att", m, LENGTH - first, LENGTH))
        if self.plain and _within(att, CLOSE):
            np.exp(att, out=att)
            att *= self.factor[first:]
        else:
            att += self.offset[first:]
            att -= att.max(axis=-1, keepdims=True)
            np.exp(att, out=att)
        seen = np.matmul(att, v, out=room("seen", *q.shape)).reshape(-1, WIDTH)
        total = _times(att.reshape(-1, LENGTH), _ONES, room("total", *seen.shape))
        seen /= total
        return q, k, v, att, total, seen

    def choices(self, inputs: np.ndarray, seen: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """The embedding, it and what is seen, the hidden layer, logits of both classes (the second given the first)."""
        room, n = self.room, len(seen)
        e = _looked_up(self.embed, inputs, room("e", *inputs.shape, WIDTH)).reshape(-1, WIDTH)
        c = np.add(seen, e, out=room("c", n, WIDTH))
        h = _times(c, self.mix, room("h", n, HIDDEN))
        h += self.mix_bias[:n]
        np.tanh(h, out=h)
        z = _times(h, self.out, room("z", n, 2 * SIDE))
        z += _looked_up(self.biases, high, room("biases", n, 2 * SIDE))
        if not (self.bounded or _within(z, NEAR)):
            halves = z.reshape(-1, 2, SIDE)
            halves -= halves.max(axis=2, keepdims=True)
        return e, c, h, z


def slopes(
    params: Params, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, room: Room | None = None
) -> Params:
    """Gradient of the mean negative log-probability of the targets.

    Windows are taken in blocks whose arrays stay in the cache; a block adds to the sums.
    """
    w, room = WIDTH, room or Room()
    f = Forward(params, room)
    share = (weight / max(weight.sum(), 1)).astype(np.float32)
    back_of_out, back_of_mix = np.ascontiguousarray(f.out.T), np.ascontiguousarray(f.mix.T)
    back_of_project, pairs = np.ascontiguousarray(f.project.T), np.arange(w // 2)
    ones = np.ones(BLOCK * LENGTH, np.float32)
    g = {name: np.zeros(shape, np.float32) for name, shape in SHAPES.items()}
    of_out, of_project, of_distance = np.zeros_like(f.out), np.zeros_like(f.project), np.zeros_like(f.offset)
    for at in range(0, len(inputs), BLOCK):
        given, goal = inputs[at : at + BLOCK], targets[at : at + BLOCK].ravel()
        high, m, n = goal // SIDE, len(given), len(goal)
        q, k, v, att, total, seen = f.attend(given)
        e, c, h, dz = f.choices(given, seen, high)
        np.exp(dz, out=dz)
        weights = share[at : at + BLOCK].reshape(-1, 1)
        dz *= np.matmul(weights / (dz @ _HALVES), _BOTH, out=room("biases", n, 2 * SIDE))
        # A goal is 32 * high + low, and a row of the logits has 64 places.
        first, flat_dz = np.arange(0, n * 2 * SIDE, 2 * SIDE), dz.ravel()
        flat_dz[first + high] -= weights[:, 0]
        flat_dz[first + (SIDE + goal - SIDE * high)] -= weights[:, 0]
        of_out += _across(h, dz)
        g["high_bias"] += ones[:n] @ dz[:, :SIDE]
        g["low_bias"] += _across(_looked_up(_EYE, high, room("eye", n, SIDE)), dz[:, SIDE:])
        du = _times(dz, back_of_out, room("du", n, HIDDEN))
        h *= h
        h *= du
        du -= h
        g["mix"] += _across(c, du)
        g["mix_bias"] += ones[:n] @ du
        de = _times(du, back_of_mix, room("de", n, w))
        # The attention has not been divided by its sums; its slopes are.
        ds = np.divide(de, total, out=total)
        dot = np.multiply(ds, seen, out=seen) @ ones[:w]
        ds = ds.reshape(m, LENGTH, w)
        da = np.matmul(ds, _turned(v, room), out=room("da", m, LENGTH, LENGTH))
        da -= dot.reshape(m, LENGTH, 1)
        da *= att
        of_distance += da.sum(axis=0)
        back = room("back", m, LENGTH, 3 * w)
        np.matmul(da, k, out=back[..., :w])
        np.matmul(da.transpose(0, 2, 1), q, out=back[..., w : 2 * w])
        np.matmul(att.transpose(0, 2, 1), ds, out=back[..., 2 * w :])
        back = back.reshape(-1, 3 * w)
        of_project += _across(e, back)
        de += _times(back, back_of_project, room("more", n, w))
        # Pairs of entries are added at once, as if they were complex.
        places = (given.reshape(-1, 1) * (w // 2) + pairs).ravel()
        np.add.at(g["embed"].ravel().view(np.complex64), places, de.ravel().view(np.complex64))
    g["high"], g["low"] = of_out[:, :SIDE], of_out[:, SIDE:]
    g["query"] = of_project[:, :w] / np.float32(np.sqrt(w))
    g["key"], g["value"] = of_project[:, w : 2 * w], of_project[:, 2 * w :]
    g["bias"] = np.bincount(_DISTANCE.ravel(), of_distance.ravel(), LENGTH).astype(np.float32)
    return g


class Descent:
    """Adam over a stream of windows of ``LENGTH + 1`` slots, in steps of ``batch`` windows.

    How the stream is cut in calls of ``feed`` makes no difference.
    """

    def __init__(self, params: Params, rate: float, batch: int = 128) -> None:
        self.flat = flat(params)
        self.params = views(self.flat)
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rate, self.batch, self.step, self.room = rate, batch, 0, Room()
        self.windows = np.zeros((0, LENGTH + 1), np.int64)
        self.weight = np.zeros((0, LENGTH), np.float32)

    def feed(self, windows: np.ndarray, weight: np.ndarray) -> None:
        self.windows, self.weight = np.concatenate([self.windows, windows]), np.concatenate([self.weight, weight])
        whole = len(self.windows) // self.batch * self.batch
        for at in range(0, whole, self.batch):
            self._move(self.windows[at : at + self.batch], self.weight[at : at + self.batch])
        self.windows, self.weight = self.windows[whole:], self.weight[whole:]

    def end(self) -> Params:
        if len(self.windows):
            self._move(self.windows, self.weight)
        return self.params

    def _move(self, windows: np.ndarray, weight: np.ndarray) -> None:
        self.step += 1
        value = flat(slopes(self.params, windows[:, :-1], windows[:, 1:], weight, self.room))
        self.first += 0.1 * (value - self.first)
        self.second += 0.01 * (value * value - self.second)
        mean, var = self.first / (1 - 0.9**self.step), self.second / (1 - 0.99**self.step)
        self.flat -= self.rate * mean / (np.sqrt(var) + 1e-6)


def descend(params: Params, windows: np.ndarray, weight: np.ndarray, rate: float, batch: int = 128) -> Params:
    """One pass of Adam over windows of ``LENGTH + 1`` slots."""
    descent = Descent(params, rate, batch)
    descent.feed(windows, weight)
    return descent.end()


class Scorer:
    """Log-probabilities of windows; what depends on a slot alone is looked up."""

    def __init__(self, params: Params) -> None:
        self.forward = Forward(params, Room())

    def score(self, inputs: np.ndarray, targets: np.ndarray, first: int = 0) -> np.ndarray:
        """Logarithm of the probability of each target from the first place on, given the slots up to its input."""
        out = np.empty((len(inputs), LENGTH - first), np.float32)
        for at in range(0, len(inputs), BLOCK):
            out[at : at + BLOCK] = self._score(inputs[at : at + BLOCK], targets[at : at + BLOCK, first:], first)
        return out

    def _score(self, inputs: np.ndarray, targets: np.ndarray, first: int) -> np.ndarray:
        goal = targets.ravel()
        high, low, n = goal // SIDE, goal % SIDE, np.arange(len(goal))
        z = self.forward.choices(inputs[:, first:], self.forward.attend(inputs, first)[-1], high)[-1]
        hit = z[n, high] + z[n, SIDE + low]
        np.exp(z, out=z)
        return (hit - np.log(z @ _HALVES).sum(axis=1)).reshape(targets.shape)
