"""A gated recurrent language model in numpy with a class-factored output softmax.

Symbols are ``words`` frequent words in classes of CLASS, and ``others`` that are classes by themselves.
"""

from __future__ import annotations

import math

import numpy as np

CLASS = 64
#: Classes with at most so many rows (and more than the bound before) are handled together in a training step.
FEW = (4, 8, 16, 32)
#: Rows of a softmax that fit the processor's cache; states that are scored together.
ROWS, BLOCK = 1024, 1 << 15
#: Texts whose states move on together in the processor's cache.
BESIDE = 512
#: Logits within these bounds need no shift before exp; rows of a symbol that are added one by one; weights that move together.
SAFE, RUN, PART = 80, 8, 1 << 14
f32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tame(logits: np.ndarray) -> None:
    """Logits that exp could not take are moved by their row's greatest, which leaves shares as they are."""
    if not (logits.min() > -SAFE and logits.max() < SAFE):
        logits -= logits.max(1, keepdims=True)


def _log_share(logits: np.ndarray, bias: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The log softmax of each row at its pick; logits are used up."""
    logits += bias
    _tame(logits)
    own = logits.reshape(-1).take(np.arange(0, logits.size, logits.shape[1]) + pick)
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _order(number: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers, which are below the bound; short numbers are put in order without comparisons."""
    return np.argsort(number.astype(np.int16) if below < 1 << 15 else number, kind="stable")


class Gru:
    """h' = (1 - z) h + z tanh(x_h + (r h) U_h), with x looked up by symbol; p(w) = p(class | h) p(w | class, h)."""

    NAMES = ("x", "u", "uh", "wc", "bc", "wo", "bo")

    def __init__(self, counts: np.ndarray, words: int, hidden: int = 32, seed: int = 5):
        """counts: of each symbol, words first; the biases begin as their unigram model."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.words, self.hidden, self.symbols = words, hidden, len(counts)
        classes = -(-words // CLASS)
        others = len(counts) - words
        self.classes = classes + others
        self.kind = np.concatenate((np.arange(words) // CLASS, classes + np.arange(others)))
        mass = counts.astype(np.float64) + 1
        total = np.bincount(self.kind, weights=mass, minlength=self.classes)
        padded = np.full(classes * CLASS, 1e-9)
        padded[:words] = mass[:words]
        self.x = rng.normal(0, 0.3, (len(counts), 3 * hidden)).astype(f32)
        self.u = rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, 2 * hidden)).astype(f32)
        self.uh = rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, hidden)).astype(f32)
        self.wc, self.bc = np.zeros((hidden, self.classes), f32), np.log(total / total.sum()).astype(f32)
        self.wo = np.zeros((classes, hidden, CLASS), f32)
        self.bo = np.log(padded.reshape(-1, CLASS) / padded.reshape(-1, CLASS).sum(1, keepdims=True)).astype(f32) if classes else np.zeros((0, CLASS), f32)

    def pack(self) -> bytes:
        return b"".join(getattr(self, k).tobytes() for k in self.NAMES)

    def unpack(self, blob: bytes) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, np.frombuffer(blob, f32, old.size, at).reshape(old.shape).copy())
            at += old.nbytes

    def step(self, symbol: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = self.hidden
        a = self.x[symbol]
        g = _sigmoid(a[:, : 2 * n] + h @ self.u)
        z = g[:, n:]
        c = np.tanh(a[:, 2 * n :] + (g[:, :n] * h) @ self.uh)
        return h + z * (c - h)

    def log_p(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target after its state."""
        kind = self.kind.take(target)
        order = _order(kind, self.classes)
        s, t, kind = states.take(order, axis=0), target.take(order), kind.take(order)
        p = np.empty(len(t), np.float64)
        for lo in range(0, len(t), ROWS):
            part = slice(lo, lo + ROWS)
            p[part] = _log_share(s[part] @ self.wc, self.bc, kind[part])
        edge = np.searchsorted(kind, np.arange(len(self.wo) + 1))
        for c in range(len(self.wo)):
            for lo in range(edge[c], edge[c + 1], ROWS):
                part = slice(lo, min(lo + ROWS, edge[c + 1]))
                p[part] += _log_share(s[part] @ self.wo[c], self.bo[c], t[part] - c * CLASS)
        out = np.empty(len(t), np.float64)
        out[order] = p
        return out

    def score(self, texts: list[np.ndarray], end: int) -> list[np.ndarray]:
        """ln p of every symbol of each text (which end with ``end``).

        Each text is one sequence from first to last symbol; texts run side by side, the longest first, and their symbols are
        laid out step by step.  States are kept only until BLOCK of them are there, so the memory grows with the symbols, not
        with the states.
        """
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        start = np.concatenate(([0], np.cumsum(sizes)))
        longest = int(sizes[0]) if len(sizes) else 0
        lives = np.searchsorted(-sizes, -np.arange(longest))
        base = np.concatenate(([0], np.cumsum(lives)))
        place = base.take(np.arange(start[-1]) - np.repeat(start[:-1], sizes)) + np.repeat(np.arange(len(sizes)), sizes)
        flat = np.empty(len(place), np.int64)
        for k, i in enumerate(order):
            flat[place[start[k] : start[k + 1]]] = texts[i]
        p = np.empty(len(flat), np.float64)
        table, u = self.by_gate()
        gates = self.symbols * np.arange(3)[:, None]
        states = np.empty((BLOCK + len(texts), self.hidden), f32)
        h, seen, done = np.zeros((len(texts), self.hidden), f32), np.full(len(texts), end), 0
        for t in range(longest):
            live, at = lives[t], base[t]
            new = states[at - done : at - done + live]
            for lo in range(0, live, BESIDE):
                part = slice(lo, min(lo + BESIDE, live))
                a = table.take(gates + seen[part], axis=0)
                old, g, c = h[part], a[:2], a[2]
                g += old @ u[:2]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c += (g[0] * old) @ u[2]
                np.tanh(c, out=c)
                c -= old
                c *= g[1]
                np.add(old, c, out=new[part])
            h, seen = new, flat[at : at + live]
            if at + live - done >= BLOCK or t == longest - 1:
                p[done : at + live] = self.log_p(states[: at + live - done], flat[done : at + live])
                h, done = h.copy(), at + live
        p = p.take(place)
        out: list = [None] * len(texts)
        for k, i in enumerate(order):
            out[i] = p[start[k] : start[k + 1]]
        return out

    def by_gate(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the square matrices by gate (reset, update, new state); the gates' are negative, as 1 / (1 + exp(-x)) asks."""
        n = self.hidden
        table = np.concatenate([-self.x[:, :n], -self.x[:, n : 2 * n], self.x[:, 2 * n :]])
        return table, np.stack([-self.u[:, :n], -self.u[:, n:], self.uh])


def _shares(e: np.ndarray, places: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The softmax of logits at flat places, one a row; logits become the gradient of -ln of it, times the row's share."""
    if not len(e):
        return np.zeros(0, f32)
    _tame(e)
    np.exp(e, out=e)
    scale = 1 / (e @ np.ones(e.shape[1], f32))
    flat = e.reshape(-1)
    p = flat[places] * scale
    scale *= share
    e *= scale[:, None]
    flat[places] -= share
    return p


def _sums(values: np.ndarray, at: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of at, and the sums (kind, number, n) of the values (kind, row, n) at each."""
    order = _order(at, below)
    ordered = at.take(order)
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    many = np.diff(np.append(start, len(at)))
    by = np.argsort(-many, kind="stable")
    start, many = start.take(by), many.take(by)
    sums = values.take(order.take(start), axis=1)
    upto = np.searchsorted(-many, -np.arange(RUN + 1))  # numbers that are met more often
    for j in range(1, RUN):
        k = upto[j]
        if k > upto[RUN]:
            sums[:, upto[RUN] : k] += values.take(order.take(start[upto[RUN] : k] + j), axis=1)
    k = upto[RUN]
    if k:  # the most frequent ones by a product with ones and zeros
        of = np.repeat(np.arange(k), many[:k])
        place = np.arange(len(of)) + np.repeat(start[:k] - np.cumsum(many[:k]) + many[:k], many[:k])
        ones = np.zeros((k, len(of)), f32)
        ones[of, np.arange(len(of))] = 1
        sums[:, :k] = ones @ values.take(order.take(place), axis=1)
    return ordered.take(start), sums


def train(model: Gru, stream: np.ndarray, fresh: np.ndarray, end: int, *, lanes: int = 64, window: int = 16, rate: float = 0.01) -> float:
    """Truncated backpropagation through windows of a stream of symbols; state goes on from window to window, and is cleared where fresh.

    The stream is cut into lanes that run side by side; the last ones are filled up with ends that count nothing, so every
    symbol is learned.  Steps are Adam's; rows of x move when their symbol is met.  Returns the mean ln p of the symbols as they were met.
    """
    size = -(-len(stream) // lanes)
    if size < 1:
        return 0.0
    fill = lanes * size - len(stream)
    y = np.append(stream, np.full(fill, end, stream.dtype)).reshape(lanes, size).T
    new = np.append(fresh, np.ones(fill, bool)).reshape(lanes, size).T
    counts = (np.arange(lanes * size) < len(stream)).reshape(lanes, size).T
    x = np.empty_like(y)
    x[1:], x[0] = y[:-1], end
    x = np.where(new, end, x)
    fresh_at = new.any(1)
    n, symbols, classes = model.hidden, model.symbols, len(model.wo)
    # weights and gradients are one array each, so a step is a few passes in place; a bias is its matrix's last row, which meets ones
    shapes = {"u": (3, n, n), "wc": (n + 1, model.classes), "wo": (classes, n + 1, CLASS)}
    edges = np.cumsum([0] + [math.prod(v) for v in shapes.values()])
    weights, grad_all = np.empty(edges[-1], f32), np.zeros(edges[-1], f32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    (u, wc, wo), (grad_u, grad_wc, grad_wo) = ([v[a:b].reshape(s) for a, b, s in zip(edges, edges[1:], shapes.values())] for v in (weights, grad_all))
    table, u[:] = model.by_gate()
    wc[:n], wc[n], wo[:, :n], wo[:, n] = model.wc, model.bc, model.wo, model.bo
    x_first, x_second = np.zeros_like(table), np.zeros_like(table)
    gates = symbols * np.arange(3)[:, None]
    parts = [slice(lo, lo + PART) for lo in range(0, len(weights), PART)]
    parts = [(weights[p], grad_all[p], first[p], second[p], np.empty(len(weights[p]), f32)) for p in parts]
    h = np.zeros((lanes, n), f32)
    total, seen, step = 0.0, 0, 0
    for lo in range(0, size, window):
        xs, ys, fs = x[lo : lo + window].ravel(), y[lo : lo + window].ravel(), new[lo : lo + window]
        real_rows = counts[lo : lo + window].ravel().astype(f32)
        share = real_rows / f32(lanes)
        steps = len(fs)
        a = table.take((gates + xs).ravel(), axis=0).reshape(3, steps, lanes, n)
        g, c, hs, before, gated = a[:2], a[2], np.ones((steps, lanes, n + 1), f32), np.empty((steps, lanes, n), f32), np.empty((steps, lanes, n), f32)
        ug = np.empty((2, lanes, n), f32)
        uc, move = np.empty((lanes, n), f32), np.empty((lanes, n), f32)
        for t in range(steps):
            if fresh_at[lo + t]:
                h = np.where(fs[t][:, None], f32(0), h)
            before[t] = h
            gt, ct, rh = g[:, t], c[t], gated[t]
            np.matmul(h, u[:2], out=ug)
            gt += ug
            np.exp(gt, out=gt)
            gt += 1
            np.reciprocal(gt, out=gt)
            np.multiply(gt[0], h, out=rh)
            np.matmul(rh, u[2], out=uc)
            ct += uc
            np.tanh(ct, out=ct)
            np.subtract(ct, h, out=move)
            move *= gt[1]
            h = h + move
            hs[t, :, :n] = h
        # rows in the order of their classes
        kind = model.kind.take(ys)
        order = _order(kind, model.classes)
        s, target, kind, part, real = hs.reshape(-1, n + 1).take(order, axis=0), ys.take(order), kind.take(order), share.take(order), real_rows.take(order)
        p = s @ wc
        got = _shares(p, np.arange(len(kind)) * model.classes + kind, part)
        total += float(np.log(np.maximum(got, 1e-30)) @ real)
        np.matmul(s.T, p, out=grad_wc)
        ds = p @ wc[:n].T
        edge = np.searchsorted(kind, np.arange(classes + 1))
        many = np.diff(edge)
        # within classes: each has so many rows beside its first as its group; what is beyond a class's rows counts nothing
        groups, at = [], 0
        for below, most in zip((0, *FEW), FEW):
            few = np.flatnonzero((many > below) & (many <= most))
            if len(few):
                groups.append((few, most, at))
                at += len(few) * most
        for k in np.flatnonzero(many > FEW[-1]):
            groups.append((slice(k, k + 1), int(many[k]), at))
            at += int(many[k])
        inner = np.empty((at, CLASS), f32)
        if groups:
            rows = np.concatenate([(edge[:-1][k][:, None] + np.arange(most)).ravel() for k, most, _ in groups])
            place = np.concatenate([np.repeat(edge[1:][k], most) for k, most, _ in groups])
            counted = rows < place
            rows = np.minimum(rows, len(kind) - 1)
            inputs = s.take(rows, axis=0)
            pick = np.where(counted, target.take(rows) - kind.take(rows) * CLASS, 0)
            held = []
            for k, most, lo_row in groups:
                w = wo[k]
                hi_row = lo_row + len(w) * most
                held.append((k, w, inputs[lo_row:hi_row].reshape(len(w), most, n + 1), lo_row, hi_row))
                np.matmul(held[-1][2], w, out=inner[lo_row:hi_row].reshape(len(w), most, CLASS))
            got = _shares(inner, np.arange(at) * CLASS + pick, np.where(counted, part.take(rows), f32(0)))
            total += float(np.log(np.maximum(got, 1e-30)) @ np.where(counted, real.take(rows), f32(0)))
            more = np.empty((at, n), f32)
            for k, w, some, lo_row, hi_row in held:
                q = inner[lo_row:hi_row].reshape(len(w), -1, CLASS)
                if isinstance(k, slice):
                    np.matmul(some.transpose(0, 2, 1), q, out=grad_wo[k])
                else:
                    grad_wo[k] = some.transpose(0, 2, 1) @ q
                np.matmul(q, w[:, :n].transpose(0, 2, 1), out=more[lo_row:hi_row].reshape(len(w), -1, n))
            found = np.empty(edge[-1], np.int64)
            found[rows[counted]] = np.flatnonzero(counted)
            ds[: edge[-1]] += more.take(found, axis=0)
        grad_wo[many == 0] = 0
        back = np.empty((steps, lanes, n), f32)
        back.reshape(-1, n)[order] = ds
        r, z = g
        da = np.empty((3, steps, lanes, n), f32)
        stay = 1 - z
        np.subtract(before, c, out=da[1])
        da[1] *= z
        da[1] *= stay
        np.multiply(c, c, out=da[2])
        np.subtract(1, da[2], out=da[2])
        da[2] *= z
        np.multiply(gated, r - 1, out=da[0])
        u_turned, uh_turned = np.ascontiguousarray(u[:2].transpose(0, 2, 1)), np.ascontiguousarray(u[2].T)
        dh, drh = np.zeros((lanes, n), f32), np.empty((lanes, n), f32)
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            d = da[:, t]
            d[1:] *= dh
            np.matmul(d[2], uh_turned, out=drh)
            d[0] *= drh
            dh *= stay[t]
            drh *= r[t]
            dh += drh
            np.matmul(d[:2], u_turned, out=ug)
            dh += ug[0]
            dh += ug[1]
            if fresh_at[lo + t]:
                dh *= ~fs[t][:, None]
        flat = da.reshape(3, -1, n)
        np.matmul(before.reshape(-1, n).T, flat[:2], out=grad_u[:2])
        np.matmul(gated.reshape(-1, n).T, flat[2], out=grad_u[2])
        met, grad_x = _sums(flat, xs, symbols)
        rows = (gates + met).ravel()
        grad_x = grad_x.reshape(-1, n)
        norm = math.sqrt(float(grad_all @ grad_all) + float(grad_x.ravel() @ grad_x.ravel()))
        step += 1
        if norm > 5:
            grad_all *= f32(5 / norm)
            grad_x *= f32(5 / norm)
        # moments are kept as sums, ten and a hundred times the means
        even = math.sqrt(0.01 / (1 - 0.99**step))
        slow, least = f32(0.1 * rate / (1 - 0.9**step) / even), f32(1e-6 / even)
        moved, old, old2 = table.take(rows, axis=0), x_first.take(rows, axis=0), x_second.take(rows, axis=0)
        for w, d, m, v, room in (*parts, (moved, grad_x, old, old2, np.empty_like(grad_x))):
            m *= f32(0.9)
            m += d
            v *= f32(0.99)
            np.multiply(d, d, out=room)
            v += room
            np.sqrt(v, out=room)
            room += least
            np.divide(m, room, out=room)
            room *= slow
            w -= room
        table[rows], x_first[rows], x_second[rows] = moved, old, old2
        seen += int(real_rows.sum())
    table[: 2 * symbols] *= -1
    model.x = np.concatenate(np.split(table, 3), axis=1)
    model.u, model.uh = -np.concatenate((u[0], u[1]), axis=1), u[2].copy()
    model.wc, model.bc, model.wo, model.bo = wc[:n].copy(), wc[n].copy(), wo[:, :n].copy(), wo[:, n].copy()
    return total / max(1, seen)
