"""A character tagger in numpy: bidirectional LSTM emissions, CRF transitions, trained from labelled windows."""

from __future__ import annotations

import numpy as np

#: Character classes: 0 padding, 1 other, 2 other letter, then printable ASCII by code point.
N_CHARS = 3 + 95


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = np.where((code >= 32) & (code < 127), code - 29, 1).astype(np.uint8)
    high = np.flatnonzero(code >= 128)
    if len(high):
        kinds, at = np.unique(code[high], return_inverse=True)
        out[high] = np.array([2 if chr(c).isalpha() else 1 for c in kinds], np.uint8)[at]
    return out


#: tanh(x) is about the sum of r x / (x^2 + p) over _POLES for |x| <= _REACH, within 2e-5 everywhere; fitted to the greatest error.
_REACH = np.float32(6.5)
_POLES = tuple((np.float32(p), np.float32(r)) for p, r in ((2.471134721091662, 2.0063811868867076), (25.85019088542205, 2.9112161024193743), (304.9471640898013, 22.995059935182123)))


def fast_tanh(x: np.ndarray, square: np.ndarray, part: np.ndarray, total: np.ndarray) -> np.ndarray:
    """tanh of float32 numbers in place, with three more arrays of the shape for work; numpy's own takes twice as long without AVX-512."""
    np.clip(x, -_REACH, _REACH, out=x)
    np.multiply(x, x, out=square)
    for k, (p, r) in enumerate(_POLES):
        np.add(square, p, out=part)
        np.divide(r, part, out=part if k else total)
        if k:
            total += part
    x *= total
    return x


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Gates are written as tanh of half their input, so that one tanh serves all four parts of a cell."""

    def __init__(self, n_tags: int, embed: int = 8, hidden: int = 10, seed: int = 7):
        g = np.random.default_rng(seed)
        w = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h = hidden
        self.h, self.k = h, n_tags
        self.p = {"E": w(N_CHARS, embed), "O": w(2 * h, n_tags), "o": np.zeros(n_tags, np.float32), "T": np.zeros((n_tags, n_tags), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # the forget gate starts open
            self.p |= {f"X{d}": w(embed, 4 * h), f"H{d}": w(h, 4 * h), f"c{d}": bias}

    def _run(self, d: str, ids: np.ndarray):
        """For training; ids: (steps, batch); (steps, batch, hidden), in the order of ids, and what backward needs, in the direction's."""
        h = self.h
        half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])
        table = (self.p["E"] @ self.p[f"X{d}"] + self.p[f"c{d}"]) * half  # what each character class brings to a cell
        turn = self.p[f"H{d}"] * half
        state = np.zeros((ids.shape[1], h), np.float32)
        cell = np.zeros_like(state)
        out, cache = np.empty((*ids.shape, h), np.float32), []
        into = np.empty((ids.shape[1], 4 * h), np.float32)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            z = np.empty_like(into)
            np.take(table, ids[t], axis=0, out=z, mode="clip")
            np.matmul(state, turn, out=into)
            z += into
            np.tanh(z, out=z)
            gates = z[:, : 3 * h]
            gates *= 0.5
            gates += 0.5
            before, prior = cell, state
            cell = z[:, h : 2 * h] * cell
            cell += z[:, :h] * z[:, 3 * h :]
            th = np.tanh(cell)
            state = np.multiply(z[:, 2 * h : 3 * h], th, out=out[t])
            cache.append((gates, z[:, 3 * h :], before, prior, th))
        return out, cache

    def _states(self, d: str, ids: np.ndarray, out: np.ndarray) -> None:
        """Fill out (steps, hidden, batch) with the states of _run(), nothing kept: a cell's parts are rows, so that every pass runs over whole rows."""
        h, (steps, batch), width = self.h, ids.shape, self.p["E"].shape[1]
        half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])[:, None]
        gates = np.concatenate([self.p[f"H{d}"].T, self.p[f"X{d}"].T, self.p[f"c{d}"][:, None]], axis=1) * half
        chars = np.ascontiguousarray(self.p["E"].T)
        given = np.ones((h + width + 1, batch), np.float32)  # the state before, the character's embedding, and 1
        given[:h] = 0
        cell, th, product = np.zeros((3, h, batch), np.float32)
        z, *work = np.empty((4, 4 * h, batch), np.float32)
        few = [x[:h] for x in work]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(chars, ids[t], axis=1, out=given[h:-1], mode="clip")
            np.matmul(gates, given, out=z)
            fast_tanh(z, *work)
            z[: 3 * h] *= np.float32(0.5)
            z[: 3 * h] += np.float32(0.5)
            cell *= z[h : 2 * h]
            cell += np.multiply(z[:h], z[3 * h :], out=product)
            th[:] = cell
            given[:h] = np.multiply(z[2 * h : 3 * h], fast_tanh(th, *few), out=out[t])

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: (batch, steps) -> (steps, batch, tags)."""
        h, (batch, steps) = self.h, ids.shape
        x, states = np.ascontiguousarray(ids.T), np.empty((steps, 2 * h + 1, batch), np.float32)
        states[:, -1] = 1
        self._states("f", x, states[:, :h])
        self._states("b", x, states[:, h:-1])
        tags, out = np.concatenate([self.p["O"], self.p["o"][None]]), np.empty((batch, steps, self.k), np.float32)
        for t in range(0, steps, 16):  # few steps at once, as the batch comes first in out
            out[:, t : t + 16] = (states[t : t + 16].transpose(0, 2, 1) @ tags).transpose(1, 0, 2)
        return out.transpose(1, 0, 2)

    def _back(self, d: str, ids: np.ndarray, cache, up: np.ndarray, grad: dict) -> None:
        h = self.h
        x = self.p["E"][ids]
        dz = np.empty((*ids.shape, 4 * h), np.float32)
        ds = np.zeros((ids.shape[1], h), np.float32)
        dc = np.zeros_like(ds)
        hw = np.zeros_like(self.p[f"H{d}"])
        for t in range(len(ids) - 1, -1, -1):
            ifo, g, before, prior, th = cache[t]
            i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h : 3 * h]
            s = up[t] + ds
            c = dc + s * o * (1 - th * th)
            z = dz[t]
            z[:, :h] = c * g * i * (1 - i)
            z[:, h : 2 * h] = c * before * f * (1 - f)
            z[:, 2 * h : 3 * h] = s * th * o * (1 - o)
            z[:, 3 * h :] = c * i * (1 - g * g)
            hw += prior.T @ z
            ds, dc = z @ self.p[f"H{d}"].T, c * f
        grad[f"H{d}"] = hw
        grad[f"X{d}"] = np.tensordot(x, dz, axes=([0, 1], [0, 1]))
        grad[f"c{d}"] = dz.sum(axis=(0, 1))
        np.add.at(grad["E"], ids, dz @ self.p[f"X{d}"].T)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        n, steps = ids.shape
        x = np.ascontiguousarray(ids.T)
        (f, cf), (b_, cb) = self._run("f", x), self._run("b", x)
        e = f.reshape(-1, self.h) @ self.p["O"][: self.h]
        e += b_.reshape(-1, self.h) @ self.p["O"][self.h :]
        e += self.p["o"]
        e = e.reshape(*x.shape, self.k).transpose(1, 0, 2)
        tr = self.p["T"]
        a = np.empty_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, steps):
            a[:, t] = e[:, t] + _logsum(a[:, t - 1, :, None] + tr, 1)
        z = _logsum(a[:, -1], 1)
        b = np.zeros_like(e)
        pair = np.zeros_like(tr)
        for t in range(steps - 2, -1, -1):
            nxt = (e[:, t + 1] + b[:, t + 1])[:, None, :] + tr
            pair += np.exp(a[:, t, :, None] + nxt - z[:, None, None]).sum(axis=0)
            b[:, t] = _logsum(nxt, 2)
        rows, cols = np.arange(n)[:, None], np.arange(steps)
        score = e[rows, cols, tags].sum(axis=1) + tr[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        de = np.exp(a + b - z[:, None, None])
        de[rows, cols, tags] -= 1
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grad = {"T": pair / n, "E": np.zeros_like(self.p["E"])}
        de = (de / n).transpose(1, 0, 2)
        both = np.concatenate([f, b_], axis=2)
        grad["O"] = np.tensordot(both, de, axes=([0, 1], [0, 1]))
        grad["o"] = de.sum(axis=(0, 1))
        up = de @ self.p["O"].T
        self._back("f", x, cf, up[:, :, : self.h], grad)
        self._back("b", x[::-1], cb, up[::-1, :, self.h :], grad)
        return float((z - score).mean()), grad

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> list[float]:
        """Adam over shuffled batches, its rate falling to a tenth; the mean loss of each epoch."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t, losses, steps = 0, [], max(1, epochs * -(-len(ids) // batch))
        for _ in range(epochs):
            order, total = g.permutation(len(ids)), []
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                loss, grad = self.loss(ids[at], tags[at])
                total.append(loss)
                pace = rate * 0.1 ** (t / steps)
                t += 1
                for k, x in grad.items():
                    x = np.clip(x, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)) if total else 0.0)
        return losses

    def bonus(self) -> tuple[float, float]:
        """What a path's transitions gain at most over staying in tag 0: for each step outside it, and once.

        Potentials of the tags, which cancel along any path from tag 0 back to it, take the gain of entering a tag
        from the step that pays for it.
        """
        t = (self.p["T"] - self.p["T"][0, 0]).astype(float)
        step = max(float(np.diag(t)[1:].max()), 0.0)
        for _ in range(60):  # least step for which no cycle beside tag 0 gains anything
            far = t[0].copy()
            for _ in range(self.k):
                far[1:] = np.maximum(far[1:], (far[1:, None] + t[1:, 1:] - step).max(axis=0))
            if (far[1:] >= (far[1:, None] + t[1:, 1:] - step).max(axis=0) - 1e-9).all():
                break
            step = step * 1.1 + 0.1
        return step, float(max(0.0, (far[1:] + t[1:, 0]).max()))

    def doubtful(self, e: np.ndarray) -> np.ndarray:
        """Where a best path may leave tag 0, for emissions (steps, tags): elsewhere none does.

        A path outside tag 0 over some steps gains at most the sum of its emissions' advantages and `step` each, and
        `once`. The greatest such sums that end, or begin, at a place are running maxima of prefix sums.
        """
        step, once = self.bonus()
        best = e[:, 1].copy()
        for k in range(2, self.k):
            np.maximum(best, e[:, k], out=best)
        gain = (best - e[:, 0]).astype(float) + step
        if not (gain > -once).any():
            return np.zeros(len(e), dtype=bool)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        left = total[1:] - np.minimum.accumulate(total[:-1])
        right = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
        return left + right - gain + once > 0

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence of emissions (steps, tags)."""
        score, back = e[0], np.empty(e.shape, np.int64)
        for t in range(1, len(e)):
            all_ = score[:, None] + self.p["T"]
            back[t] = all_.argmax(axis=0)
            score = all_.max(axis=0) + e[t]
        out = np.empty(len(e), np.int64)
        out[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out
