"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols: padding, printable ASCII one by one, other letters, anything else.
ALPHABET = 98


def symbols(text: str, length: int) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for k, c in enumerate(text[:length]):
        o = ord(c)
        out[k] = o - 31 if 32 <= o < 127 else 96 if c.isalpha() else 97
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Windows of fixed length in, a tag for every place out. Arrays are (place, window, ...)."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 20, seed: int = 0):
        r = np.random.default_rng(seed)
        shape = {"E": (ALPHABET, embed), "O": (2 * hidden, tags), "c": (tags,), "A": (tags, tags)}
        for d in "fb":
            shape |= {f"X{d}": (embed, 4 * hidden), f"H{d}": (hidden, 4 * hidden), f"B{d}": (4 * hidden,)}
        self.p = {k: (r.normal(size=s) * 0.15 if len(s) > 1 and k != "A" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        for d in "fb":
            self.p[f"B{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.hidden = hidden

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        p, n = self.p, self.hidden
        pre = x @ p[f"X{d}"] + p[f"B{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, trail = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ p[f"H{d}"]
            i, f, o, g = sigmoid(z[:, :n]), sigmoid(z[:, n : 2 * n]), sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = out[t] = o * tc
            trail.append((i, f, o, g, before, tc, last))
        return out, trail

    def back(self, x: np.ndarray, d: str, trail: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        p, n = self.p, self.hidden
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        dz = np.empty((*x.shape[:2], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, tc, last = trail[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[f"H{d}"] += last.T @ dz[t]
            dh, dc = dz[t] @ p[f"H{d}"].T, dc * f
        grad[f"X{d}"] += np.tensordot(x, dz, ([0, 1], [0, 1]))
        grad[f"B{d}"] += dz.sum(axis=(0, 1))
        return dz @ p[f"X{d}"].T

    def emissions(self, s: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["E"][s]
        f, tf = self.run(x, "f")
        b, tb = self.run(x[::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["O"] + self.p["c"], (x, tf, tb, both)

    def lattice(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums, and the log of the total of each window."""
        a, z = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, len(e)):
            a[t] = e[t] + logsum(a[t - 1][:, :, None] + self.p["A"], 1)
        for t in range(len(e) - 2, -1, -1):
            z[t] = logsum(self.p["A"] + (e[t + 1] + z[t + 1])[:, None, :], 2)
        return a, z, logsum(a[-1], 1)

    def step(self, s: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss of a batch of symbols and tags (place, window), and its gradients."""
        e, (x, tf, tb, both) = self.emissions(s)
        a, z, total = self.lattice(e)
        n, k = s.shape[1], e.shape[2]
        de = np.exp(a + z - total[:, None])
        hot = np.eye(k, dtype=np.float32)[y]
        pair = np.exp(a[:-1, :, :, None] + self.p["A"] + (e[1:] + z[1:])[:, :, None, :] - total[:, None, None]).sum(axis=(0, 1))
        score = (e * hot).sum(axis=(0, 2)) + self.p["A"][y[:-1], y[1:]].sum(axis=0)
        grad = {q: np.zeros_like(v) for q, v in self.p.items()}
        de = (de - hot) / n
        grad["A"] = (pair - np.einsum("tbi,tbj->ij", hot[:-1], hot[1:])) / n
        grad["O"] = np.tensordot(both, de, ([0, 1], [0, 1]))
        grad["c"] = de.sum(axis=(0, 1))
        dboth = de @ self.p["O"].T
        dx = self.back(x, "f", tf, dboth[:, :, : self.hidden], grad) + self.back(x[::-1], "b", tb, dboth[::-1, :, self.hidden :], grad)[::-1]
        np.add.at(grad["E"], s, dx)
        return float((total - score).mean()), grad

    def fit(self, s: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam on windows (window, place), its rate falling to a tenth; returns the mean loss of each epoch."""
        r, losses, t = np.random.default_rng(seed), [], 0
        last = epochs * -(-len(s) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order, total = r.permutation(len(s)), []
            for k in range(0, len(s), batch):
                at = order[k : k + batch]
                loss, grad = self.step(s[at].T, y[at].T)
                total.append(loss)
                t += 1
                for q, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[q] += 0.1 * (g - m[q])
                    v2[q] += 0.001 * (g * g - v2[q])
                    self.p[q] -= (rate * (1 - 0.9 * t / last) * (m[q] / (1 - 0.9**t)) / (np.sqrt(v2[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def decode(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequence of each window (window, place), and each tag's probability."""
        e, _ = self.emissions(s.T)
        a, z, total = self.lattice(e)
        best, back = e[0], np.zeros(e.shape, dtype=np.int64)
        for t in range(1, len(e)):
            through = best[:, :, None] + self.p["A"]
            back[t] = through.argmax(axis=1)
            best = e[t] + through.max(axis=1)
        path = np.empty(e.shape[:2], dtype=np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][:, None], axis=1)[:, 0]
        sure = np.exp(np.take_along_axis(a + z, path[:, :, None], axis=2)[:, :, 0] - total)
        return path.T, sure.T
