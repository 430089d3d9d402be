"""A small character BiLSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    """Tags for sequences of small integers. Arrays are (time, batch, ...); a
    mask is 1 where a sequence has a character."""

    def __init__(self, n_inputs: int, n_tags: int, allowed: np.ndarray, hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_tags = hidden, n_tags
        self.forbidden = np.where(allowed, 0.0, -1e4)  # tag to tag
        w = lambda *shape: rng.normal(0, 0.2, shape)
        self.p = {f"{d}_{k}": v for d in "fb" for k, v in
                  (("x", w(n_inputs, 4 * hidden)), ("h", w(hidden, 4 * hidden)), ("c", np.zeros(4 * hidden)))}
        for d in "fb":
            self.p[f"{d}_c"][hidden:2 * hidden] = 1.0  # remember at first
        self.p |= {"out": w(2 * hidden, n_tags), "bias": np.zeros(n_tags), "move": np.zeros((n_tags, n_tags))}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        """Hidden states of one direction; ``keep`` gets what the way back needs."""
        n = self.hidden
        steps, batch = x.shape
        h = c = np.zeros((batch, n))
        out = np.empty((steps, batch, n))
        entry = self.p[f"{d}_x"] + self.p[f"{d}_c"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = entry[x[t]] + h @ self.p[f"{d}_h"]
            gates = _sigmoid(z[:, :3 * n])
            g = np.tanh(z[:, 3 * n:])
            m = mask[t][:, None]
            new = m * (gates[:, n:2 * n] * c + gates[:, :n] * g)
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, gates, g, c, tanh, h, m))
            c = new
            h = m * gates[:, 2 * n:] * tanh
            out[t] = h
        return out

    def _back(self, d: str, x: np.ndarray, kept: list, grad: np.ndarray, g: dict):
        n = self.hidden
        dh = dc = np.zeros((x.shape[1], n))
        gx, gh = np.zeros_like(self.p[f"{d}_x"]), np.zeros_like(self.p[f"{d}_h"])
        for t, gates, cand, c, tanh, h, m in reversed(kept):
            dh = (dh + grad[t]) * m
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            dc = (dc + dh * o * (1 - tanh ** 2)) * m
            dz = np.concatenate((dc * cand * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o),
                                 dc * i * (1 - cand ** 2)), 1)
            gx += np.eye(len(gx))[x[t]].T @ dz
            gh += h.T @ dz
            dh, dc = dz @ self.p[f"{d}_h"].T, dc * f
        g[f"{d}_x"], g[f"{d}_h"], g[f"{d}_c"] = gx, gh, gx.sum(0)

    def emissions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run("f", x, mask, None), self._run("b", x, mask, None)), 2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood per sequence, and its gradients."""
        steps, batch = x.shape
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], 2)
        e = both @ self.p["out"] + self.p["bias"]
        move = self.p["move"] + self.forbidden
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + move
            top = s.max(1)
            alpha[t] = np.where(mask[t][:, None] > 0, e[t] + top + np.log(np.exp(s - top[:, None]).sum(1)), alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            s = move + (e[t + 1] + beta[t + 1])[:, None, :]
            top = s.max(2)
            beta[t] = np.where(mask[t + 1][:, None] > 0, top + np.log(np.exp(s - top[:, :, None]).sum(2)), beta[t + 1])
        top = alpha[-1].max(1)
        total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        rows = np.arange(batch)
        gold = np.zeros(batch)
        de = np.exp(alpha + beta - total[None, :, None]) * mask[:, :, None]
        dmove = np.zeros_like(move)
        for t in range(steps):
            gold += mask[t] * e[t, rows, tags[t]]
            de[t, rows, tags[t]] -= mask[t]
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - total[:, None, None])
                dmove += (pair * mask[t][:, None, None]).sum(0)
                gold += mask[t] * move[tags[t - 1], tags[t]]
                dmove -= np.bincount(tags[t - 1] * self.n_tags + tags[t], mask[t], dmove.size).reshape(dmove.shape)
        g = {"out": np.einsum("tbi,tbj->ij", both, de), "bias": de.sum((0, 1)), "move": dmove}
        dboth = de @ self.p["out"].T
        n = self.hidden
        self._back("f", x, kept["f"], dboth[:, :, :n], g)
        self._back("b", x, kept["b"], dboth[:, :, n:], g)
        return float((total - gold).mean()), {k: v / batch for k, v in g.items()}

    def fit(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 256, rate: float = 0.02,
            seed: int = 0) -> float:
        """Adam over shuffled batches; the same input gives the same weights."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order = rng.permutation(x.shape[1])
            for low in range(0, len(order), batch):
                at = order[low:low + batch]
                loss, g = self.gradients(x[:, at], mask[:, at], tags[:, at])
                norm = np.sqrt(sum((v ** 2).sum() for v in g.values()))
                step += 1
                for k, v in g.items():
                    v = v * min(1.0, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v ** 2
                    size = rate * (1 - epoch / epochs) + rate / 10
                    self.p[k] -= size * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return loss

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tags (Viterbi) of each sequence."""
        e = self.emissions(x, mask)
        move = self.p["move"] + self.forbidden
        steps, batch, _ = e.shape
        score, back = e[0], np.zeros((steps, batch, self.n_tags), np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + move
            back[t] = s.argmax(1)
            live = mask[t][:, None] > 0
            back[t] = np.where(live, back[t], np.arange(self.n_tags))
            score = np.where(live, s.max(1) + e[t], score)
        tags = np.empty((steps, batch), np.int8)
        tags[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(batch), tags[t]]
        return tags
