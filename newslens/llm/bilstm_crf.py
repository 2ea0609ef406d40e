"""A small bidirectional LSTM with a CRF on top, in numpy: training and batched decoding.

Inputs are windows of character classes, ``(windows, steps)`` of small integers; outputs are one tag
per character. Gates of both directions are looked up by class (the input is one-hot), the recurrence
is one matrix product per step for a whole batch of windows.
"""

from __future__ import annotations

import numpy as np

FLOAT = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLstmCrf:
    def __init__(self, classes: int, tags: int, hidden: int = 16, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(FLOAT)
        self.hidden = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p[f"x_{d}"] = draw(classes, 4 * hidden)
            self.p[f"x_{d}"][:, hidden : 2 * hidden] += 1  # remember by default
            self.p[f"h_{d}"] = draw(hidden, 4 * hidden) * FLOAT(0.5)
        self.p["out"] = draw(2 * hidden, tags)
        self.p["bias"] = np.zeros(tags, FLOAT)
        self.p["move"] = np.zeros((tags, tags), FLOAT)
        self.p["first"] = np.zeros(tags, FLOAT)

    def _direction(self, codes: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction, time first; ``codes`` are already in its order."""
        steps, n, k = *codes.shape, self.hidden
        look, w = self.p[f"x_{d}"], self.p[f"h_{d}"]
        h, c = np.zeros((n, k), FLOAT), np.zeros((n, k), FLOAT)
        states, trace = np.empty((steps, n, k), FLOAT), []
        for t in range(steps):
            z = look[codes[t]] + h @ w
            gates = sigmoid(z[:, : 3 * k])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            if keep:
                before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                trace.append((gates, g, tc, *before))
        return states, trace

    def emissions(self, windows: np.ndarray, keep: bool = False):
        codes = np.ascontiguousarray(windows.T)
        forward, trace_f = self._direction(codes, "f", keep)
        backward, trace_b = self._direction(codes[::-1], "b", keep)
        states = np.concatenate([forward, backward[::-1]], axis=2)
        return states @ self.p["out"] + self.p["bias"], states, trace_f, trace_b

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Most probable tags (Viterbi), one row per window."""
        e = self.emissions(windows)[0]
        steps, n, tags = e.shape
        back = np.empty((steps, n, tags), np.uint8)
        score = e[0] + self.p["first"]
        columns = self.p["move"].T  # to x from
        for t in range(1, steps):
            total = score[:, None, :] + columns[None]
            back[t] = total.argmax(axis=2)
            score = np.take_along_axis(total, back[t][:, :, None].astype(np.int64), 2)[:, :, 0] + e[t]
        path = np.empty((steps, n), np.uint8)
        path[-1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path.T

    def gradients(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window and its gradient."""
        e, states, trace_f, trace_b = self.emissions(windows, keep=True)
        steps, n, k = e.shape
        move = self.p["move"]
        high = move.max()
        scaled_move = np.exp(move - high)
        alpha, beta, norm = np.empty((steps, n, k)), np.empty((steps, n, k)), np.zeros(n)
        peak = e.max(axis=2, keepdims=True)
        weight = np.exp(e - peak)
        a = np.exp(self.p["first"])[None] * weight[0]
        for t in range(steps):
            if t:
                a = (alpha[t - 1] @ scaled_move) * weight[t]
            s = a.sum(axis=1, keepdims=True)
            alpha[t] = a / s
            norm += np.log(s[:, 0]) + peak[t, :, 0] + (high if t else 0)
        beta[-1] = 1
        pair = np.zeros_like(move, dtype=np.float64)
        for t in range(steps - 1, 0, -1):
            w = weight[t] * beta[t]
            b = w @ scaled_move.T
            joint = alpha[t - 1].T @ (w / (alpha[t - 1] * b).sum(axis=1, keepdims=True)) * scaled_move
            pair += joint
            beta[t - 1] = b / b.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        gold = tags.T
        at = np.arange(n)
        right = sum(float(e[t, at, gold[t]].sum()) for t in range(steps)) + float(self.p["first"][gold[0]].sum())
        np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        right += float(move[gold[:-1].ravel(), gold[1:].ravel()].sum())
        slope = gamma
        for t in range(steps):
            slope[t, at, gold[t]] -= 1
        slope = (slope / n).astype(FLOAT)
        grads = {"move": (pair / n).astype(FLOAT), "first": slope[0].sum(axis=0), "bias": slope.sum(axis=(0, 1))}
        grads["out"] = np.tensordot(states, slope, ((0, 1), (0, 1))).astype(FLOAT)
        to_states = slope @ self.p["out"].T
        h = self.hidden
        codes = np.ascontiguousarray(windows.T)
        for d, order, trace, part in (("f", codes, trace_f, to_states[:, :, :h]), ("b", codes[::-1], trace_b, to_states[::-1, :, h:])):
            grads |= self._back(order, d, trace, part)
        return (float(norm.sum()) - right) / n, grads

    def _back(self, codes: np.ndarray, d: str, trace: list, to_states: np.ndarray) -> dict[str, np.ndarray]:
        k, w = self.hidden, self.p[f"h_{d}"]
        gh, slopes = np.zeros_like(w), np.empty((*codes.shape, 4 * k), w.dtype)
        dh, dc = 0.0, 0.0
        for t in range(len(codes) - 1, -1, -1):
            gates, g, tc, h_before, c_before = trace[t]
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            dh = to_states[t] + dh
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gh += h_before.T @ dz
            slopes[t] = dz
            dh, dc = dz @ w.T, dc * f
        hot = np.eye(len(self.p[f"x_{d}"]), dtype=w.dtype)[codes.ravel()]
        return {f"x_{d}": hot.T @ slopes.reshape(-1, 4 * k), f"h_{d}": gh}

    def fit(self, windows: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over random batches with a falling rate; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = rng.choice(len(windows), min(batch, len(windows)), replace=False)
            now, grads = self.gradients(windows[pick], tags[pick])
            loss = now if step == 1 else 0.9 * loss + 0.1 * now
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            clip = min(1.0, 5.0 / max(size, 1e-9))
            speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * FLOAT(clip)
                first[k] += FLOAT(0.1) * (g - first[k])
                second[k] += FLOAT(0.01) * (g * g - second[k])
                scale = np.sqrt(second[k] / (1 - 0.99**step)) + FLOAT(1e-8)
                self.p[k] -= (speed / (1 - 0.9**step) * first[k] / scale).astype(FLOAT)
        return loss
