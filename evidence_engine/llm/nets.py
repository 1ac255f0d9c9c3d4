"""Recurrent layers in numpy with their gradients, and Adam.

Sequences are padded at the end, (steps, batch, width); ``mask`` (steps, batch) is 1 on real steps. A padded
step leaves the state as it is. The backward direction runs over each sequence reversed within its own length.
"""

from __future__ import annotations

import numpy as np

F4 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def reversal(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Step numbers (steps, batch) that reverse each sequence within its length; padding stays."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)


def init(rng: np.random.Generator, inputs: int, hidden: int, gates: int) -> dict[str, np.ndarray]:
    return {
        "wx": (rng.standard_normal((inputs, gates * hidden)) / np.sqrt(inputs)).astype(F4),
        "wh": (rng.standard_normal((hidden, gates * hidden)) / np.sqrt(hidden)).astype(F4),
        "b": np.zeros(gates * hidden, F4),
    }


def lstm(pre: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, batch, hidden) from pre = x @ wx + b with gates in the order in, forget, out, new."""
    steps, batch, wide = pre.shape
    n = wide // 4
    h, c = np.zeros((batch, n), F4), np.zeros((batch, n), F4)
    out = np.zeros((steps, batch, n), F4)
    for t in range(steps):
        z = pre[t] + h @ wh
        s, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        m = mask[t][:, None]
        c2 = s[:, n : 2 * n] * c + s[:, :n] * g
        tc = np.tanh(c2)
        if keep is not None:
            keep.append((h, c, s, g, tc, m))
        h, c = m * (s[:, 2 * n :] * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out


def lstm_back(dout: np.ndarray, wh: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of pre and wh."""
    steps, batch, n = dout.shape
    dpre, dwh = np.zeros((steps, batch, 4 * n), F4), np.zeros_like(wh)
    dh, dc = np.zeros((batch, n), F4), np.zeros((batch, n), F4)
    for t in range(steps - 1, -1, -1):
        h, c, s, g, tc, m = keep[t]
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        dh = dh + dout[t]
        own = dh * m
        dc2 = dc * m + own * o * (1 - tc**2)
        dz = dpre[t]
        dz[:, :n], dz[:, n : 2 * n] = dc2 * g * i * (1 - i), dc2 * c * f * (1 - f)
        dz[:, 2 * n : 3 * n], dz[:, 3 * n :] = own * tc * o * (1 - o), dc2 * i * (1 - g**2)
        dwh += h.T @ dz
        dh = dh * (1 - m) + dz @ wh.T
        dc = dc * (1 - m) + dc2 * f
    return dpre, dwh


def gru(pre: np.ndarray, wh: np.ndarray, mask: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """Hidden states from pre = x @ wx + b with gates in the order reset, update, new."""
    steps, batch, wide = pre.shape
    n = wide // 3
    h = np.zeros((batch, n), F4)
    out = np.empty((steps, batch, n), F4)
    for t in range(steps):
        u = h @ wh
        s = 0.5 * np.tanh(0.5 * (pre[t][:, : 2 * n] + u[:, : 2 * n])) + 0.5
        r, z = s[:, :n], s[:, n:]
        un = u[:, 2 * n :]
        new = np.tanh(pre[t][:, 2 * n :] + r * un)
        h2 = new + z * (h - new)
        if mask is not None:
            h2 = h + mask[t][:, None] * (h2 - h)
        if keep is not None:
            keep.append((h, r, z, un, new))
        h = h2
        out[t] = h
    return out


def gru_back(dout: np.ndarray, wh: np.ndarray, keep: list, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, n = dout.shape
    dpre, dwh = np.zeros((steps, batch, 3 * n), F4), np.zeros_like(wh)
    dh = np.zeros((batch, n), F4)
    for t in range(steps - 1, -1, -1):
        h, r, z, un, new = keep[t]
        dh = dh + dout[t]
        m = 1 if mask is None else mask[t][:, None]
        own = dh * m
        dnew = own * (1 - z) * (1 - new**2)
        dr, dzg = dnew * un * r * (1 - r), own * (h - new) * z * (1 - z)
        du = np.concatenate([dr, dzg, dnew * r], axis=1)
        dpre[t] = np.concatenate([dr, dzg, dnew], axis=1)
        dwh += h.T @ du
        dh = dh * (1 - m) + own * z + du @ wh.T
    return dpre, dwh


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g**2
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(F4)
