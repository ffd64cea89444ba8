"""A gated recurrent layer in numpy: forward, and backward through the steps of a window.

Gates: z = s(xz + h Uz), r = s(xr + h Ur), n = tanh(xn + r * (h Un)), h' = n + z * (h - n). The inputs xs come
summed up already, biases included, as rows of 3 * size; U is (size, 3 * size).

The functions by columns are the same layer, with a row's numbers below each other, which is several times as fast for many rows.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The state after h and the input x, which is overwritten."""
    size = h.shape[1]
    m = h @ u
    gates = x[:, : 2 * size]
    gates += m[:, : 2 * size]
    np.clip(gates, -30, 30, out=gates)
    sigmoid(gates)
    n = m[:, 2 * size :]
    n *= gates[:, size:]
    n += x[:, 2 * size :]
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:, :size]
    out += n
    return out


def forward(xs: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """xs (steps, rows, 3 * size) -> states (steps, rows, size), and what backward needs."""
    size, out, kept = h.shape[1], np.empty((*xs.shape[:2], h.shape[1]), xs.dtype), []
    for t, x in enumerate(xs):
        m = h @ u
        gates = sigmoid(np.clip(x[:, : 2 * size] + m[:, : 2 * size], -30, 30))
        z, r = gates[:, :size], gates[:, size:]
        n = np.tanh(x[:, 2 * size :] + r * m[:, 2 * size :])
        kept.append((h, z, r, n, m[:, 2 * size :]))
        h = out[t] = n + z * (h - n)
    return out, kept


def backward(grads: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the states -> those by the inputs xs and by U; none goes on before the first step."""
    size, dh, du = u.shape[0], np.zeros_like(grads[0]), np.zeros_like(u)
    dxs = np.empty((*grads.shape[:2], 3 * size), grads.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, hn = kept[t]
        dh = dh + grads[t]
        dz = dh * (h - n) * z * (1 - z)
        dn = dh * (1 - z) * (1 - n * n)
        dr = dn * hn * r * (1 - r)
        dm = np.concatenate([dz, dr, dn * r], axis=1)
        dxs[t] = np.concatenate([dz, dr, dn], axis=1)
        du += h.T @ dm
        dh = dh * z + dm @ u.T
    return dxs, du


def half_gates(w: np.ndarray) -> np.ndarray:
    """Inputs or U whose gates are halved, as the functions by columns take them: s(x) = (tanh(x / 2) + 1) / 2."""
    out, size = w.copy(), w.shape[-1] // 3
    out[..., : 2 * size] *= 0.5
    return out


def _gates_and_new(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size, m = len(h), u @ h
    gates, hn = m[: 2 * size], m[2 * size :]
    gates += x[: 2 * size]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    n = hn * gates[size:]
    n += x[2 * size :]
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:size]
    out += n
    return gates, hn, n, out


def step_columns(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The state (size, rows) after h and x (3 * size, rows); u: transposed. x and u are of half_gates."""
    return _gates_and_new(x, h, u)[3]


def forward_columns(xs: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """xs (steps, 3 * size, rows) of half_gates, u transposed and of half_gates -> states (steps, size, rows), and what backward_columns needs."""
    out, kept = np.empty((len(xs), *h.shape), xs.dtype), []
    for t, x in enumerate(xs):
        gates, hn, n, out[t] = _gates_and_new(x, h, u)
        kept.append((h, gates, n, hn))
        h = out[t]
    return out, kept


def backward_columns(grads: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As backward, for grads (steps, size, rows) and u as it is, neither transposed nor halved; gives dxs (steps, 3 * size, rows), by inputs that aren't halved."""
    size, dh, du = u.shape[0], np.zeros_like(grads[0]), np.zeros_like(u)
    dxs = np.empty((len(grads), 3 * size, grads.shape[2]), grads.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, gates, n, hn = kept[t]
        z, dx = gates[:size], dxs[t]
        dh = dh + grads[t]
        np.subtract(h, n, out=dx[:size])
        dx[:size] *= dh
        dn = dx[2 * size :]
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= dh
        dh *= z
        dn *= 1 - z
        np.multiply(dn, hn, out=dx[size : 2 * size])
        both = 1 - gates
        both *= gates
        dx[: 2 * size] *= both
        dm = dx.copy()
        dm[2 * size :] *= gates[size:]
        du += h @ dm.T
        dh += u @ dm
    return dxs, du


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float, most: float = 1.0):
        self.weights, self.rate, self.most, self.t = weights, rate, most, 0
        self.first = {k: np.zeros_like(w) for k, w in weights.items()}
        self.second = {k: np.zeros_like(w) for k, w in weights.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        """scale: of the rate. Gradients longer than `most` together are shortened."""
        self.t += 1
        length = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shorter = min(1.0, self.most / (length + 1e-12))
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * shorter
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.weights[k] -= rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)
