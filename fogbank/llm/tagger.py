"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions, decoding."""

from __future__ import annotations

import numpy as np

#: Characters are told apart by kind; punctuation by itself.
SIGNS = "\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = {c: i + 5 for i, c in enumerate(SIGNS)}
PAD, DIGIT, LOWER, UPPER, OTHER = range(5)
SIZE = 5 + len(SIGNS)


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    table = np.full(129, OTHER, dtype=np.int64)
    table[48:58], table[97:123], table[65:91] = DIGIT, LOWER, UPPER
    table[[9, 11, 12, 13]] = CLASSES[" "]
    for c, i in CLASSES.items():
        table[ord(c)] = i
    return table[np.minimum(raw, 128)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters by name. ``tags`` counts the tags."""

    def __init__(self, tags: int, dim: int = 8, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        weight = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": weight(SIZE, dim) * 2, "W": weight(2 * hidden, tags), "c": np.zeros(tags, np.float32),
                  "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1  # remember at first
            self.p |= {f"X{d}": weight(dim, 4 * hidden), f"H{d}": weight(hidden, 4 * hidden), f"B{d}": bias}

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, batch, hidden) of one direction for embedded input (time, batch, dim)."""
        p, n = self.p, self.hidden
        steps, batch = x.shape[:2]
        pre = x @ p[f"X{d}"] + p[f"B{d}"]
        h = np.zeros((batch, n), np.float32)
        c = np.zeros((batch, n), np.float32)
        out = np.empty((steps, batch, n), np.float32)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ p[f"H{d}"]
            g = sigmoid(z[:, :3 * n])
            u = np.tanh(z[:, 3 * n:])
            before, c0 = h, c
            c = g[:, n:2 * n] * c + g[:, :n] * u
            tc = np.tanh(c)
            h = g[:, 2 * n:] * tc
            out[t] = h
            if keep:
                saved.append((t, g, u, before, c0, tc))
        return out, saved

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tags) for class ids (batch, time)."""
        x = self.p["E"][ids.T]
        f, b = self.run(x, "f")[0], self.run(x, "b")[0]
        return (np.concatenate([f, b], axis=2) @ self.p["W"] + self.p["c"]).transpose(1, 0, 2)

    def step(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood per window, and its gradients."""
        p, n = self.p, self.hidden
        x = p["E"][ids.T]
        f, sf = self.run(x, "f", True)
        b, sb = self.run(x, "b", True)
        states = np.concatenate([f, b], axis=2)
        e = states @ p["W"] + p["c"]
        y = y.T
        steps, batch = y.shape
        a = np.empty_like(e)
        a[0] = p["S"] + e[0]
        for t in range(1, steps):
            a[t] = logsumexp(a[t - 1][:, :, None] + p["T"], 1) + e[t]
        back = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            back[t] = logsumexp(p["T"] + (e[t + 1] + back[t + 1])[:, None, :], 2)
        z = logsumexp(a[-1], 1)
        rows = np.arange(batch)
        gold = p["S"][y[0]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(p["T"][y[t - 1], y[t]] for t in range(1, steps))
        de = np.exp(a + back - z[None, :, None])
        grads = {"S": de[0].sum(0).copy()}
        pair = np.exp(a[:-1][:, :, :, None] + p["T"] + (e[1:] + back[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        np.subtract.at(grads["S"], y[0], 1)
        tt, bb = np.meshgrid(np.arange(steps), rows, indexing="ij")
        de[tt, bb, y] -= 1
        de /= batch
        grads |= {"T": pair / batch, "W": np.einsum("tbh,tbk->hk", states, de), "c": de.sum((0, 1))}
        grads["S"] /= batch
        ds = de @ p["W"].T
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, ds[:, :, :n]), ("b", sb, ds[:, :, n:])):
            H, X = p[f"H{d}"], p[f"X{d}"]
            dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            gH, dz_all = np.zeros_like(H), np.empty((steps, batch, 4 * n), np.float32)
            for t, g, u, before, c0, tc in reversed(saved):
                dh = dh + part[t]
                i, fg, o = g[:, :n], g[:, n:2 * n], g[:, 2 * n:]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dz_all[t] = dz
                gH += before.T @ dz
                dh, dc = dz @ H.T, dc * fg
            grads |= {f"H{d}": gH, f"X{d}": np.einsum("tbd,tbz->dz", x, dz_all), f"B{d}": dz_all.sum((0, 1))}
            dx += dz_all @ X.T
        gE = np.zeros_like(p["E"])
        np.add.at(gE, ids.T, dx)
        grads["E"] = gE
        return float((z - gold).mean()), grads

    def fit(self, ids: np.ndarray, y: np.ndarray, epochs: int, batch: int = 48, rate: float = 0.01, seed: int = 5) -> float:
        """Adam over shuffled windows; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, mean = 0, 0.0
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(len(ids)), []
            for at in range(0, len(order), batch):
                some = order[at: at + batch]
                loss, grads = self.step(ids[some], y[some])
                losses.append(loss)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale = min(1.0, 5.0 / (size + 1e-9))
                step += 1
                lr = rate * (1 - 0.9 * step / total)
                for k, g in grads.items():
                    g = g * scale
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) for emissions (batch, time, tags); past a row's length they are 0."""
        batch, steps, _ = e.shape
        best, back = self.p["S"] + e[:, 0], np.zeros((steps, batch, self.tags), dtype=np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + self.p["T"]
            back[t] = s.argmax(1)
            moved = s.max(1) + e[:, t]
            best = np.where((t < lengths)[:, None], moved, best)
        out = np.zeros((batch, steps), dtype=np.int8)
        tag = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, -1, -1):
            live = t < lengths
            out[live, t] = tag[live]
            tag = np.where(live, back[t, rows, tag], tag) if t else tag
        return out
