"""Linear-chain conditional random field with two labels, in numpy."""

from __future__ import annotations

import numpy as np


class Chain:
    """Weights of binary features for label 1 (label 0 scores 0), transition
    scores, and scores of the first label. Trained by Adam on the conditional
    log-likelihood; decoded by Viterbi."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.w = np.zeros(len(names) + 1)  # the last is the bias
        self.move = np.zeros((2, 2))
        self.first = np.zeros(2)

    def rows(self, features: list[list[str]]) -> list[np.ndarray]:
        bias = len(self.w) - 1
        return [np.array([self.index[n] for n in f if n in self.index] + [bias]) for f in features]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[r].sum() for r in rows])

    def _gradients(self, chains, labels):
        """Of the log-likelihood of chains of equal treatment, padded together."""
        n, longest = len(chains), max(map(len, chains))
        s = np.zeros((n, longest))
        on = np.zeros((n, longest), bool)
        y = np.zeros((n, longest), int)
        for k, (c, l) in enumerate(zip(chains, labels)):
            s[k, :len(c)], on[k, :len(c)], y[k, :len(c)] = self.scores(c), True, l
        emit = np.stack([np.zeros_like(s), s], axis=2)
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = self.first + emit[:, 0]
        for t in range(1, longest):
            a = np.logaddexp(forward[:, t - 1, 0, None] + self.move[0], forward[:, t - 1, 1, None] + self.move[1]) + emit[:, t]
            forward[:, t] = np.where(on[:, t, None], a, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        back = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            nxt = emit[:, t + 1] + back[:, t + 1]
            b = np.logaddexp(self.move[:, 0] + nxt[:, 0, None], self.move[:, 1] + nxt[:, 1, None])
            back[:, t] = np.where(on[:, t + 1, None], b, 0)
        p1 = np.exp(forward[:, :, 1] + back[:, :, 1] - total[:, None])
        gw = np.zeros_like(self.w)
        for k, c in enumerate(chains):
            for t, r in enumerate(c):
                gw[r] += y[k, t] - p1[k, t]
        gm = np.zeros((2, 2))
        for t in range(1, longest):
            both = np.exp(forward[:, t - 1, :, None] + self.move + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None])
            both[~on[:, t]] = 0
            gm -= both.sum(axis=0)
            np.add.at(gm, (y[on[:, t], t - 1], y[on[:, t], t]), 1)
        p0 = np.exp(forward[:, 0] + back[:, 0] - total[:, None])
        gf = np.bincount(y[:, 0], minlength=2) - p0.sum(axis=0)
        return gw / n, gm / n, gf / n

    def fit(self, chains: list[list[np.ndarray]], labels: list[np.ndarray], epochs: int = 12, batch: int = 32, ridge: float = 1e-4, seed: int = 0) -> Chain:
        rng = np.random.default_rng(seed)
        params = [self.w, self.move, self.first]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        # chains of like length share a batch, so that padding stays small
        by_length = np.argsort([len(c) for c in chains], kind="stable")
        batches = [by_length[lo:lo + batch] for lo in range(0, len(by_length), batch)]
        for epoch in range(epochs):
            rate = 0.1 * (1 - epoch / epochs) + 0.005
            for b in rng.permutation(len(batches)):
                pick = batches[b]
                grads = self._gradients([chains[i] for i in pick], [labels[i] for i in pick])
                t += 1
                for k, (p, g) in enumerate(zip(params, grads)):
                    g = g - ridge * p
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    p += rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)
        return self

    def decode(self, scores) -> list[int]:
        """The most likely labels of a chain, given its scores for label 1."""
        if not len(scores):
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.first[0], self.first[1] + scores[0]
        came = []
        for s in scores[1:]:
            from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 > b + m11 else 1)
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + s
            came.append((from0, from1))
        label = int(b >= a)
        out = [label]
        for c in reversed(came):
            label = c[label]
            out.append(label)
        return out[::-1]
