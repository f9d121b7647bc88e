"""A linear-chain conditional random field over named features, fitted with numpy by Adam steps over all sequences.

Fitting sees a bounded sample of sequences on the driver; decoding is Viterbi over one sequence at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Score of a transition that must not be taken.
FORBIDDEN = -1e6


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class ChainCRF:
    n_labels: int
    forbidden: tuple[tuple[int, int], ...] = ()
    forbidden_start: tuple[int, ...] = ()
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    moves: np.ndarray | None = None
    start: np.ndarray | None = None

    def vector(self, names: Sequence[str]) -> np.ndarray:
        """Score of each label from the known features of one token."""
        at = [self.features[n] for n in names if n in self.features]
        return self.weights[at].sum(axis=0) if at else np.zeros(self.n_labels)

    def _shut(self) -> None:
        for a, b in self.forbidden:
            self.moves[a, b] = FORBIDDEN
        for a in self.forbidden_start:
            self.start[a] = FORBIDDEN

    def fit(self, sequences: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[int]],
            rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> ChainCRF:
        """Maximise the likelihood of ``labels``; all sequences at once, padded to the longest."""
        pairs = [(s, y) for s, y in zip(sequences, labels) if len(s)]
        for s, _ in pairs:
            for token in s:
                for name in token:
                    self.features.setdefault(name, len(self.features))
        n, k = len(pairs), self.n_labels
        self.weights, self.moves = np.zeros((len(self.features), k)), np.zeros((k, k))
        self.start = np.zeros(k)
        self._shut()
        if not n:
            return self
        longest = max(len(s) for s, _ in pairs)
        lengths = np.array([len(s) for s, _ in pairs])
        mask = np.arange(longest) < lengths[:, None]
        gold = np.zeros((n, longest), np.int64)
        tokens, ids = [], []
        for i, (s, y) in enumerate(pairs):
            gold[i, :len(s)] = y
            for t, names in enumerate(s):
                tokens.extend([i * longest + t] * len(names))
                ids.extend(self.features[x] for x in names)
        tokens, ids = np.array(tokens), np.array(ids)
        by_token, by_feature = np.argsort(tokens, kind="stable"), np.argsort(ids, kind="stable")
        token_at, token_from = np.unique(tokens[by_token], return_index=True)
        feature_at, feature_from = np.unique(ids[by_feature], return_index=True)
        hot = np.eye(k)[gold] * mask[..., None]
        steps = (mask[:, 1:] * 1.0)[..., None]
        gold_moves = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:] * steps)
        gold_start = hot[:, 0].sum(axis=0)
        values = (self.weights, self.moves, self.start)
        mean, square = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
        for step_number in range(1, rounds + 1):
            emit = np.zeros((n * longest, k))
            emit[token_at] = np.add.reduceat(self.weights[ids[by_token]], token_from)
            emit = emit.reshape(n, longest, k)
            fore = np.empty_like(emit)
            back = np.zeros_like(emit)
            fore[:, 0] = self.start + emit[:, 0]
            for t in range(1, longest):
                step = _log_sum(fore[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
                fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = _log_sum(self.moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
            total = _log_sum(fore[:, -1], 1)
            seen = np.exp(fore + back - total[:, None, None]) * mask[..., None]
            pair = np.zeros((k, k))
            for t in range(1, longest):
                joint = (fore[:, t - 1, :, None] + self.moves + (emit[:, t] + back[:, t])[:, None, :]
                         - total[:, None, None])
                pair += (np.exp(joint) * mask[:, t, None, None]).sum(axis=0)
            off = (hot - seen).reshape(-1, k)
            slope = np.zeros_like(self.weights)
            slope[feature_at] = np.add.reduceat(off[tokens[by_feature]], feature_from)
            gradients = (slope / n - decay * self.weights, (gold_moves - pair) / n,
                         (gold_start - seen[:, 0].sum(axis=0)) / n)
            for value, gradient, m, v in zip(values, gradients, mean, square):
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient ** 2 - v)
                value += rate * (m / (1 - 0.9 ** step_number)) / (np.sqrt(v / (1 - 0.99 ** step_number)) + 1e-8)
            self._shut()
        return self

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """The best labels of one sequence; the lower label wins a tie."""
        best, moves, back = (self.start + emit[0]).tolist(), self.moves.T.tolist(), []
        for row in emit[1:].tolist():
            came, now = [], []
            for into, score in zip(moves, row):
                options = [b + m for b, m in zip(best, into)]
                top = max(options)
                came.append(options.index(top))
                now.append(top + score)
            back.append(came)
            best = now
        path = [best.index(max(best))]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]
