"""Best paths of states over long tracks, as products of (max, +) matrices.

What a stretch of positions does to the scores of four states is a matrix: the best score of a path from each state before
it to each state at its end.  Matrices of adjoining stretches multiply with + for times and max for plus, in any grouping, so
positions of equal scores have a power, buckets of positions reduce to one matrix each in parallel, a product over the
buckets of a segment tells the states in which the best path enters and leaves every bucket, and buckets are then decoded in
parallel.

Scores are whole numbers (of 2^-28), so that sums don't depend on the grouping.  Of equally good paths the one is taken that
a loop from the last position back would choose: every matrix ranks, for each state at its end, the states before it by
what such a loop prefers, the last position's choice first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SCALE, NEVER = 2.0**28, -(1 << 60)
STATES = 4


def whole(scores: np.ndarray) -> np.ndarray:
    """Scores as whole numbers, those of minus infinity far below all others."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(scores), np.rint(np.where(np.isfinite(scores), scores, 0.0) * SCALE), NEVER).astype(np.int64)


@dataclass
class Steps:
    """Matrices (n x from x to) and the ranks of the states before, for each state at the end: what ties prefer comes first."""

    score: np.ndarray
    rank: np.ndarray

    def __len__(self) -> int:
        return len(self.score)

    def __getitem__(self, at) -> Steps:
        return Steps(self.score[at], self.rank[at])

    def put(self, at, other: Steps) -> None:
        self.score[at], self.rank[at] = other.score, other.rank

    @staticmethod
    def none(n: int) -> Steps:
        """What no position does."""
        own = np.eye(STATES, dtype=bool)
        return Steps(np.tile(np.where(own, 0, NEVER).astype(np.int64), (n, 1, 1)), np.tile(np.where(own, 0, 1).astype(np.int8), (n, 1, 1)))

    @staticmethod
    def single(moves: np.ndarray, prefers: np.ndarray, scores: np.ndarray) -> Steps:
        """One position each, of scores (n x states), entered by moves (from x to)."""
        return Steps(np.maximum(moves + (scores - scores.max(1, keepdims=True))[:, None, :], NEVER), np.tile(prefers.astype(np.int8), (len(scores), 1, 1)))


def times(a: Steps, b: Steps, chunk: int = 1 << 13) -> Steps:
    """First ``a``, then ``b``; the ranks of a column are distinct, so no two ways tie in them."""
    out = Steps(np.empty_like(a.score), np.empty_like(a.rank))
    for at in range(0, len(a), chunk):
        # matrices lie last, so that each operation runs along them
        x, y, r, q = (np.ascontiguousarray(np.moveaxis(s[at : at + chunk], 0, -1)) for s in (a.score, b.score, a.rank, b.rank))
        best = key = None
        for k in range(STATES):  # the state between
            every = x[:, k, None] + y[None, k]
            last = q[None, k] * np.int8(8) + r[:, k, None]
            if best is None:
                best, key = every, last
            else:
                better = (every > best) | ((every == best) & (last < key))
                best, key = np.where(better, every, best), np.where(better, last, key)
        rank = np.zeros(key.shape, np.int8)
        for k in range(STATES):
            rank += key > key[k]
        out.put(slice(at, at + chunk), Steps(np.moveaxis(np.maximum(best, NEVER), -1, 0), np.moveaxis(rank, -1, 0)))
    return out


def alike(scores: np.ndarray, *marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which each stands for all that agree in scores and marks, and for every row which of them it is."""
    both = np.concatenate((np.ascontiguousarray(scores, np.int64).reshape(len(scores), int(np.prod(scores.shape[1:]))), *[np.asarray(m, np.int64)[:, None] for m in marks]), 1)
    key = np.ascontiguousarray(both).view(np.dtype((np.void, 8 * both.shape[1]))).ravel()
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return first, of.ravel()


def powers(base: Steps, length: np.ndarray, first: np.ndarray, of: np.ndarray) -> Steps:
    """As ``power``, worked out once for rows that are alike (``alike``)."""
    return power(base[first], length[first])[of]


def power(base: Steps, length: np.ndarray) -> Steps:
    """Each matrix as often as its length says."""
    out, left, live = Steps.none(len(base)), length.copy(), np.arange(len(base))
    base = Steps(base.score.copy(), base.rank.copy())
    while len(live):
        odd = live[left[live] & 1 == 1]
        if len(odd):
            out.put(odd, times(out[odd], base[odd]))
        left[live] >>= 1
        live = live[left[live] > 0]
        if len(live):
            base.put(live, times(base[live], base[live]))
    return out


def product(steps: Steps) -> Steps:
    """All in turn, as one."""
    while len(steps) > 1:
        odd = steps[len(steps) - 1 :] if len(steps) % 2 else None
        steps = times(steps[: len(steps) // 2 * 2 : 2], steps[1::2])
        if odd is not None:
            steps = Steps(np.concatenate((steps.score, odd.score)), np.concatenate((steps.rank, odd.rank)))
    return steps


def prefixes(steps: Steps) -> Steps:
    """The products of the first, the first two, ..."""
    if len(steps) < 2:
        return steps
    pairs = prefixes(times(steps[: len(steps) // 2 * 2 : 2], steps[1::2]))
    out = Steps(np.empty_like(steps.score), np.empty_like(steps.rank))
    out.put(0, steps[0])
    out.put(slice(1, None, 2), pairs)
    rest = len(range(2, len(steps), 2))
    out.put(slice(2, None, 2), times(pairs[:rest], steps[2::2]))
    return out


def _followed(maps: np.ndarray) -> np.ndarray:
    """Maps of states (n x states): the first, the second of the first, ..."""
    if len(maps) < 2:
        return maps
    pairs = _followed(np.take_along_axis(maps[1::2], maps[: len(maps) // 2 * 2 : 2], 1))
    out = np.empty_like(maps)
    out[0], out[1::2] = maps[0], pairs
    rest = len(range(2, len(maps), 2))
    out[2::2] = np.take_along_axis(maps[2::2], pairs[:rest], 1)
    return out


def chosen(before: np.ndarray, step: Steps, end: np.ndarray) -> np.ndarray:
    """The states before steps from which the best paths reach the ends, given scores before (n x states)."""
    rows = np.arange(len(end))
    every = before + step.score[rows, :, end]
    return np.where(every == every.max(1, keepdims=True), step.rank[rows, :, end], np.int8(100)).argmin(1)


def chain(steps: list[Steps], begin: np.ndarray) -> list[tuple[int, int]]:
    """The states before and at the end of each of a segment's stretches, given the scores before the first; of equal ends the first state."""
    entry = [begin]
    for x in steps:
        on = (entry[-1][:, None] + x.score[0]).max(0)
        entry.append(np.maximum(on - on.max(), NEVER))
    end, out = int(entry[-1].argmax()), []
    for x, before in zip(reversed(steps), reversed(entry[:-1]), strict=True):
        came = int(chosen(before[None], x, np.array([end]))[0])
        out.append((came, end))
        end = came
    return out[::-1]


def decoded(single: Steps, length: np.ndarray, runs: Steps, came: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stretch's best path from the state before it to the one at its end, as pieces of one state: places, lengths, states.

    ``runs`` are the powers of ``single``.  States at the ends of runs follow from prefix products, forwards, and from maps of
    states, backwards; a run whose state stays is one piece, others are halved until theirs do.
    """
    n = len(runs)
    before = np.concatenate((np.where(np.arange(STATES) == came, 0, NEVER)[None], prefixes(runs).score[:-1, came]))
    back = np.stack([chosen(before, runs, np.full(n, j)) for j in range(STATES)], 1)
    own = _followed(back[::-1])[:, end][::-1]  # the state before each run
    a, b = own, np.append(own[1:], end)
    at, run, size, whole = np.cumsum(length) - length, np.arange(n), length, runs
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(run):
        x = single[run]
        if whole is None:
            kind = alike(x.score, size)
            whole = powers(x, size, *kind)
        stays = (a == b) & (whole.score[np.arange(len(run)), a, b] == np.maximum(size * x.score[np.arange(len(run)), a, a], NEVER))
        ready = stays | (size == 1)
        done.append((at[ready], size[ready], b[ready]))
        at, run, size, a, b, x = at[~ready], run[~ready], size[~ready], a[~ready], b[~ready], x[~ready]
        half, whole = size // 2, None
        kind = alike(x.score, size)
        middle = chosen(powers(x, half, *kind).score[np.arange(len(run)), a], powers(x, size - half, *kind), b)
        at, run, size, a, b = np.concatenate((at, at + half)), np.tile(run, 2), np.concatenate((half, size - half)), np.concatenate((a, middle)), np.concatenate((middle, b))
    at, size, state = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(at)
    return at[order], size[order], state[order]
