"""A conditional random field over token sequences, with optional skip edges.

Chains are trained and decoded in padded batches; skip edges join similar
tokens of one document and are handled by loopy message passing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Chain:
    """Padded sequences of one batch: ``slot[b, t]`` is the row of token t of sequence b, or -1."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths)
        n, longest = len(self.lengths), int(self.lengths.max(initial=0))
        t = np.arange(longest)
        self.mask = t[None, :] < self.lengths[:, None]
        starts = np.r_[0, np.cumsum(self.lengths)[:-1]] if n else np.zeros(0, int)
        self.slot = np.where(self.mask, starts[:, None] + t[None, :], -1)

    def pad(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((*self.slot.shape, rows.shape[1]), rows.dtype)
        out[self.mask] = rows
        return out


def forward_backward(unary: np.ndarray, trans: np.ndarray, chain: Chain, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log normaliser per sequence, log marginals per token (in row order), and, if asked for, expected transitions.

    Scaled sums: every step is one matrix product, and what is scaled away is kept as a logarithm.
    """
    top = unary.max(axis=1, keepdims=True)
    u, mask = chain.pad(np.exp(unary - top)), chain.mask
    n, longest, k = u.shape
    shift = trans.max()
    step = np.exp(trans - shift)
    alpha, scale = np.zeros_like(u), np.ones((n, longest))
    for t in range(longest):
        a = u[:, t] if t == 0 else (alpha[:, t - 1] @ step) * u[:, t]
        c = np.maximum(a.sum(axis=1), 1e-300)
        on = mask[:, t]
        scale[on, t] = c[on]
        alpha[:, t] = np.where(on[:, None], a / c[:, None], alpha[:, t - 1] if t else 0.0)
    beta = np.ones_like(u)
    pair = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        on = mask[:, t + 1]
        ahead = u[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        beta[:, t] = np.where(on[:, None], ahead @ step.T, 1.0)
        if pairs:
            pair += alpha[on, t].T @ ahead[on]
    marg = alpha[mask] * beta[mask]
    marg /= np.maximum(marg.sum(axis=1, keepdims=True), 1e-300)
    logz = np.where(mask, np.log(scale) + chain.pad(top)[:, :, 0], 0.0).sum(axis=1) + shift * (chain.lengths - 1)
    return logz, np.log(np.maximum(marg, 1e-300)), pair * step


def marginals(unary: np.ndarray, trans: np.ndarray, lengths: np.ndarray, at_once: int = 40_000) -> np.ndarray:
    """Log marginals of chains that lie one after the other; those of like length are run together."""
    out = np.empty_like(unary)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, min(4096, at_once // int(lengths[order[min(at + 255, len(order) - 1)]])))
        ws = order[at : at + size]
        at += size
        n = lengths[ws]
        rows = np.repeat(starts[ws] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        out[rows] = forward_backward(unary.take(rows, axis=0), trans, Chain(n), pairs=False)[1]
    return out


def viterbi(unary: np.ndarray, trans: np.ndarray, chain: Chain) -> np.ndarray:
    """Best label of every token, in row order; of equal paths the one with lower labels."""
    # longest first, so that those that still go on are always the first ones
    order = np.argsort(-chain.lengths, kind="stable")
    u, lengths = chain.pad(unary)[order], chain.lengths[order]
    n, longest, k = u.shape
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    into = np.ascontiguousarray(trans.T)[None]
    score = u[:, 0].copy()
    back = np.zeros((n, longest, k), np.int16)
    for t in range(1, longest):
        on = int(alive[t])
        x = score[:on, None, :] + into
        came = x.argmax(2)
        back[:on, t] = came
        score[:on] = np.take_along_axis(x, came[:, :, None], 2)[:, :, 0] + u[:on, t]
    best = np.zeros((n, longest), np.int64)
    at = np.arange(n)
    best[at, lengths - 1] = score.argmax(1)
    for t in range(longest - 1, 0, -1):
        on = int(alive[t])
        best[:on, t - 1] = back[at[:on], t, best[:on, t]]
    out = np.empty_like(best)
    out[order] = best
    return out[chain.mask]


def train(features: np.ndarray, labels: np.ndarray, lengths: Sequence[int], n_features: int, n_labels: int, epochs: int = 8, rate: float = 0.08, l2: float = 2e-6, batch: int = 256, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``(n_features, n_labels)`` and transitions of the chain alone, by AdaGrad on the conditional likelihood.

    ``features`` holds feature numbers, one row per token, feature 0 being
    padding whose weight stays 0.
    """
    return train_skip(features, labels, lengths, np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros((0, 3), int), np.zeros(n_labels, int), 0, epochs, rate, l2, batch, seed)[:2]


def train_skip(features: np.ndarray, labels: np.ndarray, lengths: Sequence[int], w: np.ndarray, trans: np.ndarray, edges: np.ndarray, classes: np.ndarray, n_types: int, epochs: int = 3, rate: float = 0.04, l2: float = 2e-6, batch: int = 256, seed: int = 5, l2_skip: float = 2e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goes on training a chain together with the potentials of its skip edges.

    ``edges`` are rows ``(left token, right token, type)``; ``classes`` joins
    labels into classes, and a type has one weight for each unordered pair of
    classes. Expectations at the edges come from loopy message passing.
    Returns weights, transitions and potentials ``(types, labels, labels)``.
    """
    rng = np.random.default_rng(seed)
    lengths = np.asarray(lengths)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    n_labels, n_classes = w.shape[1], int(classes.max(initial=0)) + 1
    w, trans = w.astype(np.float32), trans.copy()
    skip = np.zeros((n_types, n_classes, n_classes))
    gw, gt, gs = np.full_like(w, 1e-3), np.full_like(trans, 1e-3), np.full_like(skip, 1e-3)
    order = np.argsort(lengths, kind="stable")
    groups = [_Batch(features, labels, lengths, starts, order[i : i + batch], n_labels, edges) for i in range(0, len(order), batch)]
    onto = np.eye(n_classes)[classes]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            b = groups[g]
            unary = np.zeros((len(b.labels), n_labels))
            for column in b.features:
                unary += w.take(column, axis=0)
            if len(b.edges):
                full = skip[:, classes][:, :, classes]
                unary, to_left, to_right = messages(unary, trans, b.chain, b.edges, full)
            _, marg, pair = forward_backward(unary, trans, b.chain)
            if len(b.edges):
                left, right, kind = b.edges.T
                joint = (marg[left] - to_left)[:, :, None] + full[kind] + (marg[right] - to_right)[:, None, :]
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                joint = onto.T @ (joint / joint.sum(axis=(1, 2), keepdims=True)) @ onto
                diff = -joint
                diff[np.arange(len(left)), classes[b.labels[left]], classes[b.labels[right]]] += 1.0
                sg = np.zeros_like(skip)
                np.add.at(sg, kind, diff)
                sg = (sg + sg.transpose(0, 2, 1)) / b.n - l2_skip * skip
                gs += sg**2
                skip += 3.0 * rate * sg / np.sqrt(gs)
            diff = -np.exp(marg)
            diff[np.arange(len(b.labels)), b.labels] += 1.0
            grad = np.add.reduceat(diff.astype(np.float32).take(b.by, axis=0), b.first, axis=0)
            now, past = w.take(b.used, axis=0), gw.take(b.used, axis=0)
            grad *= np.float32(1 / b.n)
            grad -= np.float32(l2) * now
            past += grad * grad
            gw[b.used] = past
            now += np.float32(rate) * grad / np.sqrt(past)
            w[b.used] = now
            w[0] = 0.0
            tg = (b.steps - pair) / b.n
            gt += tg**2
            trans += rate * tg / np.sqrt(gt)
    return w, trans, skip[:, classes][:, :, classes]


class _Batch:
    """What of a training batch stays the same in every epoch."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, starts: np.ndarray, seqs: np.ndarray, n_labels: int, edges: np.ndarray):
        rows = np.concatenate([np.arange(starts[s], starts[s] + lengths[s]) for s in seqs])
        self.n, self.chain = len(seqs), Chain(lengths[seqs])
        self.labels = labels[rows]
        # the rows of one feature lie together after a sort and are summed in one pass
        flat = features[rows].reshape(-1)
        self.features = np.ascontiguousarray(features[rows].T)
        by = np.argsort(flat, kind="stable")
        self.first = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0])
        self.used = flat[by[self.first]]
        self.by = by // features.shape[1]
        inner = np.ones(len(rows), bool)
        inner[np.cumsum(lengths[seqs]) - lengths[seqs]] = False
        self.steps = np.zeros((n_labels, n_labels))
        np.add.at(self.steps, (self.labels[np.flatnonzero(inner) - 1], self.labels[inner]), 1.0)
        place = np.full(len(features), -1)
        place[rows] = np.arange(len(rows))
        here = edges[place[edges[:, 0]] >= 0]
        self.edges = np.c_[place[here[:, :2]], here[:, 2]]


def messages(unary: np.ndarray, trans: np.ndarray, chain: Chain, edges: np.ndarray, skip: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary scores after message passing along the skip edges, and the last messages to left and right ends.

    ``edges`` are rows ``(left, right, type)`` and ``skip[type, a, b]`` is the
    log potential of the labels at both ends. A round runs the chains exactly
    and then sends each end of every edge the message of the other end, from
    whose belief the edge's own last message has been taken out.
    """
    left, right, kind = edges.T
    potential = np.exp(skip)
    by_type = [np.flatnonzero(kind == t) for t in range(len(skip))]
    to_right = np.zeros((len(edges), unary.shape[1]))
    to_left = np.zeros_like(to_right)
    now = unary

    def send(belief: np.ndarray, back: bool) -> np.ndarray:
        q = np.exp(belief - belief.max(axis=1, keepdims=True))
        out = np.empty_like(q)
        for t, rows in enumerate(by_type):
            out[rows] = q[rows] @ (potential[t].T if back else potential[t])
        out = np.log(np.maximum(out, 1e-300))
        return out - out.max(axis=1, keepdims=True)

    for _ in range(rounds):
        belief = forward_backward(now, trans, chain, pairs=False)[1]
        new_right, new_left = send(belief[left] - to_left, False), send(belief[right] - to_right, True)
        moved = max(np.abs(new_right - to_right).max(initial=0), np.abs(new_left - to_left).max(initial=0))
        to_right, to_left = new_right, new_left
        now = unary.copy()
        np.add.at(now, right, to_right)
        np.add.at(now, left, to_left)
        if moved < 1e-3:
            break
    return now, to_left, to_right


def loopy(unary: np.ndarray, trans: np.ndarray, chain: Chain, edges: np.ndarray, skip: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Unary scores after message passing; ends when no message moves any more, at the latest after ``rounds``."""
    return messages(unary, trans, chain, edges, skip, rounds)[0] if len(edges) else unary


#: Log potential of a transition that cannot be.
NEVER = -30.0


def legal(n_labels: int) -> np.ndarray:
    """Zero, or ``NEVER`` where a continue label follows neither begin nor continue of its kind."""
    out = np.zeros((n_labels, n_labels))
    for go in range(2, n_labels, 2):
        out[:, go] = NEVER
        out[[go - 1, go], go] = 0.0
    return out


def certain(unary: np.ndarray, trans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Tokens that have label 0 on every best path, proven token by token.

    Labels are 0, then begin and continue of each kind, in legal order. Take
    any path that labels the token otherwise: give it 0 instead and, if the
    next token continued the piece, let that one begin it. What this can cost
    at most, over all neighbours, is compared with what label 0 gains. A
    neighbour that is proven itself leaves fewer ways, so the proof is
    repeated. ``starts`` and ``ends`` mark the first and last token of each chain.
    """
    k = len(trans)
    begin, go = np.arange(1, k, 2), np.arange(2, k, 2)
    plain = np.r_[0, begin]
    y = np.arange(1, k)
    into_any = np.maximum(0.0, np.where(trans[:, 1:] > NEVER / 2, trans[:, 1:] - trans[:, :1], -np.inf).max(axis=0))
    into_zero = np.where(y % 2 == 1, trans[0, 1:] - trans[0, 0], -np.inf)
    into_none = np.where(y % 2 == 1, 0.0, -np.inf)
    out_any = np.maximum(0.0, (trans[1:][:, plain] - trans[:1, plain]).max(axis=1))
    out_zero = trans[1:, 0] - trans[0, 0]
    follow = np.where(trans[go] > NEVER / 2, trans[go] - trans[begin], -np.inf)
    own = np.repeat(np.arange(len(go)), 2)
    cut = trans[y, go[own]] - trans[0, begin[own]] + np.maximum(0.0, follow.max(axis=1))[own]
    into_any, into_zero, into_none, out_any, out_zero, cut = (x.astype(unary.dtype) for x in (into_any, into_zero, into_none, out_any, out_zero, cut))
    last = len(unary) - 1
    # first by one number for all labels; label by label over all tokens, which is fast
    u = np.ascontiguousarray(unary.T)
    most, ahead = u[1].copy(), u[2] - u[1]
    for k in range(2, len(u)):
        np.maximum(most, u[k], out=most)
    for k in range(3, len(u), 2):
        # how much better a token continues a kind than begins it
        np.maximum(ahead, u[k + 1] - u[k], out=ahead)
    sure = np.zeros(len(unary), bool)
    sure[:-1] = (u[0] - most)[:-1] > into_any.max() + np.maximum(out_any.max(), cut.max() + ahead[1:])
    todo = np.flatnonzero(~sure)
    later = u[:, np.minimum(todo + 1, last)]
    more_any = cut[:, None] + (later[go] - later[begin])[own]
    gain = u.take(todo, axis=1)
    gain = gain[0] - gain[1:]
    begins, stops = starts[todo], ends[todo]
    into_any, into_zero, into_none, out_any, out_zero = (x[:, None] for x in (into_any, into_zero, into_none, out_any, out_zero))
    for _ in range(rounds):
        before, after = sure.take(np.maximum(todo - 1, 0)), sure.take(np.minimum(todo + 1, last))
        into = np.where(begins, into_none, np.where(before, into_zero, into_any))
        more = np.where(stops | after, -np.inf, more_any)
        out = np.where(stops, 0.0, np.where(after, out_zero, out_any))
        new = (gain > into + np.maximum(out, more)).all(axis=0)
        if not new.any():
            break
        sure[todo[new]] = True
        rest = np.flatnonzero(~new)
        todo, gain, more_any, begins, stops = todo.take(rest), gain.take(rest, axis=1), more_any.take(rest, axis=1), begins.take(rest), stops.take(rest)
    return sure
