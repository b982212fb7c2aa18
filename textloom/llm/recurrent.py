"""A gated recurrent network over word ids, in numpy: forward passes with carried state, truncated backpropagation.

The output is factored by classes: ids are numbered by falling frequency and cut into classes of equal size, so a
token costs one softmax over classes and one over the ids of its class. Documents lie end to end in parallel streams;
the state is carried from window to window and set to zero where a document begins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Steps of a window; streams that are trained or scored at once; the size of a step and where its measure starts; steps for
#: which streams are made fewer where there are few tokens.
WINDOW, STREAMS, RATE, START, STEPS = 32, 128, 0.1, 1e-6, 200
#: Logits up to which their exponents need no shift.
FAR = 60.0
#: Tokens whose logits are held at once, but for those of one class.
HELD = 4096


@dataclass
class Network:
    """``embed`` (ids, 3h), ``recur`` (h, 3h), ``shift`` (3h); ``to_class`` (h, c), ``class_bias``; ``to_word`` (c * size, h), ``word_bias``."""

    embed: np.ndarray
    recur: np.ndarray
    shift: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    NAMES = ("embed", "recur", "shift", "to_class", "class_bias", "to_word", "word_bias")

    @classmethod
    def new(cls, counts: np.ndarray, hidden: int, seed: int) -> Network:
        """A network that, whatever the context, gives each id its share of ``counts``, which fall."""
        rng = np.random.default_rng(seed)
        n = len(counts)
        size = int(np.ceil(np.sqrt(n)))
        classes = -(-n // size)
        share = np.zeros(classes * size)
        share[:n] = (counts + 0.5) / (counts + 0.5).sum()
        total = share.reshape(classes, size).sum(axis=1)
        inside = np.full(classes * size, -1e4)
        inside[:n] = np.log(share[:n] / np.repeat(total, size)[:n])
        normal = lambda scale, *shape: rng.standard_normal(shape) * scale
        made = (
            normal(0.3, n, 3 * hidden), normal(0.5 / np.sqrt(hidden), hidden, 3 * hidden), np.zeros(3 * hidden), normal(0.05, hidden, classes),
            np.log(total), normal(0.05, classes * size, hidden), inside,
        )
        return cls(*[x.astype(np.float32) for x in made])

    @property
    def size(self) -> int:
        return len(self.word_bias) // len(self.class_bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def filled(self, flat: np.ndarray) -> Network:
        """A network of this shape with the numbers ``flat``."""
        parts, at = [], 0
        for n in self.NAMES:
            x = getattr(self, n)
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*parts)


def streams(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``docs`` end to end in up to ``most`` streams of like length: ids (steps, streams), the document of each, lengths.

    Streams come by falling length; places behind a stream's end have document -1.
    """
    n = max(1, min(most, len(docs)))
    heap, of = [(0, s) for s in range(n)], [[] for _ in range(n)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        held, s = heap[0]
        of[s].append(d)
        heapq.heapreplace(heap, (held + len(docs[d]), s))
    of.sort(key=lambda each: -sum(len(docs[d]) for d in each))
    lengths = np.array([sum(len(docs[d]) for d in each) for each in of])
    ids, owner = np.zeros((int(lengths.max(initial=0)), n), dtype=np.int32), np.full((int(lengths.max(initial=0)), n), -1, dtype=np.int32)
    for s, each in enumerate(of):
        if each:
            ids[: lengths[s], s] = np.concatenate([docs[d] for d in each])
            owner[: lengths[s], s] = np.repeat(each, [len(docs[d]) for d in each])
    return ids, owner, lengths


def _chosen(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of the share that ``at`` has in each row; ``logits`` become their exponents, whose sums come second."""
    if logits.max(initial=0) > FAR:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], dtype=logits.dtype)
    return own - np.log(total), total


def forward(net: Network, before: np.ndarray, keep: np.ndarray, state: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step (steps, streams, h), and the last; ``before``: the ids that come in, ``keep``: 0 where a document begins.

    ``tape`` gets, for all steps, the states before, the gates with the new values, and what the states gave those; in
    these the streams come last, as they do inside.
    """
    h = net.recur.shape[0]
    x, recur, shift = np.ascontiguousarray(net.embed[before].transpose(0, 2, 1)), net.recur.T.copy(), net.shift[:, None].copy()
    x += shift
    # A gate is (tanh(x / 2) + 1) / 2.
    x[:, : 2 * h] *= 0.5
    recur[: 2 * h] *= 0.5
    out = np.empty((len(before), h, before.shape[1]), dtype=x.dtype)
    # Without a tape one step's place is used again.
    held = len(before) if tape is not None else 1
    olds, given, state = np.empty((held, *out.shape[1:]), dtype=x.dtype), np.empty((held, *x.shape[1:]), dtype=x.dtype), state.T
    for t in range(len(before)):
        old = np.multiply(state, keep[t], out=olds[t % held])
        u = np.matmul(recur, old, out=given[t % held])
        gates, new = x[t, : 2 * h], x[t, 2 * h :]
        gates += u[: 2 * h]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new += gates[h:] * u[2 * h :]
        np.tanh(new, out=new)
        state = np.subtract(old, new, out=out[t])
        state *= gates[:h]
        state += new
    if tape is not None:
        tape.extend((olds, x, given[:, 2 * h :]))
    return np.ascontiguousarray(out.transpose(0, 2, 1)), state.T


def log_probs(net: Network, states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The natural logarithm of each target's probability after its state; ``grads`` gets the slopes of -sum, and that by the states comes second."""
    size, n, (h, groups) = net.size, len(targets), net.to_class.shape
    classes = targets // size
    # Of two bytes, which are sorted in linear time.
    order = np.argsort(classes.astype(np.uint16) if groups < 1 << 16 else classes, kind="stable")
    classes, own = classes[order], (targets % size)[order]
    kind = np.result_type(states, net.to_word)
    # Biases are weights of a state that is 1.
    given = np.ones((n, h + 1), dtype=kind)
    given[:, :h] = states[order]
    to_class, to_word = np.vstack([net.to_class, net.class_bias]), np.column_stack([net.to_word, net.word_bias])
    found = np.empty(n, dtype=kind)
    if grads is not None:
        slope, by_class, by_word = np.empty((n, h), dtype=kind), np.zeros_like(to_class), np.zeros_like(to_word)
    ends = np.searchsorted(classes, np.arange(groups + 1))
    stop = 0
    while stop < groups:
        # Classes with up to so many tokens, one at least.
        first, stop = stop, max(stop + 1, int(np.searchsorted(ends, ends[stop] + HELD, side="right")) - 1)
        start, count = int(ends[first]), int(ends[stop] - ends[first])
        if not count:
            continue
        some, at = slice(start, start + count), np.arange(count)
        cuts = (ends[first : stop + 1] - start).tolist()
        spans = [(slice(a, b), slice(c * size, (c + 1) * size)) for c, a, b in zip(range(first, stop), cuts, cuts[1:]) if a < b]
        x, place = given[some], np.empty(count * max(groups, size), dtype=kind)
        logits = np.matmul(x, to_class, out=place[: count * groups].reshape(count, groups))
        got, total = _chosen(logits, classes[some])
        if grads is not None:
            # Shares less 1 for the target, times the total, by which the narrower states are divided instead.
            logits[at, classes[some]] -= total
            share = (1 / total)[:, None]
            by_class += (x * share).T @ logits
            back = logits @ net.to_class.T
            back *= share
        inside = place[: count * size].reshape(count, size)
        for part, span in spans:
            np.matmul(x[part], to_word[span].T, out=inside[part])
        more, total = _chosen(inside, own[some])
        found[order[some]] = got + more
        if grads is not None:
            inside[at, own[some]] -= total
            share = (1 / total)[:, None]
            scaled, sloped = x * share, slope[some]
            for part, span in spans:
                np.matmul(inside[part].T, scaled[part], out=by_word[span])
                np.matmul(inside[part], net.to_word[span], out=sloped[part])
            sloped *= share
            sloped += back
    if grads is None:
        return found, None
    grads["to_class"], grads["class_bias"] = by_class[:h], by_class[h]
    grads["to_word"], grads["word_bias"] = np.ascontiguousarray(by_word[:, :h]), by_word[:, h].copy()
    back = np.empty_like(slope)
    back[order] = slope
    return found, back


def windows(ids: np.ndarray, owner: np.ndarray, lengths: np.ndarray, first: int, size: int = WINDOW, tokens: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """For each window of ``size`` steps: ids that come in, 0 where a document begins, targets, documents; of the streams that go on.

    Windows of few streams are as long as makes about ``tokens`` of them.
    """
    begins = np.ones(owner.shape, dtype=bool)
    begins[1:] = owner[1:] != owner[:-1]
    stop = 0
    while stop < len(ids):
        at, live = stop, int((lengths > stop).sum())
        stop = min(at + max(size, tokens // live), len(ids))
        some = slice(at, stop)
        before = np.full((some.stop - at, live), first, dtype=np.int32)
        before[1:] = ids[at : some.stop - 1, :live]
        if at:
            before[0] = ids[at - 1, :live]
        new = begins[some, :live]
        before[new] = first
        yield before, (~new).astype(np.float32), ids[some, :live], owner[some, :live]


def score(net: Network, docs: list[np.ndarray], first: int, most: int = 4 * STREAMS) -> np.ndarray:
    """The natural logarithm of each document's probability; every document is scored whole."""
    found = np.zeros(len(docs))
    ids, owner, lengths = streams(docs, most)
    state = np.zeros((ids.shape[1], net.recur.shape[0]), dtype=np.float32)
    # Windows change no score; shorter ones stay in a core's cache.
    for before, keep, targets, of in windows(ids, owner, lengths, first, WINDOW // 2, WINDOW // 2 * most):
        states, state = forward(net, before, keep, state[: before.shape[1]])
        there = of >= 0
        got, _ = log_probs(net, states[there], targets[there])
        found += np.bincount(of[there], weights=got, minlength=len(docs))
    return found


def gradients(net: Network, before: np.ndarray, keep: np.ndarray, targets: np.ndarray, there: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
    """Slopes of the mean loss over one window, by backpropagation to its begin; the rows of ``embed`` that its slopes are of; the last state; the loss's sum."""
    grads: dict[str, np.ndarray] = {}
    tape: list = []
    states, state = forward(net, before, keep, state, tape)
    if there.all():
        got, slope = log_probs(net, states.reshape(there.size, -1), targets.ravel(), grads)
    else:
        got, own = log_probs(net, states[there], targets[there], grads)
        slope = np.zeros((*there.shape, own.shape[1]), dtype=own.dtype)
        slope[there] = own
    slope = np.ascontiguousarray(slope.reshape(*there.shape, -1).transpose(0, 2, 1))
    h = net.recur.shape[0]
    old, x, u = tape
    z, r, new = x[:, :h], x[:, h : 2 * h], x[:, 2 * h :]
    # What a state's slope is multiplied by for the slopes of both gates and of the new value.
    rest = 1 - z
    inner = 1 - new * new
    inner *= rest
    through = np.empty((len(before), 3, *slope.shape[1:]), dtype=slope.dtype)
    np.multiply(inner, r, out=through[:, 2])
    np.multiply(through[:, 2], u, out=through[:, 1])
    through[:, 1] *= 1 - r
    np.subtract(old, new, out=through[:, 0])
    through[:, 0] *= z
    through[:, 0] *= rest
    by_gate = through.reshape(len(before), 3 * h, -1)
    carried = np.zeros(slope.shape[1:], dtype=slope.dtype)
    for t in range(len(before) - 1, -1, -1):
        d = slope[t]
        d += carried
        through[t] *= d
        carried = net.recur @ by_gate[t]
        carried += d * z[t]
        carried *= keep[t]
    grads["recur"] = np.matmul(old, by_gate.transpose(0, 2, 1)).sum(axis=0)
    np.multiply(slope, inner, out=through[:, 2])
    flat = np.ascontiguousarray(by_gate.transpose(0, 2, 1)).reshape(-1, 3 * h)
    grads["shift"] = np.ones(len(flat), dtype=flat.dtype) @ flat
    ids = before.ravel()
    order = np.argsort(ids.astype(np.uint16) if len(net.embed) < 1 << 16 else ids, kind="stable")
    held = ids[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1])
    grads["embed"] = np.add.reduceat(flat[order], starts, axis=0)
    n = np.float32(max(1, int(there.sum())))
    for g in grads.values():
        g /= n
    return grads, held[starts], state, -float(got.sum())


def train(net: Network, docs: list[np.ndarray], first: int, held: dict[str, np.ndarray], rate: float = RATE) -> float:
    """One pass over ``docs``, a step after each window by the root of summed squares in ``held``; the loss's sum.

    Few tokens go in few streams, so that there are some ``STEPS`` steps.
    """
    most = int(np.clip(sum(map(len, docs)) // (WINDOW * STEPS), 4, STREAMS))
    ids, owner, lengths = streams(docs, most)
    state, loss = np.zeros((ids.shape[1], net.recur.shape[0]), dtype=np.float32), 0.0
    for before, keep, targets, of in windows(ids, owner, lengths, first):
        grads, rows, state, own = gradients(net, before, keep, targets, of >= 0, state[: before.shape[1]])
        loss += own
        for n, g in grads.items():
            squares = g * g
            if n == "embed":
                squares += held[n][rows]
                held[n][rows] = squares
            else:
                held[n] += squares
            g *= rate
            g /= np.sqrt(squares if n == "embed" else held[n], out=squares)
            getattr(net, n)[rows if n == "embed" else slice(None)] -= g
    return loss


def fresh(net: Network) -> dict[str, np.ndarray]:
    """Sums of squares before the first step."""
    return {n: np.full_like(getattr(net, n), START) for n in net.NAMES}
