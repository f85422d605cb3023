"""A small gated recurrent network over word symbols with a class-factored output, in numpy.

Symbols are numbered by frequency; symbol s is word s % WIDTH of class s // WIDTH, and
log P(s | state) = log P(class | state) + log P(word | class, state). The output biases start at the
symbols' own frequencies and the other output weights at zero, so an untrained network is the unigram model.

Documents run in lanes: the state is carried from window to window and reset where a document begins. For scoring each
lane is a queue of whole documents, and lanes that are done drop out. For training the documents are one stream that is cut into strips of
equal length, so that a long document does not leave the other lanes idle; a document that a cut divides goes on in the next lane from the symbol
before, with a fresh state.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, fields

import numpy as np

WIDTH = 64
FLOAT = np.float32


@dataclass
class Network:
    inputs: np.ndarray  # (symbols, 3 * hidden): embedding, already multiplied into the gates
    gates: np.ndarray  # (hidden, 3 * hidden): update, reset, candidate
    class_out: np.ndarray  # (hidden, classes)
    class_bias: np.ndarray
    word_out: np.ndarray  # (classes, hidden, WIDTH)
    word_bias: np.ndarray  # (classes, WIDTH); -inf-like where a class has no such word

    @staticmethod
    def untrained(counts: np.ndarray, hidden: int, seed: int = 0) -> Network:
        """``counts``: how often each symbol occurs (all positive)."""
        rng = np.random.default_rng(seed)
        classes = -(-len(counts) // WIDTH)
        table = np.zeros(classes * WIDTH)
        table[: len(counts)] = counts
        table = table.reshape(classes, WIDTH)
        with np.errstate(divide="ignore"):
            word_bias = np.maximum(np.log(table / table.sum(axis=1, keepdims=True)), -60)
        return Network(
            (rng.normal(size=(len(counts), 3 * hidden)) * 0.1).astype(FLOAT),
            (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(FLOAT),
            np.zeros((hidden, classes), FLOAT),
            np.log(table.sum(axis=1) / table.sum()).astype(FLOAT),
            np.zeros((classes, hidden, WIDTH), FLOAT),
            word_bias.astype(FLOAT),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Network:
        """A network of this one's shapes with the weights in ``flat``."""
        ends = np.cumsum([a.size for a in self.arrays()])
        return Network(*(np.array(x, FLOAT).reshape(a.shape) for x, a in zip(np.split(flat, ends[:-1]), self.arrays(), strict=True)))


@dataclass
class Lanes:
    """Documents dealt to lanes, the longest lane first; columns of ``inputs`` and the rest are lanes."""

    inputs: np.ndarray  # (steps, lanes): the symbol before
    targets: np.ndarray
    begins: np.ndarray  # whether a document begins here
    document: np.ndarray
    lengths: np.ndarray  # (lanes,), falling


def queues(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents of ``sizes`` dealt to lanes, longest first, each to the lane that has least so far; the longest lane first."""
    heap = [(0, i) for i in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        length, lane = heap[0]
        out[lane].append(d)
        heapq.heapreplace(heap, (length + int(sizes[d]), lane))
    return sorted(out, key=lambda q: -sizes[q].sum())


def dealt(documents: list[np.ndarray], lanes: int, start_symbol: int) -> Lanes:
    """Deal documents (arrays of symbols, none empty) to lanes."""
    sizes = np.array([len(d) for d in documents])
    dealing = queues(sizes, lanes)
    lengths = np.array([sizes[q].sum() for q in dealing])
    shape = (lengths[0], len(dealing))
    out = Lanes(np.full(shape, start_symbol, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool), np.zeros(shape, np.int32), lengths)
    for lane, queue in enumerate(dealing):
        at = 0
        for d in queue:
            n = len(documents[d])
            out.targets[at : at + n, lane] = documents[d]
            out.inputs[at + 1 : at + n, lane] = documents[d][:-1]
            out.begins[at, lane] = True
            out.document[at : at + n, lane] = d
            at += n
    return out


def strips(documents: list[np.ndarray], lanes: int, start_symbol: int) -> Lanes:
    """All documents one after the other, cut into at most ``lanes`` strips of equal length (the last may be shorter)."""
    targets = np.concatenate(documents).astype(np.int32)
    sizes = np.array([len(d) for d in documents])
    begins = np.zeros(len(targets), bool)
    begins[np.cumsum(sizes) - sizes] = True
    inputs = np.where(begins, start_symbol, np.roll(targets, 1)).astype(np.int32)
    steps = -(-len(targets) // lanes)
    count = -(-len(targets) // steps)
    lengths = np.full(count, steps)
    lengths[-1] = len(targets) - steps * (count - 1)

    def cut(stream: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.append(stream, np.zeros(steps * count - len(stream), stream.dtype)).reshape(count, steps).T)

    return Lanes(cut(inputs), cut(targets), cut(begins), cut(np.repeat(np.arange(len(documents), dtype=np.int32), sizes)), lengths)


@dataclass
class Cell:
    """The recurrent weights by gate, each gate's in one piece; those of update and reset negated, as their sigmoid is 1 / (1 + exp(-x))."""

    inputs: np.ndarray  # (3, symbols, hidden)
    gates: np.ndarray  # (3, hidden, hidden)

    @staticmethod
    def of(net: Network) -> Cell:
        cell = Cell(by_gate(net.inputs), by_gate(net.gates))
        for a in (cell.inputs, cell.gates):
            np.negative(a[:2], out=a[:2])
        return cell


def by_gate(a: np.ndarray) -> np.ndarray:
    """(rows, 3 * hidden) as (3, rows, hidden)."""
    return np.ascontiguousarray(a.reshape(len(a), 3, -1).transpose(1, 0, 2))


@dataclass
class Kept:
    """What the way back needs of a window: the state before (steps, lanes, hidden), and by gate, (3, steps, lanes, hidden), the update and
    reset gates and the candidate, and the state's part of them."""

    before: np.ndarray
    zrn: np.ndarray
    u: np.ndarray

    @staticmethod
    def room(shape: tuple[int, ...]) -> Kept:
        return Kept(np.empty(shape, FLOAT), np.empty((3, *shape), FLOAT), np.empty((3, *shape), FLOAT))


def forward(net: Network, lanes: Lanes, first: int, steps: int, state: np.ndarray, keep: Kept | None = None) -> np.ndarray:
    """States (steps, lanes, hidden) after each step of a window; ``keep`` takes what the way back needs."""
    n_lanes, h = state.shape
    here = (slice(first, first + steps), slice(0, n_lanes))
    flat = None if keep is None else Kept(keep.before.reshape(-1, h), keep.zrn.reshape(3, -1, h), keep.u.reshape(3, -1, h))
    return _run(Cell.of(net), lanes.inputs[here].ravel(), lanes.begins[here].ravel(), [n_lanes] * steps, state, flat).reshape(steps, n_lanes, h)


def _run(cell: Cell, symbols: np.ndarray, begins: np.ndarray, active: list[int], state: np.ndarray, keep: Kept | None = None) -> np.ndarray:
    """States (places, hidden) after each of a row of steps that lie one after the other, step i with the first ``active[i]`` lanes. ``keep``
    has its arrays' steps and lanes as one."""
    h = state.shape[1]
    states = np.empty((len(symbols), h), FLOAT)
    inputs = np.empty((3, len(symbols), h), FLOAT) if keep is None else keep.zrn
    for g in range(3):
        np.take(cell.inputs[g], symbols, axis=0, out=inputs[g], mode="clip")
    resets = np.flatnonzero(begins)
    ends = np.cumsum(active)
    of_step = np.searchsorted(resets, [0, *ends]).tolist()
    room, moved, one, a = np.empty((3, active[0], h), FLOAT), np.empty((active[0], h), FLOAT), FLOAT(1), 0
    for t, b in enumerate(ends.tolist()):
        n = b - a
        before = state[:n]
        if keep is not None:
            keep.before[a:b] = before
            before = keep.before[a:b]
        if of_step[t] < of_step[t + 1]:
            if keep is None:
                before = before.copy()
            before[resets[of_step[t] : of_step[t + 1]] - a] = 0
        u = room[:, :n] if keep is None else keep.u[:, a:b]
        np.matmul(before, cell.gates, out=u)
        zr, candidate, r_u, state = inputs[:2, a:b], inputs[2, a:b], moved[:n], states[a:b]
        zr += u[:2]
        np.exp(zr, out=zr)
        zr += one
        np.divide(one, zr, out=zr)
        np.multiply(zr[1], u[2], out=r_u)
        candidate += r_u
        np.tanh(candidate, out=candidate)
        np.subtract(before, candidate, out=state)
        state *= zr[0]
        state += candidate
        a = b
    return states


def _with_one(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in ``order``, and a last column of ones, the biases' input."""
    out = np.empty((len(order), states.shape[1] + 1), FLOAT)
    out[:, :-1] = states.take(order, axis=0)
    out[:, -1] = 1
    return out


def _exponentials(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log softmax of each row at its target, the places of the targets in the whole, and the rows' sums of exponentials, which ``logits`` become."""
    if logits.max(initial=0) > 80:  # else no exponential overflows
        logits -= logits.max(axis=1, keepdims=True)
    at = np.arange(0, logits.size, logits.shape[1]) + targets
    chosen = logits.ravel().take(at)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return chosen - np.log(total), at, total


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of ``targets`` by class, their classes and words in this order, and each class's (class, from, to)."""
    classes = targets // WIDTH
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    words = (targets - classes * WIDTH).take(order)
    classes = classes.take(order)
    starts = [0, *(np.flatnonzero(classes[1:] != classes[:-1]) + 1).tolist()]
    return order, classes, words, list(zip(classes[starts].tolist(), starts, [*starts[1:], len(targets)], strict=True))


def _output(scorer: Scorer, states: np.ndarray, targets: np.ndarray, by_class: np.ndarray, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of ``targets`` and the gradients of their negated sum towards the states. ``by_class`` and ``by_word``, zeros,
    become those towards the weights."""
    order, classes, words, parts = _by_class(targets)
    own, h = _with_one(states, order), states.shape[1]

    # A logit's gradient is its exponential less, at the target, the row's sum, all over that sum; the division is done on the narrow side.
    d = own @ scorer.class_out
    found, at, total = _exponentials(d, classes)
    d.ravel()[at] -= total
    share = (1 / total)[:, None]
    left = own * share
    for a in range(0, len(own), 512):  # a product over few rows at a time is faster
        by_class += left[a : a + 512].T @ d[a : a + 512]
    towards = d @ np.ascontiguousarray(scorer.class_out[:h].T)
    towards *= share

    d = d if d.shape[1] == WIDTH else np.empty((len(order), WIDTH), FLOAT)
    for c, a, b in parts:
        np.dot(own[a:b], scorer.word_out[c], out=d[a:b])
    score, at, total = _exponentials(d, words)
    found += score
    d.ravel()[at] -= total
    share = (1 / total)[:, None]
    own *= share
    back, turned = np.empty_like(towards), np.ascontiguousarray(scorer.word_out[:, :h].transpose(0, 2, 1))
    for c, a, b in parts:
        np.dot(own[a:b].T, d[a:b], out=by_word[c])
        np.dot(d[a:b], turned[c], out=back[a:b])
    back *= share
    towards += back
    scores = np.empty_like(found)
    scores[order], back[order] = found, towards
    return scores, back


@dataclass
class Scorer:
    """The output layer with the biases as rows of the weights. Called, it computes only what the targets' scores need."""

    class_out: np.ndarray  # (hidden + 1, classes)
    word_out: np.ndarray  # (classes, hidden + 1, WIDTH)

    @staticmethod
    def of(net: Network) -> Scorer:
        return Scorer(np.vstack([net.class_out, net.class_bias[None]]), np.concatenate([net.word_out, net.word_bias[:, None]], axis=1))

    def __call__(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        order, classes, words, parts = _by_class(targets)
        own = _with_one(states, order)
        logits = own @ self.class_out
        found = _exponentials(logits, classes)[0]
        if logits.shape[1] != WIDTH:
            logits = np.empty((len(order), WIDTH), FLOAT)
        for c, a, b in parts:
            np.dot(own[a:b], self.word_out[c], out=logits[a:b])
        scores = np.empty(len(order), FLOAT)
        scores[order] = found + _exponentials(logits, words)[0]
        return scores


def document_scores(net: Network, documents: list[np.ndarray], start_symbol: int, lanes: int = 512, window: int = 8) -> np.ndarray:
    """Natural log probability of each whole document (arrays of symbols). The steps of the lanes lie one after the other, each with the
    lanes that go on so far, so that a long document takes no room in the lanes that are done; about ``lanes * window`` tokens are scored together."""
    if not documents:
        return np.zeros(0)
    sizes = np.array([len(d) for d in documents])
    dealing = queues(sizes, lanes)
    order = np.concatenate(dealing)
    lengths = np.array([sizes[q].sum() for q in dealing])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]))  # lanes longer than a step's number
    ends = np.cumsum(active)
    by_lane = np.concatenate([documents[d] for d in order]).astype(np.int32)
    begins = np.cumsum(sizes[order]) - sizes[order]
    place = np.concatenate([(ends - active)[:n] + lane for lane, n in enumerate(lengths)])
    targets, inputs, fresh = np.empty_like(by_lane), np.empty_like(by_lane), np.zeros(len(by_lane), bool)
    targets[place] = by_lane
    inputs[place[1:]] = by_lane[:-1]
    inputs[place[begins]] = start_symbol
    fresh[place[begins]] = True

    scorer, cell = Scorer.of(net), Cell.of(net)
    scores, state = np.empty(len(by_lane)), np.zeros((len(lengths), net.gates.shape[0]), FLOAT)
    step = first = 0
    while step < len(active):
        to = max(step + 1, int(np.searchsorted(ends, first + lanes * window, "right")))
        end = int(ends[to - 1])
        states = _run(cell, inputs[first:end], fresh[first:end], active[step:to].tolist(), state)
        scores[first:end] = scorer(states, targets[first:end])
        state, step, first = states[len(states) - active[to - 1] :], to, end
    total = np.empty(len(documents))
    total[order] = np.add.reduceat(scores[place], begins)
    return total


@dataclass
class Layout:
    """A network's weights, or gradients towards them, as training holds them: all but the inputs in one array, of which the others are views."""

    cell: Cell
    scorer: Scorer
    dense: np.ndarray

    @staticmethod
    def zeros(inputs: int, hidden: int, classes: int) -> Layout:
        shapes = (3, hidden, hidden), (hidden + 1, classes), (classes, hidden + 1, WIDTH)
        ends = np.cumsum([math.prod(x) for x in shapes])
        dense = np.zeros(ends[-1], FLOAT)
        gates, class_out, word_out = (x.reshape(shape) for x, shape in zip(np.split(dense, ends[:-1]), shapes, strict=True))
        return Layout(Cell(np.zeros((3, inputs, hidden), FLOAT), gates), Scorer(class_out, word_out), dense)

    @staticmethod
    def of(net: Network) -> Layout:
        out = Layout.zeros(len(net.inputs), *net.class_out.shape)
        cell, scorer = Cell.of(net), Scorer.of(net)
        out.cell.inputs, out.cell.gates[:] = cell.inputs, cell.gates
        out.scorer.class_out[:], out.scorer.word_out[:] = scorer.class_out, scorer.word_out
        return out

    def into(self, net: Network) -> None:
        for to, a in ((net.inputs, self.cell.inputs), (net.gates, self.cell.gates)):
            parts = to.reshape(len(to), 3, -1).transpose(1, 0, 2)
            parts[:2], parts[2] = -a[:2], a[2]
        net.class_out[:], net.class_bias[:] = self.scorer.class_out[:-1], self.scorer.class_out[-1]
        net.word_out[:], net.word_bias[:] = self.scorer.word_out[:, :-1], self.scorer.word_out[:, -1]


def window_gradient(net: Network, lanes: Lanes, first: int, steps: int, state: np.ndarray) -> tuple[float, Network, np.ndarray]:
    """Loss and gradients over one window, truncated at its start, and the state to carry on."""
    loss, grads, seen, state = _window(Layout.of(net), lanes, first, steps, state)
    inputs = np.zeros((3, *(len(net.inputs), net.gates.shape[0])), FLOAT)
    inputs[:, seen] = grads.cell.inputs
    grads.cell.inputs = inputs
    out = Network(*(np.empty(a.shape, FLOAT) for a in net.arrays()))
    grads.into(out)
    return loss, out, state


def _window(weights: Layout, lanes: Lanes, first: int, steps: int, state: np.ndarray) -> tuple[float, Layout, np.ndarray, np.ndarray]:
    """As ``window_gradient``, but the gradients of the inputs are those of the window's symbols alone, which are returned as well."""
    cell, (n_lanes, h) = weights.cell, state.shape
    grads = Layout.zeros(0, h, weights.scorer.class_out.shape[1])
    here, whole = (slice(first, first + steps), slice(0, n_lanes)), (steps, n_lanes, h)
    kept = Kept.room((steps * n_lanes, h))
    symbols, begins = lanes.inputs[here].ravel(), lanes.begins[here]
    states = _run(cell, symbols, begins.ravel(), [n_lanes] * steps, state, kept)
    scores, back = _output(weights.scorer, states, lanes.targets[here].ravel(), grads.scorer.class_out, grads.scorer.word_out)

    # A step's gates have the state's gradient times these: all but the recursion is done for the whole window. Update and reset are
    # those of ``Cell``, the negated ones.
    (z, r, n), un = kept.zrn, kept.u[2]
    slopes = kept.zrn[:2] - 1
    by_n = (n * n - 1) * slopes[0]
    slopes *= kept.zrn[:2]
    du = np.empty((3, steps * n_lanes, h), FLOAT)
    np.subtract(kept.before, n, out=du[0])
    np.multiply(by_n, un, out=du[1])
    du[:2] *= slopes
    np.multiply(by_n, r, out=du[2])
    after, parts = np.zeros_like(state), np.empty((3, n_lanes, h), FLOAT)
    resets = begins.any(axis=1).tolist()
    gates = np.ascontiguousarray(cell.gates.transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        a, b = t * n_lanes, (t + 1) * n_lanes
        dh, own = back[a:b], du[:, a:b]
        dh += after
        own *= dh
        np.matmul(own, gates, out=parts)
        np.multiply(dh, z[a:b], out=after)
        after += parts[0]
        after += parts[1]
        after += parts[2]
        if resets[t]:
            after[begins[t]] = 0
    np.matmul(kept.before.T, du, out=grads.cell.gates)
    np.multiply(back, by_n, out=du[2])
    order = np.argsort(symbols.astype(np.uint16) if cell.inputs.shape[1] <= 1 << 16 else symbols, kind="stable")
    ordered = symbols.take(order)
    starts = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
    grads.cell.inputs = np.stack([_sums(g.take(order, axis=0), starts) for g in du])
    return float(-scores.sum()), grads, ordered[starts], states.reshape(whole)[-1]


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows. Pairs of numbers are added as complex ones, which takes half the time."""
    if rows.dtype != np.float32 or rows.shape[1] % 2:
        return np.add.reduceat(rows, starts)
    return np.add.reduceat(rows.view(np.complex64), starts).view(np.float32)


def train(net: Network, documents: list[np.ndarray], start_symbol: int, history: list[np.ndarray] | None = None, rate: float = 0.1, lanes: int = 128, window: int = 32) -> list[np.ndarray]:
    """One pass of truncated backpropagation with Adagrad over ``documents``, changing ``net``. Returns the history of
    squared gradients, to go on with. Documents are learned from whole, in strips."""
    weights = Layout.of(net)
    history = history or [np.full(a.shape, 1e-4, FLOAT) for a in (weights.cell.inputs, weights.dense)]
    if not documents:
        return history
    own = strips(documents, lanes, start_symbol)
    state, first = np.zeros((len(own.lengths), net.gates.shape[0]), FLOAT), 0
    while first < own.lengths[0]:
        active = int(np.searchsorted(-own.lengths, -first))
        steps = int(min(window, own.lengths[active - 1] - first))
        _, grads, seen, state = _window(weights, own, first, steps, state[:active])
        share = FLOAT(1 / max(steps * active, lanes))
        history[1] += _step(grads.dense, history[1], share, rate)
        weights.dense -= grads.dense
        for inputs, squares, g in zip(weights.cell.inputs, history[0], grads.cell.inputs, strict=True):
            own_squares = squares.take(seen, axis=0)  # other symbols' gradients are zero and change nothing
            own_squares += _step(g, own_squares, share, rate)
            squares[seen] = own_squares
            inputs[seen] = np.subtract(inputs.take(seen, axis=0), g, out=g)
        first += steps
    weights.into(net)
    return history


def _step(g: np.ndarray, squares: np.ndarray, share: np.floating, rate: float) -> np.ndarray:
    """Turns gradients times ``share`` into Adagrad's steps and returns their squares, which are still to be added to ``squares``."""
    g *= share
    more = g * g
    scale = squares + more
    np.sqrt(scale, out=scale)
    g /= scale
    g *= FLOAT(rate)
    return more
