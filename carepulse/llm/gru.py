"""A gated recurrent language model in numpy with class-factored softmax.

Word numbers: 0 is the end (and what stands before a text), 1 any rare word, 2
and up the frequent words by rank.  Numbers 0 and 1 are classes of one member;
the frequent words are dealt by rank to classes of ``CLASS_SIZE``.
P(word) = P(class | state) P(word | class, state)."""

from __future__ import annotations

import heapq

import numpy as np

CLASS_SIZE = 64
LOG10 = float(np.log(10.0))


def lanes(lengths: np.ndarray, width: int, longest_first: bool = True):
    """Deal documents to at most ``width`` lanes, each a stream of whole
    documents (fewer lanes when one document is long: it sets the number of
    steps); returns (first row, lane) of each document and the lanes' rows,
    longest lane first, so that the active lanes of a step are a prefix."""
    width = max(1, min(width, len(lengths), 2 * int(lengths.sum()) // max(1, int(lengths.max(initial=1)))))
    heap = [(0, k) for k in range(width)]
    row, lane = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable") if longest_first else np.arange(len(lengths))
    for d in order.tolist():
        load, k = heapq.heappop(heap)
        row[d], lane[d] = load, k
        heapq.heappush(heap, (load + int(lengths[d]), k))
    loads = np.zeros(width, np.int64)
    for load, k in heap:
        loads[k] = load
    order = np.argsort(-loads, kind="stable")
    place = np.empty(width, np.int64)
    place[order] = np.arange(width)
    return row, place[lane], loads[order]


def pieces(tokens: np.ndarray, lengths: np.ndarray, size: int):
    """(lengths, token before each) of the documents cut to at most ``size``
    tokens, so that lanes are evenly filled in training."""
    n = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    out = np.minimum(size, lengths[doc] - k * size)
    start = np.cumsum(out) - out
    return out, np.where(k > 0, tokens[np.maximum(start - 1, 0)], 0)


def sheet(tokens: np.ndarray, lengths: np.ndarray, width: int, longest_first: bool = True,
          lead: np.ndarray | int = 0):
    """(inputs, targets, documents, active) as rows of time by lanes: the input
    of a position is the token before it, ``lead`` (0) at the start of a
    document, where the state is also reset; unused cells have document -1."""
    row, lane, loads = lanes(lengths, width, longest_first)
    start = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(tokens)) - start[doc]
    t, k = row[doc] + at, lane[doc]
    shape = (int(loads.max(initial=0)), len(loads))
    inputs, targets = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    docs, first = np.full(shape, -1, np.int32), np.zeros(shape, bool)
    targets[t, k], docs[t, k] = tokens, doc
    before = np.empty(len(tokens), np.int64)
    before[1:], before[:1] = tokens[:-1], 0
    before[at == 0] = lead
    inputs[t, k], first[t, k] = before, at == 0
    active = (loads[None, :] > np.arange(shape[0])[:, None]).sum(axis=1)
    return inputs, targets, docs, first, active


def _sigmoid_of_minus(x):
    """In place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _bounds(weights, bias):
    """(least, greatest) logit that states, all within -1 and 1, can give."""
    reach = np.abs(weights).sum(axis=-1)
    return (bias - reach).min(axis=-1), (bias + reach).max(axis=-1)


def _softmax(logits, least, top):
    """exp of the logits in place, less ``top``, and the sums of the rows; no
    logit lies outside ``least`` and ``top``.  One shift for all rows, as a row's
    own takes a slow pass; rows that vanish beside it make it their own."""
    if top - least >= 60:
        top = logits.max()
    logits -= top
    few = logits.max(axis=1) < -60 if top - least >= 60 and float(logits.min(initial=0)) < -60 else None
    kept = logits[few] if few is not None and few.any() else None
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    own = None
    if kept is not None:
        most = kept.max(axis=1, keepdims=True)
        logits[few] = np.exp(kept - most)
        total[few] = logits[few].sum(axis=1)
        own = np.zeros(len(logits), logits.dtype)
        own[few] = most[:, 0]
    return logits, total, top, own


class Gru:
    """Parameters as one float32 vector ``flat`` with named views."""

    def __init__(self, words: int, hidden: int = 16, seed: int = 7, flat: np.ndarray | None = None):
        self.words, self.hidden = words, hidden
        self.blocks = -(-words // CLASS_SIZE)
        self.classes = 2 + self.blocks
        shapes = {"x": (words + 2, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,),
                  "c": (hidden, self.classes), "cb": (self.classes,),
                  "o": (self.blocks, CLASS_SIZE, hidden), "ob": (self.blocks, CLASS_SIZE)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = (rng.standard_normal(size) * 0.1).astype(np.float32)
        self.flat, at = flat, 0
        self.p = {}
        for name, s in shapes.items():
            n = int(np.prod(s))
            self.p[name] = flat[at:at + n].reshape(s)
            at += n

        # members beyond the last word never occur
        self.spare = np.zeros((self.blocks, CLASS_SIZE), np.float32)
        self.spare.reshape(-1)[words:] = -1e9

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < 2, tokens, 2 + (tokens - 2) // CLASS_SIZE)

    def start_from(self, log_words: np.ndarray) -> None:
        """Output biases from log counts by word number (end, rare, words)."""
        self.p["cb"][:2] = log_words[:2]
        inner = np.full(self.blocks * CLASS_SIZE, -30.0, np.float32)
        inner[:self.words] = log_words[2:]
        inner = inner.reshape(self.blocks, CLASS_SIZE)
        top = inner.max(axis=1, keepdims=True)
        self.p["cb"][2:] = (top + np.log(np.exp(inner - top).sum(axis=1, keepdims=True)))[:, 0]
        self.p["ob"][:] = inner
        self.p["cb"] -= self.p["cb"].mean()

    def run(self, inputs, first, active, h, keep: dict | None = None):
        """States of a window; ``keep`` collects what the backward pass needs.
        Returns the states of all active cells, row after row, and the last."""
        p, n = self.p, self.hidden
        ends = np.cumsum(active)
        size = int(ends[-1])
        x = p["x"][np.concatenate([inputs[t, :int(a)] for t, a in enumerate(active)])]
        x += p["b"]
        np.negative(x[:, :2 * n], out=x[:, :2 * n])       # the gates take exp of minus their sums
        h0, zr, c, g, out = (np.empty((size, w * n), self.flat.dtype) for w in (1, 2, 1, 3, 1))
        if keep is not None:
            keep.update(h=h0, zr=zr, c=c, g=g)
        starts = first.any(axis=1).tolist()
        for t in range(len(inputs)):
            a = int(active[t])
            rows = slice(int(ends[t]) - a, int(ends[t]))
            prev, gate, cand, hu, new = h0[rows], zr[rows], c[rows], g[rows], out[rows]
            np.copyto(prev, h[:a])
            if starts[t]:
                prev[first[t, :a]] = 0
            np.matmul(prev, p["u"], out=hu)
            np.subtract(x[rows, :2 * n], hu[:, :2 * n], out=gate)
            _sigmoid_of_minus(gate)
            np.multiply(gate[:, n:], hu[:, 2 * n:], out=cand)
            cand += x[rows, 2 * n:]
            np.tanh(cand, out=cand)
            np.subtract(prev, cand, out=new)
            new *= gate[:, :n]
            new += cand
            h = new
        return out, h

    def logprob(self, states, targets, grad: dict | None = None):
        """Natural log probability of each target; with ``grad`` also the
        gradients of the negative log likelihood over ``grad["size"]`` (``dh``
        for the states).  Targets are handled by class, each class's together."""
        p = self.p
        cls = self.class_of(targets).astype(np.int16)      # short numbers sort by radix
        order = np.argsort(cls, kind="stable")
        cls, targets, states = cls[order], targets[order], states[order]
        at = np.arange(len(targets))
        logits = states @ p["c"]
        logits += p["cb"]
        picked = logits[at, cls]
        e, total, top, own = _softmax(logits, *_bounds(p["c"].T, p["cb"]))
        out = picked - top - np.log(total)
        if own is not None:
            out -= own
        if grad is not None:
            scale = self.flat.dtype.type(1 / grad.pop("size", max(1, len(targets))))
            e *= (scale / total)[:, None]
            e[at, cls] -= scale
            grad["c"], grad["cb"] = states.T @ e, e.sum(axis=0)
            dh = e @ p["c"].T
            grad["o"], grad["ob"] = np.zeros_like(p["o"]), np.zeros_like(p["ob"])
        edges = np.searchsorted(cls, np.arange(2, self.classes + 1, dtype=np.int16))
        least, most = _bounds(p["o"][:-1], p["ob"][:-1]) if self.blocks else ((), ())
        m = self.members(self.blocks - 1)
        last = _bounds(p["o"][-1, :m], p["ob"][-1, :m]) if self.blocks else ()
        for k in range(self.blocks):
            rows = slice(int(edges[k]), int(edges[k + 1]))
            if rows.start == rows.stop:
                continue
            s = states[rows]
            inner = s @ p["o"][k].T
            inner += p["ob"][k] + self.spare[k]
            member = (targets[rows] - 2) % CLASS_SIZE
            i = at[:len(s)]
            picked = inner[i, member]
            e, total, top, own = _softmax(inner[:, :self.members(k)], *(
                last if k == self.blocks - 1 else (least[k], most[k])))
            part = picked - top - np.log(total)
            if own is not None:
                part -= own
            out[rows] += part
            if grad is not None:
                e *= (scale / total)[:, None]
                e[i, member] -= scale
                m = self.members(k)
                grad["o"][k, :m], grad["ob"][k, :m] = e.T @ s, e.sum(axis=0)
                dh[rows] += e @ p["o"][k, :m]
        back = np.empty(len(order), np.int64)
        back[order] = at
        if grad is not None:
            grad["dh"] = dh[back]
        return out[back]

    def members(self, k: int) -> int:
        """Words in a class: the last one may be part full."""
        return min(CLASS_SIZE, self.words - k * CLASS_SIZE)

    def score(self, tokens, lengths, width: int = 256, window: int = 64) -> np.ndarray:
        """log10 probability of each document; the state is carried from window
        to window to the document's end."""
        total = np.zeros(len(lengths))
        if not len(lengths):
            return total
        inputs, targets, docs, first, active = sheet(tokens, lengths, width)
        h = np.zeros((inputs.shape[1], self.hidden), np.float32)
        for t in range(0, len(inputs), window):
            w = slice(t, t + window)
            states, h = self.run(inputs[w], first[w], active[w], h)
            used = docs[w] >= 0
            lp = self.logprob(states, targets[w][used])
            total += np.bincount(docs[w][used], weights=lp, minlength=len(total))
        return total / LOG10

    def train(self, tokens, lengths, seen: np.ndarray, rate: float = 0.05,
              width: int = 192, window: int = 16, piece: int = 512) -> None:
        """One pass of truncated backpropagation over the documents, AdaGrad;
        ``seen`` (the sums of squares) is updated along with the parameters.  The
        state is carried from window to window within ``piece`` tokens."""
        if not len(lengths):
            return
        lengths, lead = pieces(tokens, lengths, piece)
        # in the given order: by length the last windows would all be short texts
        inputs, targets, docs, first, active = sheet(tokens, lengths, width, False, lead)
        n, p = self.hidden, self.p
        h = np.zeros((inputs.shape[1], n), np.float32)
        names = list(p)
        at = dict(zip(names, np.cumsum([0] + [p[k].size for k in names])))
        for t in range(0, len(inputs), window):
            w = slice(t, t + window)
            keep: dict = {}
            states, h = self.run(inputs[w], first[w], active[w], h, keep)
            used = docs[w] >= 0
            # of a full window: the last ones, of few long documents, weigh less
            grad: dict = {"size": inputs.shape[1] * window}
            self.logprob(states, targets[w][used], grad)
            self._backward(inputs[w], first[w], active[w], keep, grad)
            # the input table is wide and few of its rows are used
            rows, gx = grad.pop("x")
            s = seen[:p["x"].size].reshape(p["x"].shape)
            s[rows] += gx * gx
            p["x"][rows] -= rate * gx / (np.sqrt(s[rows]) + 1e-6)
            for k in ("u", "b", "c", "cb", "o", "ob"):
                g = grad[k].reshape(-1)
                a = seen[at[k]:at[k] + g.size]
                a += g * g
                p[k].reshape(-1)[:] -= rate * g / (np.sqrt(a) + 1e-6)

    def _backward(self, inputs, first, active, keep, grad) -> None:
        n, u = self.hidden, self.p["u"]
        ends = np.cumsum(active)
        size = int(ends[-1])
        h, z, r, c, g = keep["h"], keep["zr"][:, :n], keep["zr"][:, n:], keep["c"], keep["g"][:, 2 * n:]
        # of all cells at once: what a state's gradient is times for the
        # candidate, and for update gate, reset gate and candidate's state side
        cand = (1 - z) * (1 - c * c)
        by = np.empty((size, 3, n), self.flat.dtype)
        by[:, 0] = (h - c) * z * (1 - z)
        by[:, 1] = cand * g * r * (1 - r)
        by[:, 2] = cand * r
        dg = np.empty_like(by)
        flat, ut, ds = dg.reshape(size, 3 * n), np.ascontiguousarray(u.T), grad["dh"]
        z = np.ascontiguousarray(z)
        dh = np.zeros((int(active[0]), n), self.flat.dtype)
        starts = first.any(axis=1).tolist()
        for t in range(len(active) - 1, -1, -1):
            a = int(active[t])
            rows = slice(int(ends[t]) - a, int(ends[t]))
            d = ds[rows]
            d[:len(dh)] += dh[:a]
            np.multiply(by[rows], d[:, None], out=dg[rows])
            dh = flat[rows] @ ut
            dh += d * z[rows]
            if starts[t]:
                dh[first[t, :a]] = 0
        grad["u"] = h.T @ flat
        dg[:, 2] = ds * cand                # now at the input's side
        grad["b"] = flat.sum(axis=0)
        ids = np.concatenate([inputs[t, :int(a)] for t, a in enumerate(active)])
        if self.words < 2**15 - 2:
            ids = ids.astype(np.int16)
        order = np.argsort(ids, kind="stable")
        rows, lo = np.unique(ids[order], return_index=True)
        grad["x"] = rows, np.add.reduceat(flat[order], lo, axis=0)
