"""A small causal self-attention model over subword ids, in numpy.

One layer: a position attends to the positions up to its own in a window of WINDOW ids. The next id is found in three steps:
its group of classes, its class in the group, the id in the class. The score of a group, and of a class in its group, is the
logarithm of its share behind the id at the position, as counted over the whole corpus, plus what the attention makes of the
id's embedding and of what it gathered. An id's share inside its class is counted too, behind the id at the position as far
as the pair is known. Everywhere PRIOR counts stand for the share in the whole corpus, so the probabilities over all ids of
the vocabulary sum to 1. Frequent ids are classes of their own, the others are clustered by the ids they stand next to.
Counts cover the whole corpus; the attention's weights start near 0 and are fitted by steps of Adam. Parts of a corpus may be learned from
apart, each from the same weights, and what they come to is averaged: a row of the ids' table by how often the id was met.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd

#: An id of a later window has WINDOW - STRIDE ids before it at least: a quarter of the window.
WINDOW, STRIDE, WIDTH, CLASSES, SINGLE = 32, 24, 16, 128, 96
PRIOR = 5.0
#: Groups of IN_GROUP classes each: a position costs GROUPS + IN_GROUP scores instead of CLASSES.
GROUPS = 16
IN_GROUP = CLASSES // GROUPS
#: Ids that profiles tell apart, and cells of a profile.
NEAR = 200
PROFILE = 2 * (NEAR + 1)
#: Windows in a step, and the rate of the first step and of the last, for a corpus' first texts and for the others.
FIRST, LATER = (64, 0.02, 0.002), (256, 0.005, 0.0005)
_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of ids with bounds `at`: first id, length and number of leading positions not to be scored, by window.

    Windows overlap by WINDOW - STRIDE ids, which are context only, so every id is scored once.
    """
    n = np.diff(at)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = at[row] + k * STRIDE
    return start, np.minimum(WINDOW, at[row + 1] - start), np.where(k > 0, WINDOW - STRIDE, 0)


def neighbours(count: np.ndarray) -> np.ndarray:
    """The place of every id among the NEAR most frequent ones; NEAR for the others."""
    near = np.full(len(count), NEAR)
    most = np.argsort(-count, kind="stable")[:NEAR]
    near[most] = np.arange(len(most))
    return near


def profile_cells(count: np.ndarray, pairs: np.ndarray, n_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The profile of an id: how often each of the most frequent ids, or another, stands before and after it; as id * PROFILE + place, and counts."""
    before, after, near = pairs // len(count), pairs % len(count), neighbours(count)
    return np.concatenate([after * PROFILE + near[before], before * PROFILE + NEAR + 1 + near[after]]), np.concatenate([n_pair, n_pair])


def clusters(count: np.ndarray, cell: np.ndarray, n_cell: np.ndarray, seed: int = 0) -> np.ndarray:
    """The class of every id of the vocabulary from counts of ids and of their profiles' cells; ids without a count share the last class."""
    size = len(count)
    order = np.argsort(-count, kind="stable")
    out = np.full(size, CLASSES - 1)
    single = order[:SINGLE][count[order[:SINGLE]] > 0]
    out[single] = np.arange(len(single))
    rest = order[SINGLE:][count[order[SINGLE:]] > 0]
    n = CLASSES - SINGLE - 1
    if len(rest) < n:
        out[rest] = SINGLE + np.arange(len(rest))
        return out
    at = np.full(size, -1)
    at[rest] = np.arange(len(rest))
    x = np.zeros((len(rest), PROFILE), np.float32)
    mine = at[cell // PROFILE]
    np.add.at(x, (mine[mine >= 0], cell[mine >= 0] % PROFILE), n_cell[mine >= 0])
    x = np.sqrt(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(rest), n, replace=False, p=count[rest] / count[rest].sum())]
    for _ in range(8):
        own = (x @ centre.T).argmax(1)
        for c in range(n):
            if (own == c).any():
                centre[c] = (x[own == c] * count[rest[own == c], None]).sum(0)
                centre[c] /= np.linalg.norm(centre[c]) + 1e-9
    out[rest] = SINGLE + own
    return out


def classes(count: np.ndarray, pairs: np.ndarray, n_pair: np.ndarray, seed: int = 0) -> np.ndarray:
    """The class of every id, numbered so that those of a group are alike; see Attention for the arguments."""
    cls = clusters(count, *profile_cells(count, pairs, n_pair), seed)
    near = np.zeros((CLASSES, CLASSES))
    np.add.at(near, (cls[pairs % len(count)], cls[pairs // len(count)]), n_pair)
    return alike(near)[cls]


def rows_of(count: np.ndarray, begin: int) -> np.ndarray:
    """The ids that have rows of their own in the model's tables, ascending: those with a count, and the one before every text."""
    return np.flatnonzero((count > 0) | (np.arange(len(count)) == begin))


class _Room:
    """Arrays by name whose memory is used again: what was in them is lost."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, kind)
        return self.held[name][:n].reshape(shape)


class Attention:
    def __init__(self, texts: list[np.ndarray], count: np.ndarray, pairs: np.ndarray, n_pair: np.ndarray, begin: int, epochs: int = 2, seed: int = 0, cls: np.ndarray | None = None, behind: np.ndarray | None = None):
        """Fit on the ids of texts, if there are any here; see learn() for more than fit a task. begin: the id that stands before every text.

        count: of every id of the vocabulary in the corpus. pairs: id before * vocabulary + id, ascending, with their counts in
        the corpus. If these are not all pairs, `behind` holds the counts of classes behind the ids of rows_of() over all of them, and
        missing() tells which pairs of a text must be looked up elsewhere. cls: classes() of the corpus.
        """
        size = len(count)
        self.begin, self.pairs, self.n_pair, self.whole = begin, pairs, n_pair.astype(np.float32), behind is None
        self.cls = classes(count, pairs, n_pair, seed) if cls is None else cls
        smooth = count + 0.1
        self.share = np.bincount(self.cls, smooth, CLASSES) / smooth.sum()
        self.inside = (smooth / np.bincount(self.cls, smooth, CLASSES)[self.cls]).astype(np.float32)
        # ids without a row of their own share the last one
        met = rows_of(count, begin)
        self.row = np.full(size, len(met), np.int32)
        self.row[met] = np.arange(len(met))
        self.behind = np.zeros((int(self.row.max(initial=0)) + 2, CLASSES), np.float32)
        if behind is None:
            np.add.at(self.behind, (self.row[pairs // size], self.cls[pairs % size]), self.n_pair)
        else:
            self.behind[: len(met)] = behind
        self._shares()
        rng = np.random.default_rng(seed)
        init = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
        d = WIDTH
        self.w = {"e": init(0.1, len(self.behind), d), "p": init(0.1, WINDOW, d), "q": init(0.1, d, d), "k": init(0.1, d, d), "v": init(0.1, d, d), "o": init(0.1, d, d), "u": init(0.01, d, GROUPS), "c": init(0.01, GROUPS, d, IN_GROUP)}
        if len(texts):
            block = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            self.learn([block] * epochs, epochs * len(block[0]), FIRST, rng)
        self.freeze()

    def _shares(self) -> None:
        """Smoothed logarithms of the classes' shares behind the ids with rows."""
        behind = self.behind.reshape(-1, GROUPS, IN_GROUP)
        share = np.maximum(self.share, 1e-12).reshape(GROUPS, IN_GROUP)
        of_group, whole = behind.sum(2), share.sum(1)
        self.to_group = np.log((of_group + PRIOR * whole) / (of_group.sum(1, keepdims=True) + PRIOR * whole.sum())).astype(np.float32)
        self.to_class = np.log((behind + PRIOR * share / whole[:, None]) / (of_group[:, :, None] + PRIOR)).astype(np.float32)

    def _inputs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        before = np.concatenate([[self.begin], ids[:-1]]) if len(ids) else ids
        before[at[:-1][np.diff(at) > 0]] = self.begin
        return before

    def learn(self, texts: Iterable[tuple[np.ndarray, np.ndarray]], ids: float, how: tuple[int, float, float], rng: np.random.Generator) -> np.ndarray:
        """Fit the weights on blocks of texts (ids and bounds), every id once. ids: how many there will be, about; the rate falls
        over them. Returns how often each row of flat() was met. freeze() must follow before scoring."""
        batch, high, low = how
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        met, seen, step, room = np.zeros(len(self.w["e"])), 0, 0, _Room()
        for block, at in texts:
            block = block.astype(np.int64)
            start, length, skip = windows(at)
            row, cls = self.row[self._inputs(block, at)], self.cls[block]
            met += np.bincount(row, minlength=len(met))
            # windows of a step have the same context: first ones none, later ones what they share with the one before
            own = [rng.permutation(np.flatnonzero(skip == lead)) for lead in (0, WINDOW - STRIDE)]
            own = [(lead, o[lo : lo + batch]) for lead, o in zip((0, WINDOW - STRIDE), own) for lo in range(0, len(o), batch)]
            for i in rng.permutation(len(own)):
                lead, o = own[i]
                place = np.minimum(start[o, None] + np.arange(WINDOW), len(block) - 1)
                grad, rows = self._gradient(row[place], cls[place[:, lead:]], np.arange(lead, WINDOW) < length[o, None], lead, room)
                step += 1
                rate = np.float32(max(low, high - (high - low) * seen / ids))
                seen += len(o) * (WINDOW - lead)
                self._move(grad, rows, m, s, step, rate)
        return np.concatenate([np.full(v.size // WIDTH, float(met.sum())) if k != "e" else met for k, v in self.w.items()])

    def _gradient(self, x_id: np.ndarray, y: np.ndarray, ok: np.ndarray, lead: int, room: _Room) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient of the mean loss of the places behind `lead` that are `ok`, and the rows that e's is of.

        Queries and keys meet as one matrix (qk), values and the output as another (vo), whose gradients give those of the four.
        """
        w, d, n, many = self.w, np.float32(WIDTH**-0.5), len(x_id), WINDOW - lead
        qk, vo, one = w["q"] @ w["k"].T * d, w["v"] @ w["o"], np.ones((WINDOW, 1), np.float32)
        x = np.take(w["e"], x_id, axis=0, out=room("x", n, WINDOW, WIDTH), mode="clip")
        x += w["p"]
        last = room("last", n, many, WIDTH)
        last[:] = x[:, lead:]
        last = last.reshape(-1, WIDTH)
        t = np.matmul(last, qk, out=room("t", n * many, WIDTH)).reshape(n, many, WIDTH)
        a = np.matmul(t, x.swapaxes(1, 2), out=room("a", n, many, WINDOW))
        np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= _SEEN[lead:]
        z = np.matmul(a, one, out=room("z", n, many, 1))
        h = np.matmul(a, x, out=room("h", n, many, WIDTH))
        h /= z
        h = h.reshape(-1, WIDTH)
        out = np.matmul(h, vo, out=room("out", n * many, WIDTH))
        out += last
        out.reshape(n, many, WIDTH)[:] -= w["p"][lead:]
        # real places in the order of their groups, so that each group's classes are one product
        real = np.flatnonzero(ok)
        m = len(real)
        group = np.take(y, real) // IN_GROUP
        order = np.argsort(group.astype(np.uint8), kind="stable")
        real, group = np.take(real, order), np.take(group, order)
        of, slot = np.take(x_id[:, lead:], real), np.take(y, real) % IN_GROUP
        own = np.take(out, real, axis=0, out=room("own", m, WIDTH), mode="clip")
        part = np.float32(1 / max(1, m))
        g = np.take(self.to_group, of, axis=0, out=room("g", m, GROUPS), mode="clip")
        g += np.matmul(own, w["u"], out=room("more", m, GROUPS))
        _softmax_less(g, group, part)
        c = np.take(self.to_class.reshape(-1, IN_GROUP), of * GROUPS + group, axis=0, out=room("c", m, IN_GROUP), mode="clip")
        edge = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        spans = [(i, slice(edge[i], edge[i + 1])) for i in range(GROUPS) if edge[i] < edge[i + 1]]
        for i, span in spans:
            c[span] += own[span] @ w["c"][i]
        _softmax_less(c, slot, part)
        gown = room("gown", m + 1, WIDTH)  # the last row is of places that aren't real
        gown[m] = 0
        np.matmul(g, w["u"].T, out=gown[:m])
        grad = {"u": own.T @ g, "c": np.zeros_like(w["c"])}
        for i, span in spans:
            np.matmul(own[span].T, c[span], out=grad["c"][i])
            gown[span] += c[span] @ w["c"][i].T
        at = np.full(n * many, m)
        at[real] = np.arange(m)
        gout = np.take(gown, at, axis=0, out=room("gout", n * many, WIDTH), mode="clip")
        of_vo = h.T @ gout
        gh = np.matmul(gout, vo.T, out=room("gh", n * many, WIDTH)).reshape(n, many, WIDTH)
        gh /= z  # a is without its sum
        h *= gh.reshape(-1, WIDTH)
        less = np.matmul(h, one[:WIDTH], out=room("less", n * many, 1))
        gs = np.matmul(gh, x.swapaxes(1, 2), out=room("gs", n, many, WINDOW))
        gs -= less.reshape(n, many, 1)
        gs *= a
        gt = np.matmul(gs, x, out=room("gt", n, many, WIDTH)).reshape(-1, WIDTH)
        of_qk = last.T @ gt * d
        gx = np.matmul(gs.swapaxes(1, 2), t, out=room("gx", n, WINDOW, WIDTH))
        gx += np.matmul(a.swapaxes(1, 2), gh, out=x)
        gx[:, lead:] += np.matmul(gt, qk.T, out=out).reshape(n, many, WIDTH)
        grad["p"] = (np.ones(n, np.float32) @ gx.reshape(n, -1)).reshape(WINDOW, WIDTH)
        gx[:, lead:] += gout.reshape(n, many, WIDTH)
        grad |= {"q": of_qk @ w["k"], "k": of_qk.T @ w["q"], "v": of_vo @ w["o"].T, "o": w["v"].T @ of_vo}
        id_ = x_id.ravel()
        order = np.argsort(id_.astype(np.uint16) if len(w["e"]) < 1 << 16 else id_, kind="stable")
        sorted_ = np.take(id_, order)
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        grad["e"] = np.add.reduceat(np.take(gx.reshape(-1, WIDTH), order, axis=0, out=room("sorted", len(order), WIDTH), mode="clip"), first, axis=0)
        return grad, sorted_[first]

    def _move(self, grad: dict[str, np.ndarray], rows: np.ndarray, m: dict, s: dict, step: int, rate: np.float32) -> None:
        near, far = rate / np.float32(1 - 0.9**step), np.float32(1 / (1 - 0.99**step))
        for name, dw in grad.items():
            some = name == "e"  # rows without a gradient rest
            m_, s_ = (np.take(v[name], rows, axis=0) if some else v[name] for v in (m, s))
            m_ *= np.float32(0.9)
            m_ += np.float32(0.1) * dw
            s_ *= np.float32(0.99)
            dw *= dw
            dw *= np.float32(0.01)
            s_ += dw
            if some:
                m[name][rows], s[name][rows] = m_, s_
            np.sqrt(np.multiply(s_, far, out=dw), out=dw)
            dw += np.float32(1e-6)
            np.divide(m_, dw, out=dw)
            dw *= near
            if some:
                self.w[name][rows] = np.take(self.w[name], rows, axis=0) - dw
            else:
                self.w[name] -= dw

    def flat(self) -> np.ndarray:
        """All weights as rows of WIDTH numbers."""
        return np.concatenate([v.reshape(-1, WIDTH) for v in self.w.values()])

    def put(self, flat: np.ndarray) -> None:
        """Take weights from the rows of flat()."""
        at = 0
        for k, v in self.w.items():
            n = v.size // WIDTH
            self.w[k] = flat[at : at + n].astype(np.float32).reshape(v.shape)
            at += n

    def freeze(self) -> None:
        """Tables by id for scoring: queries, keys, values and a column of ones; the direct part of group and class scores."""
        w, d = self.w, np.float32(WIDTH**-0.5)
        qkv = np.concatenate([w["q"] * d, w["k"], w["v"]], 1)
        one = lambda n, v: np.full((n, 1), v, np.float32)
        self.by_id = np.concatenate([w["e"] @ qkv, one(len(w["e"]), 1)], 1).astype(np.float32)
        self.by_place = np.concatenate([w["p"] @ qkv, one(WINDOW, 0)], 1).astype(np.float32)
        far = lambda c: sum(float(np.linalg.norm(t[:, c * WIDTH : (c + 1) * WIDTH], axis=1).max()) for t in (self.by_id, self.by_place))
        self.steep = far(0) * far(1) > 60  # else no attention score can leave the range of exp
        self.group_by_id = w["e"] @ w["u"] + self.to_group
        self.class_by_id = np.einsum("rd,gdk->rgk", w["e"], w["c"]) + self.to_class
        self.class_by_id = np.ascontiguousarray(self.class_by_id.reshape(-1, IN_GROUP), np.float32)
        self.to_groups, self.to_classes = w["o"] @ w["u"], w["o"] @ w["c"]
        heads = sum(float(np.linalg.norm(t[:, 2 * WIDTH : 3 * WIDTH], axis=1).max()) for t in (self.by_id, self.by_place))
        tables = ((self.group_by_id, self.to_groups), (self.class_by_id, self.to_classes))
        self.wild = max(float(np.abs(t).max()) + heads * float(np.linalg.norm(m, axis=-2).max()) for t, m in tables) > 80  # else no score can leave the range of exp

    def __getstate__(self) -> dict:
        """Weights and counts travel; the tables are made anew."""
        return {k: getattr(self, k) for k in ("begin", "cls", "share", "inside", "row", "pairs", "n_pair", "whole", "behind", "w")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._shares()
        self.freeze()

    def known(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ids that aren't alone in their class, and how often the pairs that they end are at hand: what score() and missing() look up."""
        ids = ids.astype(np.int64)
        many = np.flatnonzero(self.inside[ids] < 1)
        return many, self._known(self._inputs(ids, at)[many] * len(self.row) + ids[many])

    def _inside(self, before: np.ndarray, ids: np.ndarray, cls: np.ndarray, many: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logarithm of the ids' share inside their classes, behind the ids before them; a pair that isn't at hand counts as unknown."""
        out = np.zeros(len(ids), np.float32)
        own, prev, of = ids[many], before[many], cls[many]
        out[many] = np.log((n + PRIOR * self.inside[own]) / (self.behind[self.row[prev], of] + PRIOR))
        return out

    def _known(self, key: np.ndarray) -> np.ndarray:
        """Counts of the pairs that are at hand, 0 for others. A pair that occurs again in the texts is looked up once."""
        if not len(self.pairs):
            return np.zeros(len(key), np.float32)
        code, unique = pd.factorize(key)
        at = np.minimum(np.searchsorted(self.pairs, unique), len(self.pairs) - 1)
        return np.take(np.where(self.pairs[at] == unique, self.n_pair[at], np.float32(0)), code)

    def missing(self, ids: np.ndarray, at: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of every row, and the rows' bounds, that score() took as unknown and whose counts may be elsewhere. A pair with count n adds
        log10(1 + n / prior()[id]) to its row's score."""
        if self.whole:
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        ids = ids.astype(np.int64)
        many, n = known or self.known(ids, at)
        place = many[n == 0]
        return self._inputs(ids, at)[place] * len(self.row) + ids[place], np.searchsorted(place, at)

    def prior(self) -> np.ndarray:
        """What stands for a pair's count in the whole corpus, by its second id."""
        return PRIOR * self.inside.astype(np.float64)

    def score(self, ids: np.ndarray, at: np.ndarray, most: int = 64, chunk: int = 16_384, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 of the probability of every row's ids. known: known() of them, if at hand."""
        start, length, skip = windows(at)
        ids = ids.astype(np.int64)
        before, cls = self._inputs(ids, at), self.cls[ids]
        row = self.row[before].astype(np.int64)
        d, got, room = WIDTH, np.zeros(len(ids), np.float32), _Room()
        heads, places, held = [], [], 0
        for lead in (0, WINDOW - STRIDE):  # first windows are scored from their start, later ones behind what is context only
            own = np.flatnonzero(skip == lead)
            inside = np.arange(lead, WINDOW)
            for lo in range(0, len(own), most):
                s, n = start[own[lo : lo + most]], length[own[lo : lo + most]]
                x = np.take(self.by_id, np.take(row, s[:, None] + np.arange(WINDOW), mode="clip"), axis=0, out=room("x", len(s), WINDOW, 3 * d + 1), mode="clip")
                x += self.by_place
                a = np.matmul(x[:, lead:, :d], x[:, :, d : 2 * d].swapaxes(1, 2), out=room("a", len(s), len(inside), WINDOW))
                if self.steep:
                    np.clip(a, -60, 60, out=a)
                np.exp(a, out=a)
                a *= _SEEN[lead:]
                h = np.matmul(a, x[:, :, 2 * d :], out=room("h", len(s), len(inside), d + 1)).reshape(-1, d + 1)  # the column behind the values is 1
                ok = np.flatnonzero(inside < n[:, None])
                if len(ok) < len(h):
                    h = np.take(h, ok, axis=0)
                heads.append(h[:, :d] / h[:, d:])
                places.append(np.take(s[:, None] + inside, ok))
                held += len(h)
                if held > chunk:
                    place = np.concatenate(places)
                    got[place] = self._classes(np.concatenate(heads), np.take(row, place), np.take(cls, place))
                    heads, places, held = [], [], 0
        if held:
            place = np.concatenate(places)
            got[place] = self._classes(np.concatenate(heads), row[place], cls[place])
        total = np.concatenate([[0.0], np.cumsum((got + self._inside(before, ids, cls, *(known or self.known(ids, at)))).astype(np.float64))])
        return (total[at[1:]] - total[at[:-1]]) / np.log(10)

    def _classes(self, head: np.ndarray, row: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Logarithm of the classes' probability behind rows, with what the attention gathered."""
        group = cls // IN_GROUP
        # in the order of groups, so that each group's classes are one product
        order = np.argsort(group.astype(np.uint8), kind="stable")
        head, row, cls, group = (np.take(x, order, axis=0) for x in (head, row, cls, group))
        g = head @ self.to_groups
        g += np.take(self.group_by_id, row, axis=0)
        c = np.take(self.class_by_id, row * GROUPS + group, axis=0)
        edge = np.searchsorted(group, np.arange(GROUPS + 1))
        for k in range(GROUPS):
            own = slice(edge[k], edge[k + 1])
            c[own] += head[own] @ self.to_classes[k]
        out = np.empty(len(cls), np.float32)
        if self.wild:
            for x in (g, c):
                x -= x.max(1, keepdims=True)
        out[order] = _log_share(g, group) + _log_share(c, cls % IN_GROUP)
        return out


def alike(near: np.ndarray) -> np.ndarray:
    """New numbers of the classes, in which those that follow the same classes are near each other and so in one group. near: counts by
    class and class before it.

    They are told apart by halves: along the main direction of what stands before them, and again inside each half.
    """
    near = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1))
    parts = [np.arange(CLASSES)]
    while len(parts) < GROUPS:
        halves = []
        for own in parts:
            x = near[own] - near[own].mean(0)
            side = np.linalg.svd(x, full_matrices=False)[0][:, 0]
            order = own[np.argsort(side * np.sign(side[np.abs(side).argmax()]), kind="stable")]
            halves += [order[: len(own) // 2], order[len(own) // 2 :]]
        parts = halves
    out = np.empty(CLASSES, np.int64)
    out[np.concatenate(parts)] = np.arange(CLASSES)
    return out


def _log_share(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of the targets' shares. scores is overwritten."""
    right = np.take(scores, np.arange(len(scores)) * scores.shape[1] + target)
    np.exp(scores, out=scores)
    return right - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _softmax_less(scores: np.ndarray, target: np.ndarray, part: np.float32) -> None:
    """scores become their shares, less 1 at the target, times part: the gradient of a mean loss."""
    np.clip(scores, -60, 60, out=scores)
    np.exp(scores, out=scores)
    scores *= part / (scores @ np.ones((scores.shape[1], 1), np.float32))
    scores.ravel()[np.arange(len(scores)) * scores.shape[1] + target] -= part
