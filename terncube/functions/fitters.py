"""Model fitting in numpy: each fit returns a plain dict, predict() evaluates any of them.

Families: glm, ridge, brt (brt_search with its learning-rate search), rf, nn, gam. All random choices come from the seed. The numbers follow the stated procedures, not
another library's random streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np

CANONICAL = ("brt", "glm", "gam", "rf", "nn")


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def deviance(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


#: Rows that a Newton round takes at once.
BLOCK = 8192


def newton(x: np.ndarray, y: np.ndarray, penalty: np.ndarray | float = 0.0, rounds: int = 50, floor: np.ndarray | None = None, n: np.ndarray | None = None, design: Callable = lambda x: x) -> tuple[np.ndarray, bool]:
    """Penalised logistic regression; coefficients with a floor are kept at or above it by active sets. (b, converged). n
    rows are alike; design makes the columns of a block of rows."""
    size = design(x[:1]).shape[1]
    b, pen = np.zeros(size), np.broadcast_to(np.asarray(penalty, float), (size,))
    for _ in range(rounds):
        grad, curve = -pen * b, np.diag(pen + 1e-9)
        for lo in range(0, len(x), BLOCK):
            a, of = design(x[lo : lo + BLOCK]), 1.0 if n is None else n[lo : lo + BLOCK]
            p = logistic(a @ b)
            grad += (of * (y[lo : lo + BLOCK] - p)) @ a
            curve += (a.T * (of * np.maximum(p * (1 - p), 1e-9))) @ a
        free = np.ones(len(b), bool) if floor is None else ~((b <= floor) & (grad < 0))
        step = np.zeros(len(b))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], grad[free])
        new = b + step
        if floor is not None:
            new = np.maximum(new, floor)
        if np.abs(new - b).max() < 1e-9:
            return new, True
        b = new
    return b, False


def _scaling(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each column, 1 for constant ones."""
    mean = n @ x / n.sum()
    sd = np.sqrt(n @ (x - mean) ** 2 / n.sum())
    return mean, np.where(sd > 1e-9 * np.abs(mean), sd, 1)


def fit_glm(x: np.ndarray, y: np.ndarray, seed: int = 0, n: np.ndarray | None = None) -> dict:
    """Linear and quadratic terms, dropped one by one while that lowers AIC; then last terms until the fit converges. n rows
    are alike."""
    n = np.ones(len(y)) if n is None else n.astype(float)
    mean, sd = _scaling(x, n)
    z = (x - mean) / sd
    terms = [(j, power) for j in range(x.shape[1]) for power in (1, 2)]
    design = lambda t: lambda z: np.column_stack([np.ones(len(z)), *[z[:, j] ** p for j, p in t]])
    fitted = lambda t: newton(z, y, n=n, design=design(t))

    def score(t: list) -> float:
        b, made, total = fitted(t)[0], design(t), 0.0
        for lo in range(0, len(z), BLOCK):
            p = np.clip(logistic(made(z[lo : lo + BLOCK]) @ b), 1e-9, 1 - 1e-9)
            total -= 2 * n[lo : lo + BLOCK] @ np.log(np.where(y[lo : lo + BLOCK] > 0.5, p, 1 - p))
        return float(total) + 2 * (len(t) + 1)

    best = score(terms)
    while terms:
        tried = [(score([t for t in terms if t != out]), out) for out in terms]
        low, out = min(tried, key=lambda s: s[0])
        if low >= best:
            break
        best, terms = low, [t for t in terms if t != out]
    b, fine = fitted(terms)
    while not fine and terms:
        terms = terms[:-1]
        b, fine = fitted(terms)
    return {"family": "glm", "mean": mean, "sd": sd, "terms": terms, "b": b, "aic": best}


def fit_ridge(x: np.ndarray, y: np.ndarray, seed: int = 42, folds: int = 10, lam: float | None = None) -> dict:
    """Ridge logistic regression with weights never negative; the penalty is the largest whose cross-validated deviance is
    within a standard error of the least."""
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    floor = np.array([-np.inf, *[0.0] * x.shape[1]])
    pen = lambda v: np.array([0.0, *[v * len(z)] * x.shape[1]])
    if lam is None:
        path = np.exp(np.linspace(np.log(10), np.log(1e-4), 25))
        fold = np.random.default_rng(seed).permutation(len(x)) % folds
        errors = np.array([[deviance(y[fold == k], logistic(z[fold == k] @ newton(z[fold != k], y[fold != k], pen(v) * (fold != k).mean(), floor=floor)[0])) / max(1, (fold == k).sum()) for k in range(folds) if (fold == k).any()] for v in path])
        m, se = errors.mean(1), errors.std(1, ddof=1) / np.sqrt(errors.shape[1])
        lam = float(path[np.flatnonzero(m <= m.min() + se[m.argmin()])[0]])
    b, _ = newton(z, y, pen(lam), floor=floor)
    w = b[1:] / sd
    return {"family": "ridge", "b": np.array([b[0] - (w * mean).sum(), *w]), "lambda": lam}


def fit_logistic(x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    """Plain logistic regression; constant columns have no weight."""
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    b, _ = newton(np.column_stack([np.ones(len(x)), (x - mean) / sd]), y, np.array([0.0, *[1e-9] * x.shape[1]]))
    w = b[1:] / sd
    return {"family": "ridge", "b": np.array([b[0] - (w * mean).sum(), *w]), "lambda": 0.0}


def _histograms(kinds: Kinds, keys: list[np.ndarray], v: np.ndarray, nodes: int) -> np.ndarray:
    """(nodes, columns, bins): sums of v by the bins of each column. Histograms of two columns at once give those of both."""
    widths = kinds.widths
    out = np.zeros((nodes, len(widths), int(widths.max())))
    for (i, j, _), at in zip(kinds.pairs, keys, strict=True):
        wi, wj = widths[i], widths[j] if j is not None else 1
        both = np.bincount(at, v, nodes * wi * wj).reshape(-1, wi, wj)
        out[:, i, :wi] = both.sum(2)
        if j is not None:
            out[:, j, :wj] = both.sum(1)
    return out


def _level_trees(kinds: Kinds, keys: list[np.ndarray], drawn: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree for each row of drawn (sides, kinds), the drawn rows of each kind, all grown level by level:
    (column or -1, cut, sum(target) / sum(weight)) of every tree and node, the children of node i at 2 i + 1 and 2 i + 2; and
    the value of each kind. Only the child of fewer rows is counted, the other is what it leaves of its parent. keys are those
    of Kinds.keys; whole: the histograms of drawn, where known."""
    (sides, size), widths = drawn.shape, kinds.widths
    wide, nodes = int(widths.max()), (1 << depth + 1) - 1
    column, cut, mean = np.full((sides, nodes), -1, np.int64), np.zeros((sides, nodes), np.int64), np.zeros((sides, nodes))
    open_, flat = np.ones(sides, bool), (drawn.reshape(-1), target.reshape(-1))
    rows = _histograms(kinds, keys, flat[0], sides) if whole is None else whole
    sums, inside = _histograms(kinds, keys, flat[1], sides), np.ones((sides, 1, size), bool)  # the kinds of each node
    place = np.zeros((sides, size), np.uint8 if depth <= 8 else np.int64)
    for level in range(depth):
        k = 1 << level
        n, s = rows[:, :1].sum(2, keepdims=True), sums[:, :1].sum(2, keepdims=True)
        left, low = rows.cumsum(2), sums.cumsum(2)
        fine = (left >= least) & (n - left >= least)
        gain = np.where(fine, low**2 / np.maximum(left, 1) + (s - low) ** 2 / np.maximum(n - left, 1) - s**2 / np.maximum(n, 1), -1).reshape(sides * k, -1)
        best, every = gain.argmax(1), np.arange(sides * k)
        open_ = open_ & (gain[every, best] > 1e-12) & (n[:, 0, 0] >= 2 * least)
        column[:, k - 1 : 2 * k - 1], cut[:, k - 1 : 2 * k - 1] = np.where(open_, best // wide, -1).reshape(sides, k), (best % wide).reshape(sides, k)
        parted = np.zeros((sides, k, 2, size), bool)  # what a leaf holds goes on to the left
        for at in range(sides * k):
            mine, (to_left, to_right) = inside[at // k, at % k], parted[at // k, at % k]
            if open_[at]:
                np.greater(kinds.codes[int(best[at]) // wide], int(best[at]) % wide, out=to_right)
                if k > 1:
                    to_right &= mine
            np.not_equal(mine, to_right, out=to_left)
        place += place
        for side in range(sides):
            place[side] += parted[side, :, 1].any(0) if k > 1 else parted[side, 0, 1]
        if level + 1 < depth:
            fewer = np.where(open_, 2 * left.reshape(sides * k, -1)[every, best] > n[:, 0, 0], True).astype(np.int64)
            small = [np.flatnonzero(parted[at // k, at % k, f]) + at // k * size for at, f in enumerate(fewer.tolist())]
            node, some = np.repeat(every, [len(m) for m in small]), np.concatenate(small)
            own = [key[some] for key in keys]
            if k > 1:  # else a node is its tree's only one
                own = [key + (node - node // k) * (widths[i] * (1 if j is None else widths[j])) for (i, j, _), key in zip(kinds.pairs, own, strict=True)]
            child = []
            for parent, v in zip((rows, sums), flat, strict=True):
                both = np.empty((sides * k, 2, *parent.shape[1:]))
                both[every, fewer] = _histograms(kinds, own, v[some], sides * k)
                both[every, 1 - fewer] = parent - both[every, fewer]
                child.append(both.reshape(sides * k * 2, *parent.shape[1:]))
            rows, sums = child
        open_, inside = np.repeat(open_, 2), parted.reshape(sides, 2 * k, size)
    last, value = 1 << depth, np.empty((sides, size))
    for side in range(sides):
        by_leaf = inside[side].astype(float)
        leaf = by_leaf @ target[side] / np.maximum(by_leaf @ weight[side], 1e-12)
        np.take(leaf, place[side], out=value[side], mode="clip")
        for i in range(nodes):
            at = i
            while at < last - 1:
                at = 2 * at + 1
            mean[side, i] = leaf[at - last + 1]
    return column, cut, mean, value


#: Kinds of rows, folds taken apart, whose trees grow in one step.
TOGETHER = 60_000
#: Bytes of bags that a search keeps for its next learning rates.
KEPT = 1 << 25


def _eval(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _eval(tree[2], x[left]), _eval(tree[3], x[~left])
    return out


def _weighed_edges(x: np.ndarray, n: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    every = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return [np.unique(np.quantile(c[every], np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


@dataclass
class Kinds:
    """Rows of one cell of the binned columns and one class, told apart by nothing: codes (columns, kinds), the class and
    the rows of each kind by fold (folds, kinds)."""

    edges: list[np.ndarray]
    codes: np.ndarray
    y: np.ndarray
    rows: np.ndarray

    def __post_init__(self):
        self.widths = np.array([len(e) + 1 for e in self.edges])
        self.pairs, self.made = [], {}
        for i in range(0, len(self.codes), 2):
            j = i + 1 if i + 1 < len(self.codes) else None
            self.pairs.append((i, j, self.codes[i].astype(np.int64) * (1 if j is None else self.widths[j]) + (0 if j is None else self.codes[j])))

    def keys(self, sides: int) -> list[np.ndarray]:
        """For each pair of columns the cells of all kinds, those of each side apart."""
        if sides not in self.made:  # all folds' bags share them
            sizes = [self.widths[i] * (1 if j is None else self.widths[j]) for i, j, _ in self.pairs]
            self.made[sides] = [(key + size * np.arange(sides)[:, None]).reshape(-1) for (_, _, key), size in zip(self.pairs, sizes, strict=True)]
        return self.made[sides]

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray, folds: int) -> Kinds:
        """fold: of each single row, in the order of np.repeat by n."""
        edges = _weighed_edges(x, n)
        codes, kind = _coded(x, edges), (y > 0.5).astype(np.int64)
        for c, e in zip(codes.T, edges, strict=True):
            kind = np.unique(kind * (len(e) + 1) + c, return_inverse=True)[1].reshape(-1)
        size = int(kind.max()) + 1
        of_kind, classes = np.zeros((codes.shape[1], size), np.uint8), np.zeros(size)
        of_kind[:, kind], classes[kind] = codes.T, y
        return Kinds(edges, of_kind, classes, np.bincount(fold * size + np.repeat(kind, n), minlength=folds * size).reshape(folds, size))


def _bags(rng: np.random.Generator, n: np.ndarray, bag: float) -> Iterator[np.ndarray]:
    """For each row of n (sides, kinds), the rows of each kind: how many of them are in a draw without replacement of a part
    bag of all, again and again. Every row is drawn on its own first, then as many as needed are drawn in or out. Three of
    four: a bit of two random ones is set."""
    flat, sizes = n.reshape(-1), np.maximum(1, (bag * n.sum(1)).astype(np.int64))
    wide = 8 if flat.max() <= 8 else 64  # bits of a word, of which a kind has as many as its rows need
    word = np.uint8 if wide == 8 else np.uint64
    owner = np.repeat(np.arange(len(flat)), np.maximum(-(-flat // wide), 1))
    upto = np.searchsorted(owner, np.arange(len(flat)))
    left = np.minimum(flat[owner] - wide * (np.arange(len(owner)) - upto[owner]), wide).astype(np.uint64)
    mask = (~np.uint64(0) >> (np.uint64(64) - left)).astype(word)
    one, last = len(owner) == len(flat), n.cumsum(1)
    owner, upto, left = None if one else owner, None, None
    while True:
        if bag == 0.75:
            bits = rng.integers(0, 1 << 64, 2 * (-(-len(mask) * wide // 64)), dtype=np.uint64).view(word).reshape(2, -1)[:, : len(mask)]
            bits = np.bitwise_count((bits[0] | bits[1]) & mask)
            got = bits.astype(float) if one else np.bincount(owner, bits, len(flat))
        else:
            got = rng.binomial(flat, bag).astype(float)
        got = got.reshape(n.shape)
        for row, of, ends, over in zip(got, n, last, (got.sum(1) - sizes).astype(np.int64).tolist(), strict=True):
            if over:
                np.subtract.at(row, _some_of(rng, row, of, ends, over), np.sign(over))
        yield got


def _some_of(rng: np.random.Generator, row: np.ndarray, of: np.ndarray, ends: np.ndarray, over: int) -> np.ndarray:
    """The kinds of over single rows at random, no row twice, among the row drawn of each kind, or of -over among those left;
    ends are the running sums of the kinds' rows. Of a kind's rows the first are the drawn ones."""
    found = np.zeros(0, np.int64)
    while len(found) < abs(over):
        at = rng.integers(0, ends[-1], 6 * abs(over) + 16)
        kind = np.searchsorted(ends, at, side="right")
        drawn = at - (ends[kind] - of[kind]) < row[kind]
        found = np.concatenate([found, at[drawn == (over > 0)]])
        found = found[np.sort(np.unique(found, return_index=True)[1])]
    return np.searchsorted(ends, found[: abs(over)], side="right")


class Bags:
    """The bags of n (sides, kinds) from a seed, with their histograms, the same for every learning rate: as many as fit room
    bytes are kept, later ones are drawn anew."""

    def __init__(self, kinds: Kinds, n: np.ndarray, seed: int, bag: float, room: float = 0):
        self.kinds, self.n, self.bag, self.room, self.keys = kinds, n, bag, room, kinds.keys(len(n))
        self.rng, self.kept = np.random.default_rng(seed), []
        self.next = _bags(self.rng, n, bag)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in count():
            if i == len(self.kept):
                if self.room <= 0:
                    break
                drawn = next(self.next)
                most, whole = drawn.max(), self._whole(drawn)
                small = np.packbits(drawn.astype(bool), axis=1) if most <= 1 else drawn.astype(np.uint8 if most < 256 else float)
                self.kept.append((small, most <= 1, whole))
                self.room -= small.nbytes + whole.nbytes
            small, bits, whole = self.kept[i]
            yield (np.unpackbits(small, axis=1, count=self.n.shape[1]) if bits else small).astype(float), whole
        rng = np.random.default_rng()
        rng.bit_generator.state = self.rng.bit_generator.state
        for drawn in _bags(rng, self.n, self.bag):
            yield drawn, self._whole(drawn)

    def _whole(self, drawn: np.ndarray) -> np.ndarray:
        return _histograms(self.kinds, self.keys, drawn.reshape(-1), len(drawn))


def _boost(bags: Bags, rate: float, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple]]:
    """For each row of the bags' n (sides, kinds), the rows that a model learns from: the start value, the sum of the trees
    for each kind (kept up to date) and an endless supply of boosted trees of all models at once."""
    kinds, n = bags.kinds, bags.n
    y = kinds.y
    m = np.clip(n @ y / n.sum(1), 1e-6, 1 - 1e-6)
    start = np.log(m / (1 - m))
    f = np.repeat(start[:, None], len(y), axis=1)

    def grow() -> Iterator[tuple]:
        for drawn, whole in bags:
            p = _sigmoid(f.copy())
            weight = drawn * p
            target = drawn * y - weight
            weight -= np.multiply(weight, p, out=p)
            column, cut, mean, value = _level_trees(kinds, bags.keys, drawn, target, weight, depth, least, whole)
            np.add(f, np.multiply(value, rate, out=value), out=f)
            yield column, cut, mean

    return start, f, grow()


def _as_tuple(tree: tuple[np.ndarray, np.ndarray, np.ndarray], edges: list[np.ndarray], i: int = 0) -> tuple:
    """(column, cut, left, right) or a leaf (value,)."""
    column, cut, mean = tree
    if column[i] < 0:
        return (float(mean[i]),)
    return (int(column[i]), float(edges[column[i]][cut[i]]), _as_tuple(tree, edges, 2 * i + 1), _as_tuple(tree, edges, 2 * i + 2))


def fit_brt(x: np.ndarray, y: np.ndarray, seed: int = 0, trees: int = 100, rate: float = 0.1, depth: int = 2, bag: float = 0.75, least: int = 10, n: np.ndarray | None = None) -> dict:
    """Boosted trees on the logistic loss with Newton leaves and a bag fraction; n rows are alike. Kept with the sums of the
    trees by bins where there are at most GRID of them."""
    n = np.ones(len(y), np.int64) if n is None else n.astype(np.int64)
    kinds = Kinds.of(x, y, n, np.zeros(n.sum(), np.int64), 1)
    start, _, grown = _boost(Bags(kinds, kinds.rows, seed, bag), rate, depth, least)
    found = [tuple(part[0] for part in tree) for tree in islice(grown, trees)]
    table = np.zeros(tuple(kinds.widths)) if np.prod(kinds.widths.astype(float)) <= GRID else None
    if table is not None:
        for tree in found:
            _add_boxes(table, tree)
        for axis in range(table.ndim):
            np.cumsum(table, axis=axis, out=table)
    return {"family": "brt", "start": float(start[0]), "rate": rate, "trees": [_as_tuple(t, kinds.edges) for t in found], "depth": depth, "bag": bag, "edges": kinds.edges, "table": table}


def _fold_bags(kinds: Kinds, seed: int, bag: float = 0.75) -> list[tuple[np.ndarray, Bags]]:
    """(rows of held-out folds, bags of the rows outside each), some folds together where kinds are few."""
    y, n = kinds.y, kinds.rows.sum(0)
    tests = np.array([test for test in kinds.rows if test.any() and len(np.unique(y[n > test])) == 2])
    together = max(1, TOGETHER // len(y))  # few kinds: the folds' trees grow together
    parts = [(lo, tests[lo : lo + together]) for lo in range(0, len(tests), together)]
    return [(part, Bags(kinds, n - part, seed + lo, bag, KEPT * len(part) / len(tests))) for lo, part in parts]


def _best_trees(kinds: Kinds, folds: list[tuple[np.ndarray, Bags]], rate: float, step: int, most: int, tolerance: float) -> tuple[int, float] | None:
    """(number of trees, deviance a row) of the least mean deviance over the folds, as gbm.step finds it: all folds grow by
    step trees until the mean of ten steps lies less than tolerance of the null deviance below that of the ten before, or
    there are most trees. None (the fit fails) if the deviance rises within the first four steps."""
    y, n = kinds.y, kinds.rows.sum(0)
    if not folds:
        return None
    sides = [(tests, *_boost(bags, rate, 2, 10)[1:]) for tests, bags in folds]

    def loss(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return -2 * (rows * np.log(np.where(y > 0.5, p, 1 - p))).sum(-1) / rows.sum(-1)

    curve, enough = [], tolerance * loss(n, np.full(len(y), n @ y / n.sum()))
    while len(curve) * step < most:
        for _, _, grown in sides:
            for _ in islice(grown, step):
                pass
        curve.append(float(np.mean(np.concatenate([loss(test, logistic(f)) for test, f, _ in sides]))))
        if 1 < len(curve) < 5 and curve[-1] > curve[-2]:
            return None
        if len(curve) >= 20 and np.mean(curve[-20:-10]) - np.mean(curve[-10:]) <= enough:
            break
    return (int(np.argmin(curve)) + 1) * step, min(curve)


def search_brt(x: np.ndarray, y: np.ndarray, fold: np.ndarray | None = None, rate: float = 0.08, least_trees: int = 1000, most_trees: int = 5000, low: float = 1e-6, high: float = 1.0, rounds: int = 50, seed: int = 0, step: int = 50, tolerance: float = 0.001, n: np.ndarray | None = None) -> dict | None:
    """The learning rate that needs least_trees to most_trees trees by cross-validated deviance (ten folds balanced by class
    if none are given): halved when fewer are best or the fit fails, doubled when more would be; None on leaving the bounds
    and after so many rounds. n rows are alike, dealt to the folds each on its own; the rows' order has no part in the
    result."""
    n = np.ones(len(y), np.int64) if n is None else n.astype(np.int64)
    order = np.lexsort((y, *x.T)) if fold is None else np.arange(len(y))
    x, y, n = x[order], y[order], n[order]
    if fold is None:
        each, rng = np.repeat(y, n), np.random.default_rng(seed)
        parts = np.zeros(len(each), np.int64)
        for k in (0, 1):
            parts[each == k] = rng.permutation(int((each == k).sum())) % 10
    else:
        parts = np.repeat(np.unique(fold, return_inverse=True)[1].reshape(-1), n)
    kinds = Kinds.of(x, y, n, parts, int(parts.max()) + 1)
    folds = _fold_bags(kinds, seed)
    for _ in range(rounds):
        if not low <= rate <= high:
            return None
        best = _best_trees(kinds, folds, rate, step, 2 * most_trees, tolerance)
        if best and least_trees <= best[0] <= most_trees:
            return fit_brt(x, y, seed, best[0], rate, n=n) | {"best_trees": best[0], "cv_deviance": best[1]}
        rate = rate * 2 if best and best[0] > most_trees else rate / 2
    return None


#: Largest grid of bins over which a forest is kept as a table of its predictions.
GRID = 1 << 22


def _grow_level(codes: np.ndarray, n: np.ndarray, s: np.ndarray, widths: np.ndarray, depth: int, least: int, rng: np.random.Generator, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree on cells of binned columns with n drawn rows that sum to s, grown level by level, m columns tried
    at each node: (column or -1, cut, mean) of every node, the children of node i at 2 i + 1 and 2 i + 2."""
    size, d, wide = (1 << depth + 1) - 1, codes.shape[1], int(widths.max())
    column, cut, mean = np.full(size, -1, np.int8), np.zeros(size, np.int32), np.zeros(size)
    flat, at, where = codes.reshape(-1), np.flatnonzero(n), np.zeros(np.count_nonzero(n), np.int64)
    for level in range(depth + 1):
        first, nodes = (1 << level) - 1, 1 << level
        w, t = n[at], s[at]
        rows, total = np.bincount(where, w, nodes), np.bincount(where, t, nodes)
        mean[first : first + nodes] = total / np.maximum(rows, 1e-12)
        open_ = rows >= 2 * least
        if level == depth or not open_.any():
            break
        number = np.cumsum(open_) - 1  # only the nodes that may part have histograms
        own = np.flatnonzero(open_)
        keep = open_[where]
        at, where, w, t = at[keep], number[where[keep]], w[keep], t[keep]
        k, base = len(own), total[own] ** 2 / rows[own]
        tried = np.argsort(rng.random((k, d)), axis=1)[:, :m]
        gain, by, split = np.full(k, 1e-12), np.full(k, -1), np.zeros(k, np.int64)
        for c in tried.T:
            place = where * wide + flat[at * d + c[where]]
            left, sums = (np.bincount(place, v, k * wide).reshape(k, wide).cumsum(1) for v in (w, t))
            right, other = rows[own, None] - left, total[own, None] - sums
            fine = (left >= least) & (right >= least)
            new = np.where(fine, sums**2 / np.maximum(left, 1) + other**2 / np.maximum(right, 1) - base[:, None], -1)
            best = new.argmax(1)
            value = new[np.arange(k), best]
            more = value > gain
            gain[more], by[more], split[more] = value[more], c[more], best[more]
        column[first + own], cut[first + own] = by, split
        keep = by[where] >= 0
        at, where = at[keep], where[keep]
        where = 2 * own[where] + (flat[at * d + by[where]] > split[where])
    return column, cut, mean


def _add_boxes(table: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add the tree to a table of differences along every axis, of which the running sums are its values by bins."""
    column, cut, mean = tree
    shape = table.shape
    low, high, node = np.zeros((1, len(shape)), np.int64), np.array([shape]), np.zeros(1, np.int64)
    steps = np.array(table.strides) // table.itemsize
    flat = table.reshape(-1)
    while len(node):
        leaf = column[node] < 0
        a, b, v = low[leaf], high[leaf], mean[node[leaf]]
        for corner in range(1 << len(shape)):
            ends = np.array([corner >> j & 1 for j in range(len(shape))], bool)
            at = np.where(ends, b, a)
            inside = (at < shape).all(1)
            np.add.at(flat, (at[inside] * steps).sum(1), v[inside] * (-1) ** int(ends.sum()))
        low, high, node = low[~leaf], high[~leaf], node[~leaf]
        j, one = column[node], np.arange(len(node))
        middle = cut[node] + 1
        left_high, right_low = high.copy(), low.copy()
        left_high[one, j], right_low[one, j] = middle, middle
        low, high, node = np.concatenate([low, right_low]), np.concatenate([left_high, high]), np.concatenate([2 * node + 1, 2 * node + 2])


def _coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])


def _forest_sum(trees: list[tuple], codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for column, cut, mean in trees:
        node, inner = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(inner):
            at = node[inner]
            inner, at = inner[column[at] >= 0], at[column[at] >= 0]
            node[inner] = 2 * at + 1 + (codes[inner, column[at]] > cut[at])
        total += mean[node]
    return total


def fit_rf(x: np.ndarray, y: np.ndarray, seed: int = 0, trees: int = 1000, least: int = 5, depth: int = 12, n: np.ndarray | None = None) -> dict:
    """Regression forest on 0 / 1 with a third of the columns tried at each split; n rows are alike. Rows of one cell of the
    binned columns and one class are told apart by nothing, so that trees grow on cells with their drawn rows. The forest is
    kept as its means by bins where there are at most GRID of them, else as trees."""
    rng = np.random.default_rng(seed)
    n = np.ones(len(y), np.int64) if n is None else n.astype(np.int64)
    order = np.lexsort((y, *x.T))  # the rows' order has no part in the result
    x, y, n = x[order], y[order], n[order]
    every = np.repeat(np.arange(len(y), dtype=np.int32), n)
    edges = _weighed_edges(x, n)
    codes, widths = _coded(x, edges), np.array([len(e) + 1 for e in edges])
    cell = np.zeros(len(y), np.int64)
    for j, w in enumerate(widths):
        cell = np.unique(cell * w + codes[:, j], return_inverse=True)[1].reshape(-1)
    cells = int(cell.max()) + 1 if len(cell) else 0
    of_cell = np.zeros((cells, len(widths)), np.int32)
    of_cell[cell] = codes
    drawn_from = (2 * cell + (y > 0.5)).astype(np.int32)[every]
    m, grown = max(x.shape[1] // 3, 1), []
    table = np.zeros(tuple(widths)) if np.prod(widths.astype(float)) <= GRID else None
    for _ in range(trees):
        got = np.bincount(drawn_from[rng.integers(0, len(every), len(every), dtype=np.int32)], minlength=2 * cells).reshape(-1, 2)
        tree = _grow_level(of_cell, got.sum(1).astype(float), got[:, 1].astype(float), widths, depth, least, rng, m)
        if table is None:
            grown.append(tree)
        else:
            _add_boxes(table, tree)
    if table is not None:
        for axis in range(table.ndim):
            np.cumsum(table, axis=axis, out=table)
        table /= trees
    return {"family": "rf", "edges": edges, "trees": grown, "table": table}


def fit_nn(x: np.ndarray, y: np.ndarray, seed: int = 0, size: int = 3, decay: float = 0.1, starts: int = 5, rounds: int = 300, n: np.ndarray | None = None, block: int = 2048) -> dict:
    """One hidden layer, weight decay, the mean of several starts; trained by full-batch Adam; n rows are alike. All starts
    go over the rows together, in blocks that a processor's cache holds."""
    n = np.ones(len(y)) if n is None else n.astype(float)
    total = n.sum()
    mean = n @ x / total
    sd = np.sqrt(n @ (x - mean) ** 2 / total)
    sd = np.where(sd > 0, sd, 1)
    z, plain = np.column_stack([(x - mean) / sd, np.ones(len(x))]), bool((n == 1).all())
    nets = []
    for i in range(starts):
        rng = np.random.default_rng(seed + i)
        nets.append([rng.normal(0, 0.5, (z.shape[1], size)), rng.normal(0, 0.5, size + 1)])
    w = [np.concatenate([a for a, _ in nets], 1), np.stack([b for _, b in nets])]  # hidden side by side; a row a start
    of, one = np.repeat(np.arange(starts), size), np.arange(starts * size)
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, rounds + 1):
        out = np.zeros((starts * size, starts))
        out[one, of] = w[1][:, :-1].reshape(-1)
        grads = [np.zeros_like(a) for a in w]
        for lo in range(0, len(z), block):
            a = z[lo : lo + block]
            h = _sigmoid(a @ w[0])
            e = _sigmoid(h @ out + w[1][:, -1])
            e -= y[lo : lo + block, None]
            if not plain:
                e *= n[lo : lo + block, None]
            grads[1][:, :-1] += (h.T @ e)[one, of].reshape(starts, size)
            grads[1][:, -1] += e.sum(0)
            back = e @ out.T
            back *= h
            np.subtract(1, h, out=h)
            back *= h
            grads[0] += a.T @ back
        for k, g in enumerate(grads):
            g = (g + decay * w[k]) / total
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"family": "nn", "mean": mean, "sd": sd, "nets": [[w[0][:, of == i], w[1][i]] for i in range(starts)]}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """logistic, in place."""
    np.clip(z, -35, 35, out=z)
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _basis(c: np.ndarray, knots: np.ndarray) -> np.ndarray:
    above = [np.maximum(c - k, 0) for k in knots]
    return np.column_stack([c, *[a * a * a for a in above]])


def fit_gam(x: np.ndarray, y: np.ndarray, seed: int = 0, n: np.ndarray | None = None) -> dict:
    """Cubic splines with few knots a column and a ridge penalty; stronger penalties, then fewer columns, until it
    converges. n rows are alike."""
    n = np.ones(len(y), np.int64) if n is None else n.astype(np.int64)
    mean, sd = _scaling(x, n)
    z, columns = (x - mean) / sd, list(range(x.shape[1]))
    while columns:
        for penalty, k in ((0.1, 3), (1.0, 3), (10.0, 3), (1.0, 2), (10.0, 2)):
            knots = [np.unique(np.quantile(np.repeat(z[:, j], n), np.linspace(0, 1, k + 2)[1:-1])) for j in columns]
            design = lambda z, at=tuple(zip(columns, knots, strict=True)): np.column_stack([np.ones(len(z)), *[_basis(z[:, j], q) for j, q in at]])
            b, fine = newton(z, y, penalty, n=n, design=design)
            if fine:
                return {"family": "gam", "mean": mean, "sd": sd, "columns": columns, "knots": knots, "b": b}
        columns.remove(min(columns, key=lambda j: (n @ (x[:, j] != 0), j)))
    m = np.clip(n @ y / n.sum(), 1e-6, 1 - 1e-6)
    return {"family": "gam", "mean": mean, "sd": sd, "columns": [], "knots": [], "b": np.array([np.log(m / (1 - m))])}


FITTERS = {"logistic": fit_logistic, "glm": fit_glm, "ridge": fit_ridge, "brt": fit_brt, "brt_search": search_brt, "rf": fit_rf, "nn": fit_nn, "gam": fit_gam}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities, clamped to [0, 1]."""
    family = model["family"]
    if family == "ridge":
        p = logistic(model["b"][0] + x @ model["b"][1:])
    elif family == "brt":
        total = model["table"][tuple(_coded(x, model["edges"]).T)] if model["table"] is not None else sum(_eval(t, x) for t in model["trees"])
        p = logistic(model["start"] + model["rate"] * total)
    elif family == "rf":
        codes = _coded(x, model["edges"])
        p = model["table"][tuple(codes.T)] if model["table"] is not None else _forest_sum(model["trees"], codes) / len(model["trees"])
    else:
        z = (x - model["mean"]) / model["sd"]
        one = np.ones(len(z))
        if family == "glm":
            p = logistic(np.column_stack([one, *[z[:, j] ** k for j, k in model["terms"]]]) @ model["b"])
        elif family == "gam":
            p = logistic(np.column_stack([one, *[_basis(z[:, j], q) for j, q in zip(model["columns"], model["knots"], strict=True)]]) @ model["b"])
        else:
            z1 = np.column_stack([z, one])
            p = np.mean([logistic(np.column_stack([logistic(z1 @ w[0]), one]) @ w[1]) for w in model["nets"]], 0)
    return np.clip(p, 0, 1)
