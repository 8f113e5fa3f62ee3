"""Forecasters with one interface, and their registry. They run inside grouped maps, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Model:
    """fit(x, y, names), predict(x) -> signal, feature_importance() -> weights or None."""

    is_classifier = False
    signal_units = "return"

    def fit(self, x: np.ndarray, y: np.ndarray, names: Sequence[str]) -> Model:
        raise NotImplementedError

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def feature_importance(self) -> np.ndarray | None:
        return None

    @staticmethod
    def check(x: np.ndarray, y: np.ndarray) -> None:
        if len(x) != len(y) or not len(y) or np.isnan(y).any():
            raise ValueError("a fit needs as many rows as labels, at least one, and no missing label")


class Zero(Model):
    def fit(self, x, y, names):
        self.check(x, y)
        return self

    def predict(self, x):
        return np.zeros(len(x))


class TrainMean(Model):
    def fit(self, x, y, names):
        self.check(x, y)
        self.mean = float(y.mean())
        return self

    def predict(self, x):
        return np.full(len(x), self.mean)


class LastReturn(Model):
    def __init__(self, scale: float = 1.0, sign: float = 1.0):
        self.weight = scale * sign

    def fit(self, x, y, names):
        self.check(x, y)
        if "ret_1d" not in names:
            raise ValueError("this model needs the feature ret_1d")
        self.at = list(names).index("ret_1d")
        return self

    def predict(self, x):
        return self.weight * x[:, self.at]


class _Scaled(Model):
    """Standardises features (and, for regression, the target) by population deviation of the training rows."""

    def fit(self, x, y, names):
        self.check(x, y)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0)
        self.sd[self.sd < 1e-300] = 1.0
        z = (x - self.mean) / self.sd
        if self.is_classifier:
            self.constant = None if 0 < y.mean() < 1 else (1.0 if y.mean() > 0 else -1.0)
            if self.constant is None:
                self._fit(z, y)
        else:
            self.level, self.unit = float(y.mean()), float(y.std()) or 1.0
            self._fit(z, (y - self.level) / self.unit)
        return self

    def predict(self, x):
        if self.is_classifier and self.constant is not None:
            return np.full(len(x), self.constant)
        out = self._predict((x - self.mean) / self.sd)
        return 2 * out - 1 if self.is_classifier else self.level + self.unit * out

    def _fit(self, z, y):
        raise NotImplementedError

    def _predict(self, z):
        raise NotImplementedError


class Ridge(_Scaled):
    def __init__(self, alpha: float = 50.0):
        if alpha < 0:
            raise ValueError("alpha must not be negative")
        self.alpha = alpha

    def _fit(self, z, y):
        self.beta = np.linalg.solve(z.T @ z + self.alpha * np.eye(z.shape[1]), z.T @ y)

    def _predict(self, z):
        return z @ self.beta

    def feature_importance(self):
        return self.beta


class ElasticNet(_Scaled):
    """Coordinate descent on 1/(2n) |y - zb|^2 + alpha (l1 |b| + (1 - l1)/2 b^2)."""

    def __init__(self, alpha: float = 0.05, l1_ratio: float = 0.5, rounds: int = 500):
        self.alpha, self.l1, self.rounds = alpha, l1_ratio, rounds

    def _fit(self, z, y):
        n, k = z.shape
        gram, target, b = z.T @ z / n, z.T @ y / n, np.zeros(z.shape[1])
        for _ in range(self.rounds):
            old = b.copy()
            for j in range(k):
                rho = target[j] - gram[j] @ b + gram[j, j] * b[j]
                b[j] = np.sign(rho) * max(abs(rho) - self.alpha * self.l1, 0) / (gram[j, j] + self.alpha * (1 - self.l1))
            if np.abs(b - old).max() < 1e-8:
                break
        self.beta = b

    def _predict(self, z):
        return z @ self.beta

    def feature_importance(self):
        return self.beta


class Logistic(_Scaled):
    """Newton steps on the penalised log loss; C is the inverse penalty."""

    is_classifier = True
    signal_units = "probability"

    def __init__(self, C: float = 0.1, rounds: int = 50):  # noqa: N803
        self.c, self.rounds = C, rounds

    def _fit(self, z, y):
        a = np.column_stack((np.ones(len(z)), z))
        w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], 1 / self.c)
        penalty[0] = 1e-9
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def _predict(self, z):
        return 1 / (1 + np.exp(-np.clip(self.w[0] + z @ self.w[1:], -30, 30)))

    def feature_importance(self):
        return self.w[1:]


def grow_tree(code: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, depth: int, leaf: int, ridge: float, rng=None, tried: int | None = None):
    """Histogram tree: nodes as [feature, bin, left, right, value]; gains are summed into `gain` by feature."""
    k = code.shape[1]
    nodes, gain = [], np.zeros(k)

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([0, 0, -1, -1, float(g[rows].sum() / (h[rows].sum() + ridge))])
        if level == depth or len(rows) < 2 * leaf:
            return at
        cols = rng.choice(k, tried, replace=False) if tried else np.arange(k)
        flat = (code[np.ix_(rows, cols)] + np.arange(len(cols)) * bins).ravel()
        sums = [np.bincount(flat, np.repeat(v[rows], len(cols)), len(cols) * bins).reshape(len(cols), bins).cumsum(axis=1) for v in (g, h, np.ones(len(g)))]
        gl, hl, nl = sums
        tg, th, tn = g[rows].sum(), h[rows].sum(), len(rows)
        score = gl**2 / (hl + ridge + 1e-12) + (tg - gl) ** 2 / (th - hl + ridge + 1e-12) - tg**2 / (th + ridge + 1e-12)
        score[(nl < leaf) | (tn - nl < leaf)] = -np.inf
        best = int(score.argmax())
        j, b = divmod(best, bins)
        if not score[j, b] > 1e-12:
            return at
        gain[cols[j]] += score[j, b]
        below = code[rows, cols[j]] <= b
        left = grow(rows[below], level + 1)
        right = grow(rows[~below], level + 1)
        nodes[at][:4] = [int(cols[j]), int(b), left, right]
        return at

    grow(np.arange(len(g)), 0)
    return np.array(nodes), gain


def walk(tree: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = np.zeros(len(code), dtype=int)
    while True:
        node = tree[at]
        open_ = node[:, 2] >= 0
        if not open_.any():
            return node[:, 4]
        below = code[np.arange(len(code)), node[:, 0].astype(int)] <= node[:, 1]
        at = np.where(open_, np.where(below, node[:, 2], node[:, 3]), at).astype(int)


class _Trees(_Scaled):
    bins = 32

    def _code(self, z):
        return np.stack([np.searchsorted(c, z[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    def _cut(self, z):
        self.cuts = [np.unique(np.quantile(z[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(z.shape[1])]
        return self._code(z)

    def feature_importance(self):
        total = self.gain.sum()
        return self.gain / total if total > 0 else self.gain


class Forest(_Trees):
    def __init__(self, n_estimators: int = 300, max_depth: int = 5, min_samples_leaf: int = 20, random_state: int = 0, classifier: bool = False):
        self.n, self.depth, self.leaf, self.seed, self.is_classifier = n_estimators, max_depth, min_samples_leaf, random_state, classifier

    def _fit(self, z, y):
        rng, code = np.random.default_rng(self.seed), self._cut(z)
        self.trees, self.gain = [], np.zeros(z.shape[1])
        for _ in range(self.n):
            rows = rng.integers(0, len(y), len(y))
            tree, gain = grow_tree(code[rows], y[rows], np.ones(len(y)), self.bins, self.depth, self.leaf, 0.0, rng, max(1, int(np.sqrt(z.shape[1]))))
            self.trees.append(tree)
            self.gain += gain

    def _predict(self, z):
        code = self._code(z)
        return np.mean([walk(t, code) for t in self.trees], axis=0)


class Boosting(_Trees):
    def __init__(self, max_depth: int = 3, learning_rate: float = 0.03, max_iter: int = 200, min_samples_leaf: int = 40, l2: float = 1.0, classifier: bool = False):
        self.depth, self.rate, self.n, self.leaf, self.l2, self.is_classifier = max_depth, learning_rate, max_iter, min_samples_leaf, l2, classifier

    def _fit(self, z, y):
        code = self._cut(z)
        base = float(y.mean())
        self.start = float(np.log(base / (1 - base))) if self.is_classifier else base
        raw, self.trees, self.gain = np.full(len(y), self.start), [], np.zeros(z.shape[1])
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-raw)) if self.is_classifier else raw
            tree, gain = grow_tree(code, y - p, p * (1 - p) if self.is_classifier else np.ones(len(y)), self.bins, self.depth, self.leaf, self.l2)
            self.trees.append(tree)
            self.gain += gain
            raw = raw + self.rate * walk(tree, code)

    def _predict(self, z):
        code = self._code(z)
        raw = self.start + self.rate * np.sum([walk(t, code) for t in self.trees], axis=0)
        return 1 / (1 + np.exp(-raw)) if self.is_classifier else raw


class Perceptron(_Scaled):
    """Two hidden layers, full-batch Adam, weight decay alpha."""

    def __init__(self, hidden: tuple[int, ...] = (32, 16), alpha: float = 0.1, rounds: int = 200, rate: float = 0.01, random_state: int = 0):
        self.hidden, self.alpha, self.rounds, self.rate, self.seed = hidden, alpha, rounds, rate, random_state

    def _fit(self, z, y):
        rng = np.random.default_rng(self.seed)
        sizes = [z.shape[1], *self.hidden, 1]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        for step in range(1, self.rounds + 1):
            acts = [z]
            for i, (w, b) in enumerate(zip(self.w, self.b)):
                a = acts[-1] @ w + b
                acts.append(np.maximum(a, 0) if i + 1 < len(self.w) else a)
            back = (acts[-1] - y[:, None]) / len(y)
            gw, gb = [], []
            for i in range(len(self.w) - 1, -1, -1):
                gw.insert(0, acts[i].T @ back + self.alpha / len(y) * self.w[i])
                gb.insert(0, back.sum(axis=0))
                back = (back @ self.w[i].T) * (acts[i] > 0)
            for p, g, s in zip((*self.w, *self.b), (*gw, *gb), state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                p -= self.rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)

    def _predict(self, z):
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = z @ w + b
            z = np.maximum(z, 0) if i + 1 < len(self.w) else z
        return z[:, 0]


_REGISTRY: dict[str, Callable[..., Model]] = {
    "zero": Zero,
    "train_mean": TrainMean,
    "momentum": lambda scale=1.0: LastReturn(scale, 1.0),
    "reversion": lambda scale=1.0: LastReturn(scale, -1.0),
    "ridge": Ridge,
    "elastic_net": ElasticNet,
    "logistic": Logistic,
    "random_forest": Forest,
    "random_forest_classifier": lambda **k: Forest(classifier=True, **k),
    "gradient_boosting": Boosting,
    "gradient_boosting_classifier": lambda **k: Boosting(classifier=True, **k),
    "mlp": Perceptron,
}


def available_models() -> list[str]:
    return list(_REGISTRY)


def factory_of(name: str) -> Callable[..., Model]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(_REGISTRY)}")
    return _REGISTRY[name]


def create_model(name: str, **params) -> Model:
    return factory_of(name)(**params)


def register_model(name: str, factory: Callable[..., Model], *, overwrite: bool = False) -> None:
    if name in _REGISTRY and not overwrite:
        raise ValueError(f"{name!r} is registered already")
    _REGISTRY[name] = factory


def unregister_model(name: str) -> None:
    _REGISTRY.pop(name, None)


def probability_of_up(signal):
    """(signal + 1) / 2, for classifiers' signals; works on numbers, arrays and columns."""
    return (signal + 1) / 2
