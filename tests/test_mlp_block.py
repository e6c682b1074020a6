"""Training a block: nets of different models share nothing, and those that have stopped cost nothing."""

import numpy as np
import pytest

from routelens.operators import learned as L


def block(hidden, act, seed=3, rows=450):
    rng = np.random.default_rng(seed)
    shapes, per, act, lr = L._specs([(hidden, act, 0.01)], 6)[0]
    x = rng.normal(size=(rows, 6))
    y = np.column_stack([np.sin(x[:, 0]), x[:, 1] * x[:, 2], rng.normal(size=rows)])
    y[rng.random(y.shape) < 0.1] = np.nan
    y[:, 2][200:] = np.nan                   # whole batches may know no grade of a model
    return rng.normal(size=(3, per)) * 0.3, shapes, act, lr, x, y


def plain(theta, shapes, act, lr, x, y, alpha, epochs, seed):
    """One model's net, trained by finite steps written out: forward, backward, Adam."""
    f = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "logistic": lambda z: 1 / (1 + np.exp(-z)), "identity": lambda z: z}[act]
    d = {"relu": lambda h: h > 0, "tanh": lambda h: 1 - h * h, "logistic": lambda h: h * (1 - h), "identity": lambda h: 1.0}[act]
    rng, m, v, t, theta = np.random.default_rng(seed), 0.0, 0.0, 0, theta.copy()
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), L.BATCH):
            rows = order[at:at + L.BATCH]
            k = ~np.isnan(y[rows])
            n, ws, o = max(k.sum(), 1), [], 0
            for a, b in shapes:
                ws.append((theta[o:o + a * b].reshape(a, b), theta[o + a * b:o + a * b + b]))
                o += a * b + b
            hs = [x[rows]]
            for i, (w, b) in enumerate(ws):
                hs.append(hs[-1] @ w + b if i == len(ws) - 1 else f(hs[-1] @ w + b))
            dz, parts = np.where(k, hs[-1][:, 0] - np.nan_to_num(y[rows]), 0.0)[:, None] / n, []
            for i in range(len(ws) - 1, -1, -1):
                parts.append(np.concatenate([(hs[i].T @ dz + alpha / n * ws[i][0]).ravel(), dz.sum(axis=0)]))
                dz = (dz @ ws[i][0].T) * d(hs[i]) if i else dz
            g, t = np.concatenate(parts[::-1]), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            if k.any():
                theta = theta - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta


@pytest.mark.parametrize("act", ["relu", "tanh", "logistic", "identity"])
@pytest.mark.parametrize("hidden", [(5,), (7, 4)])
def test_every_net_is_trained_as_if_alone(hidden, act):
    theta, shapes, act, lr, x, y = block(hidden, act)
    before = theta.copy()
    moved, sse = L._train_block(theta, np.array([True, False, True]), shapes, act, lr, x, y, 1e-4, 4, 11)
    assert (theta == before).all() and (moved[1] == theta[1]).all()
    for m in (0, 2):
        assert np.allclose(moved[m], plain(theta[m], shapes, act, lr, x, y[:, m], 1e-4, 4, 11), rtol=1e-9, atol=1e-12)
    alone = L._mlp_forward(x, theta, shapes, act)
    assert np.allclose(sse, np.nansum((alone - y) ** 2, axis=0))


def test_stopped_nets_cost_no_training(monkeypatch):
    theta, shapes, act, lr, x, y = block((5,), "relu")
    worked, (f, *rest) = [], L._ACT["relu"]
    monkeypatch.setitem(L._ACT, "relu", (lambda z: worked.append(z.size) or f(z), *rest))

    def values(on):
        worked.clear()
        L._train_block(theta, np.array(on), shapes, act, lr, x, y, 1e-4, 6, 11)
        return sum(worked)

    every, none = values([True] * 3), values([False] * 3)
    assert none == 3 * 5 * len(x)                                       # the loss before, of every model
    assert values([True, False, False]) - none == (every - none) / 3
