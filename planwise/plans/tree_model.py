"""A tree model of plans: a recurrent layer over conditions, one over the plan tree from its leaves up, and two heads.

Nodes of a batch of plans are dense arrays by level, as encoding.levels() numbers them; a child slot of 0 is a
zero state. Gradients come from a small reverse-mode tape on numpy arrays. Batches are trained where they lie:
each task takes steps through its own batches from the round's weights, and the results are averaged by the
number of plans, so weights are all that reaches the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.plans import conditions, encoding

HIDDEN, INNER = 32, 48


class Var:
    """An array, and how its gradient reaches those it was made of."""

    def __init__(self, value: np.ndarray, parents: tuple = (), back=None):
        self.value, self.parents, self.back, self.grad = value, parents, back, None

    def add(self, g: np.ndarray) -> None:
        while g.ndim > self.value.ndim:
            g = g.sum(axis=0)
        for axis, n in enumerate(self.value.shape):
            if n == 1 and g.shape[axis] != 1:
                g = g.sum(axis=axis, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g


def _made(value, parents, *backs):
    return Var(value, parents, lambda g: [p.add(b(g)) for p, b in zip(parents, backs, strict=True)])


def plus(a, b):
    return _made(a.value + b.value, (a, b), lambda g: g, lambda g: g)


def times(a, b):
    return _made(a.value * b.value, (a, b), lambda g: g * b.value, lambda g: g * a.value)


def matmul(a, b):
    return _made(a.value @ b.value, (a, b), lambda g: g @ b.value.T, lambda g: a.value.T @ g)


def relu(a):
    return _made(np.maximum(a.value, 0), (a,), lambda g: g * (a.value > 0))


def sigmoid(a):
    s = 1 / (1 + np.exp(-np.clip(a.value, -30, 30)))
    return _made(s, (a,), lambda g: g * s * (1 - s))


def tanh(a):
    t = np.tanh(a.value)
    return _made(t, (a,), lambda g: g * (1 - t * t))


def columns(a, start, end):
    def back(g):
        out = np.zeros_like(a.value)
        out[:, start:end] = g
        return out

    return _made(a.value[:, start:end], (a,), back)


def rows(a, index):
    """Rows of a by 1-based places; 0 gives zeros."""

    def back(g):
        out = np.zeros((len(a.value) + 1, a.value.shape[1]))
        np.add.at(out, index, g)
        return out[1:]

    return _made(np.concatenate([np.zeros((1, a.value.shape[1])), a.value])[index], (a,), back)


def joined(parts):
    at = np.append(0, np.cumsum([p.value.shape[1] for p in parts]))
    backs = [lambda g, s=s, e=e: g[:, s:e] for s, e in zip(at, at[1:])]
    return _made(np.concatenate([p.value for p in parts], axis=1), tuple(parts), *backs)


def backward(loss: Var) -> None:
    order, seen, stack = [], set(), [(loss, False)]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(p, False) for p in v.parents]
    loss.grad = np.ones_like(loss.value)
    for v in reversed(order):
        if v.back is not None and v.grad is not None:
            v.back(v.grad)


def fresh_weights(ctx: conditions.Context, samples: int, hidden: int = HIDDEN, inner: int = INNER, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of a new model; samples: places of a bitmap."""
    r = np.random.default_rng(seed)
    some = lambda a, b: r.normal(size=(a, b)) / np.sqrt(a)
    node = len(conditions.PHYSICAL) + ctx.info_width + 2 * inner
    w = {"c_x": some(ctx.width, 4 * hidden), "c_h": some(hidden, 4 * hidden), "c_b": np.zeros((1, 4 * hidden)), "cond": some(hidden, inner), "cond_b": np.zeros((1, inner)), "sample": some(samples, inner), "sample_b": np.zeros((1, inner))}
    w |= {"t_x": some(node, 4 * hidden), "t_h": some(hidden, 4 * hidden), "t_b": np.zeros((1, 4 * hidden))}
    for head in ("cost", "cardinality"):
        w |= {f"{head}_1": some(hidden, inner), f"{head}_1b": np.zeros((1, inner)), f"{head}_2": some(inner, 1), f"{head}_2b": np.zeros((1, 1))}
    return w


def lstm(x: Var, h: Var, c: Var, w: dict[str, Var], name: str) -> tuple[Var, Var]:
    z = plus(plus(matmul(x, w[f"{name}_x"]), matmul(h, w[f"{name}_h"])), w[f"{name}_b"])
    n = h.value.shape[1]
    i, f, o, g = sigmoid(columns(z, 0, n)), sigmoid(columns(z, n, 2 * n)), sigmoid(columns(z, 2 * n, 3 * n)), tanh(columns(z, 3 * n, 4 * n))
    c = plus(times(f, c), times(i, g))
    return times(o, tanh(c)), c


def arrays(batch: pd.DataFrame, ctx: conditions.Context, samples: int) -> list[dict[str, np.ndarray]]:
    """Dense arrays of each level of a batch, from the root's."""
    out = []
    for _, level in batch.sort_values(["depth", "slot"]).groupby("depth"):
        n = len(level)
        operator, infos, bits = np.zeros((n, len(conditions.PHYSICAL))), np.zeros((n, ctx.info_width)), np.zeros((n, samples))
        for i, r in enumerate(level.itertuples(index=False)):
            if r.operator:
                operator[i, r.operator - 1] = 1
            for k in r.info:
                infos[i, k - 1] = 1
            if r.masked:
                own = r.bitmap or ""
                bits[i] = [c == "1" for c in own[:samples].ljust(samples, "0")] if own else 1.0
        cond = [np.stack([conditions.dense(x, ctx.most_items, ctx.width) for x in level[c]]) for c in ("condition1", "condition2")]
        out.append({"node": np.concatenate([operator, infos], axis=1), "bits": bits, "mask": level["masked"].to_numpy(float)[:, None], "c1": cond[0], "c2": cond[1], "left": level["left"].to_numpy(int), "right": level["right"].to_numpy(int), "plan": level["plan_id"].to_numpy()})
    return out


def forward(levels: list[dict[str, np.ndarray]], w: dict[str, Var]) -> tuple[Var, Var]:
    """Scaled cost and cardinality of each plan of a batch, in order of the root level."""
    hidden, half = w["c_h"].value.shape[0], Var(np.array([[0.5]]))
    h = c = None
    for x in reversed(levels):
        n = len(x["node"])
        embedded = []
        for cond in (x["c1"], x["c2"]):
            a, b = Var(np.zeros((n, hidden))), Var(np.zeros((n, hidden)))
            for k in range(cond.shape[1]):
                a, b = lstm(Var(cond[:, k]), a, b, w, "c")
            embedded.append(relu(plus(matmul(a, w["cond"]), w["cond_b"])))
        condition = times(plus(*embedded), half)
        sample = times(relu(plus(matmul(Var(x["bits"]), w["sample"]), w["sample_b"])), Var(x["mask"]))
        own = joined([Var(x["node"]), condition, sample])
        if h is None:
            h0 = c0 = Var(np.zeros((n, hidden)))
        else:
            h0 = times(plus(rows(h, x["left"]), rows(h, x["right"])), half)
            c0 = times(plus(rows(c, x["left"]), rows(c, x["right"])), half)
        h, c = lstm(own, h0, c0, w, "t")
    head = lambda k: sigmoid(plus(matmul(relu(plus(matmul(h, w[f"{k}_1"]), w[f"{k}_1b"])), w[f"{k}_2"]), w[f"{k}_2b"]))
    return head("cost"), head("cardinality")


def q_error(pred: np.ndarray, act: np.ndarray, low: float, high: float) -> np.ndarray:
    """max(p/t, t/p) of scaled labels."""
    return np.exp(np.abs(pred - act) * (high - low))


def q_errors(x: DataFrame, act: str, est: str) -> DataFrame:
    """(mean, median, greatest, worst_plan) of max(p/t, t/p) over plan_id, act and est."""
    e = F.greatest(F.col(est) / F.col(act), F.col(act) / F.col(est))
    return x.withColumn("e", e).agg(F.avg("e").alias("mean"), F.median("e").alias("median"), F.max("e").alias("greatest"), F.max_by("plan_id", "e").alias("worst_plan"))


def prepared(n: DataFrame, ctx: conditions.Context, labels: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """Encoded nodes of plans with labels (plan_id counts from 0), with batch_id, slots, scaled labels and a bitmap column."""
    x = encoding.child_slots(encoding.levels(encoding.batched(conditions.encoded(n, ctx))))
    y = labels.select("plan_id", *[encoding.label(F.col(c), *map(F.lit, getattr(ctx, c))).alias(c) for c in ("cost", "cardinality")])
    x = x.join(y, "plan_id")
    return x.withColumn("bitmap", F.lit(None).cast("string")) if bitmaps is None else x.join(bitmaps.select("plan_id", "pos", "bitmap"), ["plan_id", "pos"], "left")


def _targets(batch: pd.DataFrame, levels: list[dict]) -> dict[str, np.ndarray]:
    first = batch.drop_duplicates("plan_id").set_index("plan_id")
    return {c: first.loc[levels[0]["plan"], c].to_numpy(float)[:, None] for c in ("cost", "cardinality")}


def whole_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame for each batch of plans, from rows in order of batch_id."""
    held: list[pd.DataFrame] = []
    for p in parts:
        for i, b in p.groupby("batch_id"):
            if held and held[0]["batch_id"].iloc[0] != i:
                yield pd.concat(held)
                held = []
            held.append(b)
    if held:
        yield pd.concat(held)


def step_through(batches: Iterator[pd.DataFrame], w: dict[str, np.ndarray], ctx: conditions.Context, samples: int, rate: float) -> tuple[dict[str, np.ndarray], float, int]:
    """Weights after a pass of Adam over batches, the sum of losses (squared errors of scaled logarithms, of cost and cardinality) and the plans."""
    w = {k: a.copy() for k, a in w.items()}
    m, v, total, plans = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0.0, 0
    for t, batch in enumerate(batches, 1):
        levels = arrays(batch, ctx, samples)
        own = {k: Var(a) for k, a in w.items()}
        y, n = _targets(batch, levels), len(levels[0]["plan"])
        loss = None
        for name, p in zip(("cost", "cardinality"), forward(levels, own), strict=True):
            d = plus(p, Var(-y[name]))
            part = matmul(Var(np.full((1, n), 1.0 / n)), times(d, d))
            loss = part if loss is None else plus(loss, part)
        backward(loss)
        total, plans = total + float(loss.value[0, 0]) * n, plans + n
        for k, var in own.items():
            g = var.grad if var.grad is not None else np.zeros_like(w[k])
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, total, plans


def train(x: DataFrame, ctx: conditions.Context, samples: int = 1000, rounds: int = 10, rate: float = 3e-3, seed: int = 7, weights: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """(weights, mean loss of each round) from prepared() nodes; a batch's nodes, of 64 plans, meet in one task."""
    w, losses, context = weights or fresh_weights(ctx, samples, seed=seed), [], x.sparkSession.sparkContext
    x = x.repartition("batch_id").sortWithinPartitions("batch_id")
    for _ in range(rounds):
        shared = context.broadcast((w, ctx))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now, c = shared.value
            now, loss, n = step_through(whole_batches(parts), now, c, samples, rate)
            if n:
                yield pd.DataFrame({"n": [n], "loss": [loss], "weights": [pickle.dumps(now)]})

        got = x.mapInPandas(run, "n long, loss double, weights binary").collect()  # a row for each task
        total = sum(r.n for r in got)
        if not total:
            break
        each = [(r.n / total, pickle.loads(r.weights)) for r in got]
        w = {k: sum(share * a[k] for share, a in each) for k in w}
        losses.append(sum(r.loss for r in got) / total)
        shared.unpersist()
    return w, losses


def evaluated(x: DataFrame, w: dict[str, np.ndarray], ctx: conditions.Context, samples: int = 1000) -> DataFrame:
    """(plan_id, act_cost, est_cost, act_cardinality, est_cardinality) of prepared() nodes, on a batch's plans at a time."""
    shared = x.sparkSession.sparkContext.broadcast((w, ctx))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        now, c = shared.value
        levels = arrays(batch, c, samples)
        out = {"plan_id": levels[0]["plan"]}
        for name, p in zip(("cost", "cardinality"), forward(levels, {k: Var(a) for k, a in now.items()}), strict=True):
            low, high = getattr(c, name)
            out[f"act_{name}"] = np.exp(_targets(batch, levels)[name][:, 0] * (high - low) + low)
            out[f"est_{name}"] = np.exp(p.value[:, 0] * (high - low) + low)
        return pd.DataFrame(out)

    return x.groupBy("batch_id").applyInPandas(run, "plan_id bigint, act_cost double, est_cost double, act_cardinality double, est_cardinality double")
