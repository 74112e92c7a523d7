"""Forecasters in NumPy: GRU, LSTM and simple RNN over one time step, and a multi-layer perceptron.

All history of a window is one step's features and the initial state is zero, so each recurrent cell is a gated
feed-forward layer: RNN tanh(xW+b); LSTM s(o) tanh(s(i) tanh(g)); GRU (1 - s(z)) tanh(a + s(r) c), where c is the
bias of the candidate's recurrent part. Training is Adam on the squared error, seeded and single-threaded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from ..config import EPSILON
from ..session import ship

KINDS = ("gru", "lstm", "rnn", "mlp")
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Spec:
    """One model to train."""

    kind: str = "gru"
    units: int = 64
    layers: int = 3
    dropout: float = 0.2
    batch: int = 32
    epochs: int = 10
    rate: float = 1e-3
    seed: int = 7


#: Fixed parameters of the ten-minute models.
TEN_MINUTE = Spec(units=66, dropout=0.327, batch=16, epochs=10)


@dataclass
class Fitted:
    spec: Spec
    weights: Weights
    history: list[dict] = field(default_factory=list)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def init(spec: Spec, inputs: int, outputs: int) -> Weights:
    """Glorot-uniform matrices, zero biases."""
    rng = np.random.default_rng(spec.seed)

    def matrix(a: int, b: int) -> np.ndarray:
        edge = np.sqrt(6 / (a + b))
        return rng.uniform(-edge, edge, (a, b))

    gates = {"rnn": "h", "lstm": "igo", "gru": "zra"}.get(spec.kind)
    w: Weights = {}
    width = inputs
    if gates:
        for g in gates:
            w[f"W{g}"], w[f"b{g}"] = matrix(inputs, spec.units), np.zeros(spec.units)
        if spec.kind == "gru":
            w["c"] = np.zeros(spec.units)
        width = spec.units
    elif spec.kind == "mlp":
        for k in range(spec.layers):
            w[f"W{k}"], w[f"b{k}"] = matrix(width, spec.units), np.zeros(spec.units)
            width = spec.units
    else:
        raise ValueError(f"kind is one of {KINDS}")
    w["Wy"], w["by"] = matrix(width, outputs), np.zeros(outputs)
    return w


def _drop(h: np.ndarray, rate: float, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray | float]:
    if rng is None or rate <= 0:
        return h, 1.0
    mask = (rng.random(h.shape) >= rate) / (1 - rate)
    return h * mask, mask


def forward(spec: Spec, w: Weights, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, dict]:
    """Predictions, and what backward() needs. rng: dropout is on."""
    c: dict = {"x": x}
    if spec.kind == "mlp":
        h, c["mask_in"] = _drop(x, 0.1, rng)
        c["in"] = []
        for k in range(spec.layers):
            z = h @ w[f"W{k}"] + w[f"b{k}"]
            out, mask = _drop(np.maximum(z, 0), spec.dropout, rng)
            c["in"].append((h, z, mask))
            h = out
    else:
        pre = {g: x @ w[f"W{g}"] + w[f"b{g}"] for g in ("h" if spec.kind == "rnn" else "igo" if spec.kind == "lstm" else "zra")}
        if spec.kind == "rnn":
            c["h"] = h = np.tanh(pre["h"])
        elif spec.kind == "lstm":
            c["i"], c["g"], c["o"] = _sigmoid(pre["i"]), np.tanh(pre["g"]), _sigmoid(pre["o"])
            c["t"] = np.tanh(c["i"] * c["g"])
            h = c["o"] * c["t"]
        else:
            c["z"], c["r"] = _sigmoid(pre["z"]), _sigmoid(pre["r"])
            c["a"] = np.tanh(pre["a"] + c["r"] * w["c"])
            h = (1 - c["z"]) * c["a"]
        h, c["mask"] = _drop(h, spec.dropout, rng)
    c["last"] = h
    return h @ w["Wy"] + w["by"], c


def backward(spec: Spec, w: Weights, c: dict, dy: np.ndarray) -> Weights:
    """Gradients of the loss whose gradient by the predictions is dy."""
    g: Weights = {"Wy": c["last"].T @ dy, "by": dy.sum(axis=0)}
    dh = dy @ w["Wy"].T
    if spec.kind == "mlp":
        for k in reversed(range(spec.layers)):
            h, z, mask = c["in"][k]
            dz = dh * mask * (z > 0)
            g[f"W{k}"], g[f"b{k}"] = h.T @ dz, dz.sum(axis=0)
            dh = dz @ w[f"W{k}"].T
        return g
    dh = dh * c["mask"]
    if spec.kind == "rnn":
        pre = {"h": dh * (1 - c["h"] ** 2)}
    elif spec.kind == "lstm":
        ds = dh * c["o"] * (1 - c["t"] ** 2)
        pre = {"o": dh * c["t"] * c["o"] * (1 - c["o"]), "i": ds * c["g"] * c["i"] * (1 - c["i"]), "g": ds * c["i"] * (1 - c["g"] ** 2)}
    else:
        da = dh * (1 - c["z"]) * (1 - c["a"] ** 2)
        pre = {"z": -dh * c["a"] * c["z"] * (1 - c["z"]), "a": da, "r": da * w["c"] * c["r"] * (1 - c["r"])}
        g["c"] = (da * c["r"]).sum(axis=0)
    for k, d in pre.items():
        g[f"W{k}"], g[f"b{k}"] = c["x"].T @ d, d.sum(axis=0)
    return g


def scores(y: np.ndarray, p: np.ndarray, span: float) -> dict[str, float]:
    """Metrics as the training log has them: nrmse over the training targets' range."""
    rmse = float(np.sqrt(np.mean((y - p) ** 2)))
    smape = float(100 * np.mean(np.abs(y - p) / np.maximum(np.abs(y) + np.abs(p), EPSILON)))
    return {"rmse": rmse, "mae": float(np.mean(np.abs(y - p))), "nrmse": rmse / max(span, EPSILON), "smape": smape}


def _epoch(spec: Spec, state: tuple[Weights, Weights, Weights], t: int, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> int:
    """One pass of Adam over the rows in random order: changes weights and both moments; returns the steps so far."""
    w, m, v = state
    order = rng.permutation(len(x))
    for k in range(0, len(x), spec.batch):
        own = order[k : k + spec.batch]
        p, cache = forward(spec, w, x[own], rng)
        grads = backward(spec, w, cache, 2 * (p - y[own]) / p.size)
        t += 1
        for name, d in grads.items():
            m[name] = 0.9 * m[name] + 0.1 * d
            v[name] = 0.999 * v[name] + 0.001 * d * d
            w[name] = w[name] - spec.rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-7)
    return t


def train(spec: Spec, x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray) -> Fitted:
    """Adam on the mean squared error; the history has every epoch's metrics of both parts."""
    w = init(spec, x.shape[1], y.shape[1])
    rng = np.random.default_rng(spec.seed + 1)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    span, t, out = float(y.max() - y.min()) if y.size else 0.0, 0, Fitted(spec, w)
    for epoch in range(spec.epochs):
        t = _epoch(spec, (w, m, v), t, x, y, rng)
        row = {"epoch": epoch} | scores(y, forward(spec, w, x)[0], span)
        if len(x_val):
            row |= {f"val_{k}": s for k, s in scores(y_val, forward(spec, w, x_val)[0], span).items()}
        out.history.append(row)
    return out


#: Windows that a task of train_on holds, and states that meet in one average.
TRAIN_BLOCK, FAN_IN = 4096, 16


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _pack(state: tuple[Weights, ...]) -> bytes:
    return np.concatenate([a.ravel() for part in state for a in part.values()]).tobytes()


def _unpack(data: bytes, like: Weights) -> tuple[Weights, Weights, Weights]:
    flat, at, out = np.frombuffer(data), 0, []
    for _ in range(3):
        out.append({})
        for k, a in like.items():
            out[-1][k] = flat[at : at + a.size].reshape(a.shape).copy()
            at += a.size
    return tuple(out)


def train_on(windows: DataFrame, spec: Spec, key: str = "i", block: int = TRAIN_BLOCK) -> Fitted:
    """Trains on every window of the split `train`, with the metrics of every epoch on all of `train` and `val`.

    Windows are dealt by a hash of their keys to blocks of about `block`. In an epoch every block trains from the same
    weights and moments, and their averages, by windows, start the next; a single block is plain training. Averages
    meet FAN_IN at a time, so what a task or the driver holds doesn't grow with the windows.
    """
    spark = windows.sparkSession
    ship(spark)
    both = windows.filter(F.col("split").isin("train", "val")).select(key, "win_idx", "split", "x", "y")
    n = both.filter("split = 'train'").count()
    first = both.filter("split = 'train'").select(F.size("x").alias("a"), F.size("y").alias("b")).first()
    if first is None:
        raise ValueError("there are no windows to train on")
    blocks = -(-n // block)
    dealt = both.withColumn("block", F.pmod(F.xxhash64(F.col(key), "win_idx"), F.lit(blocks)).cast("int")).persist()
    w = init(spec, first["a"], first["b"])
    state, steps, out = (w, *({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))), 0, Fitted(spec, w)
    packed = "block int, n long, steps long, state binary"

    def average(rows):
        rows = rows.sort_by("block")
        counts = rows.column("n").to_numpy()
        total = sum(k * np.frombuffer(s) for k, s in zip(counts.tolist(), rows.column("state").to_pylist(), strict=True))
        data = (total / counts.sum()).tobytes()
        return pa.table({"block": pa.array([rows.column("block")[0].as_py() // FAN_IN], pa.int32()), "n": [int(counts.sum())], "steps": [int(rows.column("steps").to_numpy().max())], "state": pa.array([data], pa.binary())})

    def pass_of(epoch: int, steps: int, sent):
        def run(rows):
            rows = rows.sort_by([(key, "ascending"), ("win_idx", "ascending")])
            own = _unpack(sent.value, w)
            number = rows.column("block")[0].as_py()
            done = _epoch(spec, own, steps, _matrix(rows.column("x")), _matrix(rows.column("y")), np.random.default_rng([spec.seed, epoch, number]))
            return pa.table({"block": pa.array([number], pa.int32()), "n": [rows.num_rows], "steps": [done], "state": pa.array([_pack(own)], pa.binary())})

        return run

    for epoch in range(spec.epochs):
        sent = spark.sparkContext.broadcast(_pack(state))
        rows, left = dealt.filter("split = 'train'").groupBy("block").applyInArrow(pass_of(epoch, steps, sent), packed), blocks
        while left > 1:
            rows = rows.groupBy(F.floor(F.col("block") / FAN_IN)).applyInArrow(average, packed)
            left = -(-left // FAN_IN)
        (row,) = rows.collect()  # one row
        state, steps = _unpack(bytes(row["state"]), w), row["steps"]
        out.weights = state[0]
        out.history.append({"epoch": epoch} | _epoch_metrics(dealt, out))
        sent.unpersist()
    dealt.unpersist()
    return out


def _epoch_metrics(windows: DataFrame, fitted: Fitted) -> dict[str, float]:
    """Metrics of train and val as the training log has them, from sums of all windows."""
    sums = "split string, n long, sq double, ab double, sm double, low double, high double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in table.column("split").unique().to_pylist():
                own = table.filter(pc.equal(table.column("split"), name))
                y = _matrix(own.column("y"))
                p = forward(fitted.spec, fitted.weights, _matrix(own.column("x")))[0]
                e = np.abs(y - p)
                sm = e / np.maximum(np.abs(y) + np.abs(p), EPSILON)
                yield pa.RecordBatch.from_pydict({"split": [name], "n": [y.size], "sq": [float((e**2).sum())], "ab": [float(e.sum())], "sm": [float(sm.sum())], "low": [float(y.min())], "high": [float(y.max())]})

    parts = windows.select("split", "x", "y").mapInArrow(run, sums).groupBy("split")
    parts = parts.agg(*(F.sum(c).alias(c) for c in ("n", "sq", "ab", "sm")), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # two rows
    parts = {r["split"]: r for r in parts}
    span, out = max(parts["train"]["high"] - parts["train"]["low"], EPSILON), {}
    for name, prefix in (("train", ""), ("val", "val_")):
        if name in parts:
            r = parts[name]
            rmse = float(np.sqrt(r["sq"] / r["n"]))
            out |= {f"{prefix}rmse": rmse, f"{prefix}mae": r["ab"] / r["n"], f"{prefix}nrmse": rmse / span, f"{prefix}smape": 100 * r["sm"] / r["n"]}
    return out


def sample_matrices(windows: DataFrame, split: str, limit: int = 20_000, key: str = "i") -> tuple[np.ndarray, np.ndarray]:
    """Feature and target matrices of at most limit windows of a split, the first by a hash of their keys.

    The bound is what a trainer holds in memory; scoring and evaluation use every window.
    """
    rows = windows.filter(F.col("split") == split).select(key, "win_idx", "x", "y")
    rows = rows.orderBy(F.xxhash64(key, "win_idx"), key, "win_idx").limit(limit).toPandas()
    x, y = (np.array(rows[c].tolist(), dtype=np.float64).reshape(len(rows), -1) for c in ("x", "y"))
    return x, y


def score(windows: DataFrame, fitted: Fitted) -> DataFrame:
    """Adds yp, the prediction of every window, by one matrix product an Arrow batch; in the precision of x."""
    ship(windows.sparkSession)
    single = windows.schema["x"].dataType.elementType.typeName() == "float"
    dtype = np.float32 if single else np.float64
    spec, w = fitted.spec, {k: a.astype(dtype) for k, a in fitted.weights.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(batch.num_rows, -1)
            p = forward(spec, w, x)[0]
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yp = pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, yp], [*batch.schema.names, "yp"])

    schema = StructType([*windows.schema.fields, StructField("yp", ArrayType(FloatType() if single else DoubleType()))])
    return windows.mapInArrow(run, schema)


def model_rows(name: str, fitted: Fitted) -> list[tuple[str, str, list[int], list[float]]]:
    """Rows for sinks.write_model."""
    return [(name, k, list(a.shape), a.ravel().tolist()) for k, a in fitted.weights.items()]


def model_of(spec: Spec, stored: dict[str, tuple[list[int], list[float]]]) -> Fitted:
    """A model read back by sinks.read_model."""
    return Fitted(spec, {k: np.array(values).reshape(shape) for k, (shape, values) in stored.items()})
