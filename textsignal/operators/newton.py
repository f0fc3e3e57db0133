"""Grouped Newton steps: many small logistic regressions in the same few Spark jobs.

A *cell* is one value of the key columns (for example source, asset, horizon), a *fit* one pair of feature group and C
inside a cell.  Features are one array column; a feature group is a list of positions in it.  Per iteration one pass
over the train rows adds up loss, gradient and Hessian of all fits that still run, in every task and then per fit, and
one small system per fit gives its next coefficients (halved while the objective doesn't fall).  Cells and
coefficients stay in tables, so neither the number of cells nor that of rows reaches the driver; partial sums are
added one after another as they arrive, so what a task holds is bounded by the dimension.  A cell that can't be fitted is a row with a status, not an error.

Objective of a fit: sum(w * log loss) / n + |coefficients|^2 / (2 C n), with balanced class weights w; the intercept is
outside the penalty unless ``penalise_intercept``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.columns import finite_or_null
from textsignal.operators import prep
from textsignal.session import materialize

C_GRID = (0.01, 0.1, 1.0, 10.0)
BLOCK_VALUES = 1 << 14         # numbers in a packed block of rows, about
HELD_BYTES = 1 << 26           # partial sums that a task holds before it passes them on
TOLERANCE = 1e-9               # largest gradient entry of a converged fit
THRESHOLDS = 0.05 + np.arange(91) * ((0.95 - 0.05) / 90)      # F14


@dataclass
class Design:
    """Positions of every group, the C of every fit, and where a fit's coefficients lie in a flat array."""
    groups: dict[str, list[int]]
    c_grid: tuple[float, ...]
    penalise_intercept: bool

    def __post_init__(self):
        self.names = list(self.groups)
        self.positions = [np.asarray(p, np.int64) for p in self.groups.values()]
        self.n_fits = len(self.names) * len(self.c_grid)

    def at(self, fit: int) -> np.ndarray:
        return self.positions[fit // len(self.c_grid)]

    def c(self, fit: int) -> float:
        return self.c_grid[fit % len(self.c_grid)]

    def size(self, fit: int) -> int:
        return len(self.at(fit)) + 1

    def penalty(self, fit: int) -> np.ndarray:
        """Ones for the penalised coefficients; the intercept is the last."""
        return np.append(np.ones(self.size(fit) - 1), float(self.penalise_intercept))

    def split(self, fits, betas) -> list[tuple[int, np.ndarray]]:
        ends = np.cumsum([self.size(f) for f in fits])
        return list(zip([int(f) for f in fits], np.split(np.asarray(betas, float), ends[:-1])))

    def scores(self, x: np.ndarray, fit: int, beta: np.ndarray) -> np.ndarray:
        return x[:, self.at(fit)] @ beta[:-1] + beta[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1 + e)


def log_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - z * y


def solve_step(design: Design, fit: int, state: dict, loss: float, grad: np.ndarray, hess: np.ndarray, max_iter: int) -> dict:
    """The next state of a fit from the sums at ``state['beta']``."""
    s = dict(state)
    n, beta, lam = s["n_train"], np.asarray(s["beta"], float), design.penalty(fit) / (design.c(fit) * s["n_train"])
    objective = loss / n + 0.5 * float(lam @ (beta * beta))
    accepted = np.asarray(s["accepted"], float)
    first = s["iteration"] < 0
    if not np.isfinite(objective) and first:
        return s | {"status": "failed"}
    if first or objective <= s["objective"] + 1e-4 * s["step"] * s["slope"] + 1e-13 * abs(s["objective"]):
        g, h = grad / n + lam * beta, hess / n + np.diag(lam)
        try:
            way = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            way = np.full(len(g), np.nan)
        if not np.isfinite(way).all():
            return s | {"status": "failed"}
        s |= {"accepted": beta, "objective": objective, "train_loss": loss / n, "iteration": s["iteration"] + 1, "way": way,
              "slope": float(g @ way), "step": 1.0, "beta": beta + way, "gradient": float(np.abs(g).max())}
        if s["gradient"] <= TOLERANCE:
            s["status"] = "converged"
        elif s["iteration"] >= max_iter:
            s["status"] = "limit"
        return s
    s["step"] /= 2
    s["beta"] = accepted + s["step"] * np.asarray(s["way"], float)
    if s["step"] < 1e-9:                   # nothing is left to gain in this precision
        s["status"] = "converged" if s["gradient"] <= 1e-6 else "stalled"
    return s


STATE = ("cell string, fit int, n_train long, w0 double, w1 double, beta array<double>, accepted array<double>, way array<double>, objective double, "
         "train_loss double, slope double, step double, gradient double, iteration int, status string")


def _cell(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")


def _blocks_of(frame: pd.DataFrame, dim: int):
    for row in frame.itertuples(index=False):
        yield row, np.asarray(row.x, float).reshape(-1, dim)


def moments(rows: DataFrame, dim: int) -> DataFrame:
    """(cell, n, mean, m2) arrays per dimension over the values that are there; partial in tasks, then merged."""
    def merge(a, b):
        n = a[0] + b[0]
        d, safe = b[1] - a[1], np.maximum(n, 1)
        return n, a[1] + d * b[0] / safe, a[2] + b[2] + d * d * a[0] * b[0] / safe

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for cell, mine in batch.groupby("cell"):
                x = np.array([np.asarray(v, float) for v in mine["features"]]).reshape(-1, dim)
                there = ~np.isnan(x)
                n = there.sum(axis=0)
                mean = np.where(there, x, 0).sum(axis=0) / np.maximum(n, 1)
                now = n, mean, (np.where(there, x - mean, 0) ** 2).sum(axis=0)
                held[cell] = merge(held[cell], now) if cell in held else now
            if len(held) * dim * 24 > HELD_BYTES:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held):
        return pd.DataFrame({"cell": list(held), "n": [v[0] for v in held.values()], "mean": [v[1] for v in held.values()],
                             "m2": [v[2] for v in held.values()]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = out = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                now = np.asarray(r.n), np.asarray(r.mean, float), np.asarray(r.m2, float)
                if r.cell != cell and out is not None:
                    yield frame({cell: out})
                    out = None
                cell, out = r.cell, now if out is None else merge(out, now)
        if out is not None:
            yield frame({cell: out})

    ddl = "cell string, n array<long>, mean array<double>, m2 array<double>"
    parts = rows.select("cell", "features").mapInPandas(partial, ddl)
    return parts.repartition("cell").sortWithinPartitions("cell").mapInPandas(merged, ddl)


def statistics(rows: DataFrame, dim: int, split: str) -> DataFrame:
    """(cell, fill, mean, scale): train median, and mean and population deviation of the filled column (M1 + M2).  A
    dimension without a train value is 0 everywhere."""
    train = rows.where(F.col(split) == "train")
    m = moments(train, dim)
    gap = F.transform("features", lambda v: v.isNull())
    holes = rows.select(F.posexplode(gap).alias("j", "hole")).where("hole").select("j").distinct().collect()     # at most dim rows
    holes = sorted(r["j"] for r in holes)
    if holes:
        long = train.select("cell", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.get("features", F.lit(j)).alias("x")) for j in holes])))
        med = prep.exact_quantile(long, ["cell", "j"], 0.5, few=False)
        med = med.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("j", "quantile"))).alias("med"))
        m = m.join(med, "cell", "left")
    else:
        m = m.withColumn("med", F.lit(None).cast("map<int,double>"))
    m = m.withColumn("fill", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.try_element_at("med", j)))
    total = train.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))

    @F.pandas_udf("fill array<double>, mean array<double>, scale array<double>")
    def final(rows: pd.Series, n: pd.Series, mean: pd.Series, m2: pd.Series, fill: pd.Series) -> pd.DataFrame:
        out = []
        for r, k, a, b, f in zip(rows, n, mean, m2, fill):
            k, a, b, f = np.asarray(k, float), np.asarray(a, float), np.asarray(b, float), np.asarray(f, float)
            f = np.nan_to_num(f)
            mid = (k * a + (r - k) * f) / r
            std = np.sqrt((b + k * (a - mid) ** 2 + (r - k) * (f - mid) ** 2) / r)
            std = np.where(std > 1e-12 * np.maximum(np.abs(mid), 1e-300), std, 1.0)
            out.append((f, np.where(k > 0, mid, 0.0), np.where(k > 0, std, np.inf)))
        return pd.DataFrame(out, columns=["fill", "mean", "scale"])
    return m.join(total, "cell").select("cell", final("rows", "n", "mean", "m2", "fill").alias("s")).select("cell", "s.*")


def packed(rows: DataFrame, stats: DataFrame, counts: DataFrame, dim: int, keys: Sequence[str], y: str, split: str) -> DataFrame:
    """(cell, split, ids, y, x): standardised rows in blocks of bounded size; ``x`` holds the rows of a block one after another."""
    z = rows.join(stats, "cell").withColumn("z", F.transform("features", lambda v, i: (
        F.coalesce(v, F.get("fill", i)) - F.get("mean", i)) / F.get("scale", i)))
    sizes = counts.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n_rows") * dim / BLOCK_VALUES)).cast("int").alias("parts"))
    z = z.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(*keys), F.col("parts")))
    one = F.struct(F.struct(*keys).alias("id"), F.col(y).cast("double").alias("y"), F.col("z").alias("z"))
    g = z.groupBy("cell", F.col(split).alias("split"), "part").agg(F.collect_list(one).alias("held"))
    return g.select("cell", "split", F.col("held.id").alias("ids"), F.col("held.y").alias("y"), F.flatten("held.z").alias("x"))


def summed(blocks: DataFrame, fits: DataFrame, design: Design, dim: int, what: str) -> DataFrame:
    """Sums of every fit of every cell over the rows of its blocks: ``newton`` (loss, gradient, Hessian, weighted), ``loss``
    (plain) or ``tune`` (rows of each class above how many thresholds).  ``fits`` has (cell, fits, betas, w0, w1)."""
    def values(x, y, w, fit, beta):
        z = design.scores(x, fit, beta)
        if what == "tune":
            above = np.searchsorted(THRESHOLDS, sigmoid(z), side="right")
            return np.concatenate([np.bincount(above[y == c], minlength=len(THRESHOLDS) + 1) for c in (1, 0)]).astype(float)
        if what == "loss":
            return np.array([log_loss(z, y).sum(), len(y)])
        p = sigmoid(z)
        a = np.column_stack([x[:, design.at(fit)], np.ones(len(x))])
        return np.concatenate([[(w * log_loss(z, y)).sum()], a.T @ (w * (p - y)), ((a * (w * p * (1 - p))[:, None]).T @ a).ravel()])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        size = 0
        for batch in batches:
            for row, x in _blocks_of(batch, dim):
                y = np.asarray(row.y, float)
                w = np.where(y == 1, row.w1, row.w0)
                for place, (fit, beta) in enumerate(design.split(row.fits, row.betas)):
                    v = values(x, y, w, fit, beta)
                    key = row.cell, fit, place
                    if key in held:
                        held[key] += v
                    else:
                        held[key] = v
                        size += v.nbytes
            if size > HELD_BYTES:
                yield frame(held)
                held, size = {}, 0
        if held:
            yield frame(held)

    def frame(held):
        return pd.DataFrame([(*k, v) for k, v in held.items()], columns=["cell", "fit", "place", "sums"])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        for batch in batches:
            for key, v in zip(zip(batch["cell"], batch["fit"], batch["place"]), batch["sums"]):
                if key in out:
                    out[key] += v
                else:
                    if out:
                        yield frame(out)
                    out = {key: np.array(v)}
        if out:
            yield frame(out)

    ddl = "cell string, fit int, place int, sums array<double>"
    parts = blocks.join(fits, "cell").select("cell", "x", "y", "w0", "w1", "fits", "betas").mapInPandas(partial, ddl)
    keys = ["cell", "fit", "place"]
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(added, ddl)


def per_cell(state: DataFrame, beta: str, order: Sequence[str] = ("fit",)) -> DataFrame:
    """(cell, w0, w1, fits, betas): the fits of a cell in one row, their coefficients one after another."""
    g = state.groupBy("cell").agg(F.first("w0").alias("w0"), F.first("w1").alias("w1"),
                                  F.sort_array(F.collect_list(F.struct(*order, F.col(beta).alias("b")))).alias("held"))
    return g.select("cell", "w0", "w1", F.col("held.fit").alias("fits"), F.flatten("held.b").alias("betas"))


def newton(train: DataFrame, cells: DataFrame, design: Design, dim: int, max_iter: int) -> tuple[DataFrame, list[DataFrame]]:
    """The final state of every fit, and the state after each iteration."""
    zero = F.create_map(*[v for f in range(design.n_fits) for v in (F.lit(f), F.array_repeat(F.lit(0.0), design.size(f)))])
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(design.n_fits - 1))).alias("fit"), "n_train", "w0", "w1")
    zeros = F.element_at(zero, F.col("fit"))
    state = state.select("cell", "fit", "n_train", "w0", "w1", zeros.alias("beta"), zeros.alias("accepted"), zeros.alias("way"),
                         *[F.lit(0.0).alias(c) for c in ("objective", "train_loss", "slope", "step", "gradient")], F.lit(-1).alias("iteration"),
                         F.lit("run").alias("status"))
    state = materialize(state)
    names = state.columns
    seen = []

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in batch.to_dict("records"):
                v, fit = s.pop("sums"), int(s["fit"])
                if v is None:
                    out.append(s | {"status": "failed"})
                else:
                    v, d = np.asarray(v, float), design.size(fit)
                    out.append(solve_step(design, fit, s, float(v[0]), v[1:1 + d], v[1 + d:].reshape(d, d), max_iter))
            yield pd.DataFrame(out, columns=names)

    for _ in range(2 * max_iter + 60):      # every pass accepts a step or halves one
        running = state.where("status = 'run'")
        sums = summed(train, per_cell(running, "beta"), design, dim, "newton")
        moved = running.join(sums.drop("place"), ["cell", "fit"], "left").mapInPandas(step, STATE)
        state = materialize(state.where("status <> 'run'").unionByName(moved))
        seen.append(state)
        if not state.where("status = 'run'").limit(1).count():
            break
    return state, seen


@dataclass
class Grid:
    """A fitted grid: ``cells`` (by, n_rows, n_dates, status, error), ``selection`` (by, feature_group, ...) and, lazily,
    test predictions and the loss curves."""
    cells: DataFrame
    selection: DataFrame
    design: Design
    dim: int
    by: tuple[str, ...]
    blocks: DataFrame
    chosen: DataFrame
    states: list[DataFrame]

    def _back(self, df: DataFrame) -> DataFrame:
        names = self.cells.select("cell", *self.by)
        return (df.join(F.broadcast(names) if not self.by else names, "cell") if self.by else df).drop("cell")

    def predictions(self) -> DataFrame:
        """(by, keys, feature_group, y_true, y_proba, y_pred) of the test rows under the selected fit of each group."""
        design, dim = self.design, self.dim

        @F.pandas_udf("array<array<double>>")
        def proba(x: pd.Series, fits: pd.Series, betas: pd.Series) -> pd.Series:
            out = []
            for v, f, b in zip(x, fits, betas):
                rows = np.asarray(v, float).reshape(-1, dim)
                out.append(np.column_stack([sigmoid(design.scores(rows, fit, beta)) for fit, beta in design.split(f, b)]).tolist())
            return pd.Series(out, dtype=object)

        g = self.chosen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("fit", "threshold", "feature_group", "beta"))).alias("held"))
        fits = g.select("cell", F.col("held.fit").alias("fits"), F.flatten("held.beta").alias("betas"), F.col("held.threshold").alias("taus"),
                        F.col("held.feature_group").alias("names"))
        p = self.blocks.where("split = 'test'").join(fits, "cell")
        p = p.select("cell", "taus", "names", F.arrays_zip("ids", "y", proba("x", "fits", "betas").alias("p")).alias("rows"))
        p = p.select("cell", "taus", "names", F.inline_outer("rows")).select("cell", "ids.*", "y", F.inline_outer(F.arrays_zip("names", "taus", "p")))
        return self._back(p.select("cell", *[c for c in p.columns if c not in ("cell", "y", "names", "taus", "p", *self.by)],
                                   F.col("names").alias("feature_group"), F.col("y").cast("int").alias("y_true"), F.col("p").alias("y_proba"),
                                   (F.col("p") >= F.col("taus")).cast("int").alias("y_pred")))

    def trace(self) -> DataFrame:
        """(cell, fit, iteration, beta, objective, train_loss, w0, w1): the accepted coefficients of every iteration, from zero on."""
        out = None
        for k, state in enumerate(self.states):
            now = state.select("cell", "fit", "iteration", F.col("accepted").alias("beta"), "objective", "train_loss", "w0", "w1")
            out = now if out is None else out.unionByName(now)
        return out.where("iteration >= 0").dropDuplicates(["cell", "fit", "iteration"])

    def curves(self) -> DataFrame:
        """(by, feature_group, C, iteration, objective, train_loss, val_loss, is_best): weighted train loss and plain
        validation loss of the coefficients of every iteration, all from one pass; the first smallest val_loss is best."""
        t = materialize(self.trace())
        fits = per_cell(t, "beta", ("fit", "iteration"))
        place = F.row_number().over(Window.partitionBy("cell").orderBy("fit", "iteration")) - 1
        loss = summed(self.blocks.where("split = 'validation'"), fits, self.design, self.dim, "loss")
        t = t.withColumn("place", place).join(loss, ["cell", "fit", "place"])
        val = F.get("sums", F.lit(0)) / F.get("sums", F.lit(1))
        best = F.row_number().over(Window.partitionBy("cell", "fit").orderBy("val_loss", "iteration")) == 1
        names = F.array(*[F.lit(n) for n in self.design.names])
        grid = F.array(*[F.lit(float(c)) for c in self.design.c_grid])
        k = F.lit(len(self.design.c_grid))
        out = t.withColumn("val_loss", val).select(
            "cell", F.get(names, F.floor(F.col("fit") / k).cast("int")).alias("feature_group"), F.get(grid, F.col("fit") % k).alias("C"), "iteration",
            "objective", "train_loss", "val_loss", best.alias("is_best"), "beta")
        return self._back(out)


def tuned(design: Design, threshold: float | None, groups: Sequence[str]):
    """Picks C and threshold of a (cell, group): the best validation balanced accuracy; the first C, then the lowest
    threshold, wins ties."""
    def balanced(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        tp = pos.sum() - np.cumsum(pos)[:-1]
        tn = np.cumsum(neg)[:-1]
        recalls = ([tp / pos.sum()] if pos.sum() else []) + ([tn / neg.sum()] if neg.sum() else [])
        return sum(recalls) / len(recalls)

    def pick(mine: pd.DataFrame) -> pd.DataFrame:
        best = None
        for r in mine.sort_values("fit").itertuples(index=False):
            v = np.asarray(r.sums, float)
            pos, neg = np.split(v, 2)
            ba = balanced(pos, neg)
            at = int(np.argmax(ba)) if threshold is None else int(np.searchsorted(THRESHOLDS, threshold - 1e-9))
            if best is None or ba[at] > best[1]:
                best = r, float(ba[at]), float(THRESHOLDS[at] if threshold is None else threshold)
        r, ba, tau = best
        return pd.DataFrame([(r.cell, groups[r.fit // len(design.c_grid)], r.fit, design.c(r.fit), tau, ba, design.size(r.fit) - 1, r.iteration,
                              r.status, r.gradient, r.beta)])
    return pick


def fit_grid(rows: DataFrame, groups: Mapping[str, Sequence[int]], by: Sequence[str] = (), features: str = "features", y: str = "y",
             split: str = "split", keys: Sequence[str] = ("asset", "date"), date: str = "date", c_grid: Sequence[float] = C_GRID,
             max_iter: int = 100, threshold: float | None = None, penalise_intercept: bool = False, min_dates: int = 0) -> Grid:
    """Fits every group x C in every cell of ``by``: train-only imputation and scaling, balanced class weights, C and
    threshold by validation balanced accuracy (a fixed ``threshold`` must be a value of the grid).

    Status of a cell: ``ok``, ``too_few_dates`` (fewer than ``min_dates``), ``one_class`` (train has one), ``empty_split``
    (a split has no rows) or ``failed`` (no group could be solved); ``error`` says why.  Cells that aren't ok have no
    selection and no predictions."""
    if threshold is not None and np.abs(THRESHOLDS - threshold).min() > 1e-9:
        raise ValueError("the threshold must be a value of the grid")
    groups = {g: list(p) for g, p in groups.items() if len(p)}
    design = Design(groups, tuple(float(c) for c in c_grid), penalise_intercept)
    own = rows.select(*dict.fromkeys([*by, *keys]), F.col(y).cast("int").alias("y"), F.col(split).alias("split"), F.col(date).alias("_date"),
                      F.transform(F.col(features).cast("array<double>"), finite_or_null).alias("features"), _cell(by).alias("cell"))
    own = materialize(own)
    dim = own.agg(F.max(F.size("features"))).first()[0] or 0
    is_train = F.col("split") == "train"
    counts = own.groupBy("cell", *by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("_date").alias("n_dates"), F.count_if(is_train).alias("n_train"),
        F.count_if(is_train & (F.col("y") == 0)).alias("n0"), F.count_if(is_train & (F.col("y") == 1)).alias("n1"),
        F.count_if(F.col("split") == "validation").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test"))
    reason = F.when(F.col("n_dates") < min_dates, F.concat(F.lit("too_few_dates: "), F.col("n_dates"), F.lit(f" of {min_dates} dates"))) \
        .when((F.col("n_train") == 0) | (F.col("n_val") == 0) | (F.col("n_test") == 0), F.concat(
            F.lit("empty_split: "), F.col("n_train"), F.lit(" train, "), F.col("n_val"), F.lit(" validation, "), F.col("n_test"), F.lit(" test rows"))) \
        .when((F.col("n0") == 0) | (F.col("n1") == 0), F.concat(F.lit("one_class: train holds "), F.col("n0"), F.lit(" falls and "), F.col("n1"), F.lit(" rises")))
    counts = materialize(counts.select(
        "*", F.coalesce(F.regexp_extract(reason, "^([a-z_]+):", 1), F.lit("ok")).alias("status"), F.regexp_extract(reason, ": (.*)$", 1).alias("error"),
        F.try_divide(F.col("n_train"), 2 * F.col("n0")).alias("w0"),
        F.try_divide(F.col("n_train"), 2 * F.col("n1")).alias("w1")))
    good = counts.where("status = 'ok'")
    own = own.join(good.select("cell"), "cell", "left_semi")
    blocks = materialize(packed(own, statistics(own, dim, "split"), good, dim, list(keys), "y", "split"))
    state, seen = newton(blocks.where("split = 'train'"), good, design, dim, max_iter)
    solved = state.where("status <> 'failed'")
    sums = summed(blocks.where("split = 'validation'"), per_cell(solved, "accepted"), design, dim, "tune")
    k = len(design.c_grid)
    scored = sums.join(solved.select("cell", "fit", "iteration", "status", "gradient", F.col("accepted").alias("beta")), ["cell", "fit"])
    chosen = materialize(scored.withColumn("at", F.floor(F.col("fit") / k)).groupBy("cell", "at").applyInPandas(
        tuned(design, threshold, design.names),
        "cell string, feature_group string, fit int, selected_C double, threshold double, val_balanced_accuracy double, n_features int, "
        "iterations int, fit_status string, gradient double, beta array<double>"))
    solved_cells = chosen.select("cell").distinct().withColumn("_fitted", F.lit(True))
    lost = (F.col("status") == "ok") & F.col("_fitted").isNull()
    cells = counts.join(solved_cells, "cell", "left").select(
        "cell", *by, "n_rows", "n_dates", F.when(lost, "failed").otherwise(F.col("status")).alias("status"),
        F.when(lost, "no group could be solved").otherwise(F.col("error")).alias("error"))
    cells = materialize(cells.withColumn("error", F.when(F.col("error") != "", F.col("error"))))
    grid = Grid(cells, chosen, design, dim, tuple(by), blocks, chosen, seen)
    grid.selection = grid._back(chosen.select("cell", "feature_group", "selected_C", F.col("threshold").alias("selected_threshold"),
                                              "val_balanced_accuracy", "n_features", "iterations", "fit_status", "gradient"))
    return grid
