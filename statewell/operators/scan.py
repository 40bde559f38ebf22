"""Filters, smoothing, likelihood, Viterbi paths and E-steps of hidden Markov models over blocks of bars.

Passing a block of bars is one K x K matrix: in the log semiring for sums over paths, in
max-plus for the best one. Of ``rows`` (:func:`block_rows`)

1. each block of a series reduces its bars to a matrix, by pairs, in its own task;
2. a prefix product over the matrices of a series (one row a block) gives what enters
   each block from before and, backwards, what leaves it;
3. blocks are filled in, each in its own task.

No task holds more than a block of bars, or a matrix a block of one series. Models are rows
(series, id, model as JSON), so several models of a series run over the same blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BARS, numbered
from ..functions.tables import stored
from . import hmm, moments
from . import recursions as rec

KEYS = ["series", "block"]


def block_rows(df: DataFrame, features: list[str], bars: int = BARS) -> DataFrame:
    """series, t, features, n and block of each bar, dealt by block.

    The number of partitions is given, as few bytes are much work here.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return numbered(df.select("series", "t", *features), bars).repartition(tasks, *KEYS)


def one_model(model: dict, df: DataFrame) -> DataFrame:
    """The same model, with id "", for each series of ``df``."""
    return df.select("series").distinct().select("series", F.lit("").alias("id"), F.lit(hmm.to_json(model)).alias("model"))


def gaussian_model(start, trans, means, sds, feature: str) -> dict:
    """A model of one unscaled feature."""
    means, sds = np.asarray(means, float), np.asarray(sds, float)
    return {"start": np.asarray(start, float), "trans": np.asarray(trans, float), "means": means[:, None], "covs": (sds**2)[:, None, None], "dofs": None, "mean": np.zeros(1), "sd": np.ones(1), "features": [feature]}


def density(model: dict, bars: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled bars, their log densities and squared distances in each state."""
    x = (bars[model["features"]].to_numpy(float) - model["mean"]) / model["sd"]
    return x, *hmm.log_density(x, model["means"], model["covs"], model["dofs"])


def _sum_paths(a: np.ndarray, axis: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return rec.logsumexp(a, axis)


SEMIRINGS = {"sum": _sum_paths, "max": lambda a, axis: a.max(axis)}


def block_matrix(log_b: np.ndarray, trans: np.ndarray, semiring: str, stays: bool) -> np.ndarray:
    """Weights of all paths (or the best) through a block, from the state before it to its last state.

    ``stays``: no transition leads into its first bar, as at the start of a series.
    """
    add = SEMIRINGS[semiring]
    with np.errstate(divide="ignore"):
        log_a = np.log(trans)
        first = np.log(np.eye(len(trans))) if stays else log_a
    m = np.repeat(log_a[None], len(log_b), 0)
    m[0] = first
    m = m + log_b[:, None, :]
    while len(m) > 1:  # products of neighbours, all at once
        odd = m[len(m) // 2 * 2 :]
        left, right = m[0 : len(m) - len(odd) : 2], m[1::2]
        m = np.concatenate([add(left[:, :, :, None] + right[:, None], 2), odd])
    return m[0]


def _decoded(head: pd.DataFrame):
    """Rows and models; a model whose covariances are not positive definite is dropped, in every block alike."""
    for row in head.itertuples(index=False):
        model = hmm.from_json(row.model)
        try:
            np.linalg.cholesky(model["covs"])
        except np.linalg.LinAlgError:
            continue
        yield row, model


def _heads(rows: DataFrame, models: DataFrame) -> DataFrame:
    heads = rows.select(*KEYS).distinct().join(models.select("series", "id", "model"), "series")
    return heads.toDF(*heads.columns)  # columns of its own, as both sides of a cogroup come from the same rows


def _matrices(rows: DataFrame, heads: DataFrame, semiring: str, moves_first: bool) -> DataFrame:
    def run(bars: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("n")
        out = []
        for row, model in _decoded(head):
            _, log_b, _ = density(model, bars)
            m = block_matrix(log_b, model["trans"], semiring, row.block == 0 and not moves_first)
            out.append((row.series, row.block, row.id, row.model, m.ravel().tolist()))
        return pd.DataFrame(out, columns=[*KEYS, "id", "model", "matrix"])

    schema = "series string, block long, id string, model string, matrix array<double>"
    return rows.groupBy(*KEYS).cogroup(heads.groupBy(*KEYS)).applyInPandas(run, schema)


def _links(matrices: DataFrame, semiring: str) -> DataFrame:
    """What enters and leaves each block, the state the best path leaves it in, and the likelihood of all bars."""
    add = SEMIRINGS[semiring]
    columns = [*KEYS, "id", "model", "enter", "leave", "last", "log_likelihood"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        model = hmm.from_json(g["model"].iloc[0])
        k = len(model["start"])
        m = np.array(g["matrix"].tolist()).reshape(-1, k, k)
        with np.errstate(divide="ignore"):
            s = np.log(model["start"])
        enter, leave, total = np.empty((len(m), k)), np.empty((len(m), k)), 0.0
        for b, step in enumerate(m):
            enter[b] = s
            s = add(s[:, None] + step, 0)
            top = float(add(s, 0))
            s, total = s - top, total + top
        e, last = np.zeros(k), np.empty(len(m), int)
        state = int(s.argmax())
        for b in range(len(m) - 1, -1, -1):
            leave[b], last[b] = e, state
            e = add(m[b] + e, 1)
            e = e - e.max()
            state = int((enter[b] + m[b][:, state]).argmax())
        return pd.DataFrame({"series": g["series"], "block": g["block"], "id": g["id"], "model": g["model"], "enter": enter.tolist(), "leave": leave.tolist(), "last": last, "log_likelihood": total}, columns=columns)

    schema = "series string, block long, id string, model string, enter array<double>, leave array<double>, last int, log_likelihood double"
    return matrices.groupBy("series", "id").applyInPandas(run, schema)


def log_likelihood(rows: DataFrame, models: DataFrame) -> DataFrame:
    """series, id, log_likelihood of all bars of each series under each of its models."""
    links = _links(_matrices(rows, _heads(rows, models), "sum", False), "sum")
    return links.where("block = 0").select("series", "id", "log_likelihood")


def _filled(rows: DataFrame, links: DataFrame, kernel, kind: str) -> DataFrame:
    def run(bars: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("n")
        out = []
        for row, model in _decoded(head):
            _, log_b, _ = density(model, bars)
            value = kernel(log_b, model, row)
            out.append(pd.DataFrame({"series": row.series, "id": row.id, "t": bars["t"].to_numpy(), "value": value.tolist()}))
        return pd.concat(out) if out else pd.DataFrame({"series": [], "id": [], "t": [], "value": []}, dtype=object)

    return rows.groupBy(*KEYS).cogroup(links.groupBy(*KEYS)).applyInPandas(run, f"series string, id string, t long, value {kind}")


def filtered(rows: DataFrame, models: DataFrame) -> DataFrame:
    """series, id, t, value: causal state probabilities; a transition leads into every bar, the first too."""
    links = _links(_matrices(rows, _heads(rows, models), "sum", True), "sum")
    return _filled(rows, links, lambda log_b, model, row: rec.online_filter(log_b, model["start"], model["trans"], np.asarray(row.enter)), "array<double>")


def _smooth(log_b: np.ndarray, model: dict, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alpha = rec.forward(log_b, model["start"], model["trans"], None if row.block == 0 else np.asarray(row.enter))
    beta = rec.backward(log_b, model["trans"], np.asarray(row.leave))
    g = alpha + beta
    return alpha, beta, np.exp(g - rec.logsumexp(g, 1)[:, None])


def smoothed(rows: DataFrame, models: DataFrame) -> DataFrame:
    """series, id, t, value: state probabilities given all bars of the series."""
    links = _links(_matrices(rows, _heads(rows, models), "sum", False), "sum")
    return _filled(rows, links, lambda *x: _smooth(*x)[2], "array<double>")


def viterbi(rows: DataFrame, models: DataFrame) -> DataFrame:
    """series, id, t, value: the likeliest path; of ties the smallest state, looking back from the end."""
    links = _links(_matrices(rows, _heads(rows, models), "max", False), "max")
    return _filled(rows, links, lambda log_b, model, row: rec.viterbi(log_b, model["start"], model["trans"], None if row.block == 0 else np.asarray(row.enter), int(row.last)), "int")


def decode(rows: DataFrame, models: DataFrame) -> DataFrame:
    """series, id, t, state, smoothed and filtered."""
    keys = ["series", "id", "t"]
    out = viterbi(rows, models).withColumnRenamed("value", "state")
    out = out.join(smoothed(rows, models).withColumnRenamed("value", "smoothed"), keys)
    return out.join(filtered(rows, models).withColumnRenamed("value", "filtered"), keys)


# --- expectation maximisation over blocks ---


def block_statistics(log_b: np.ndarray, x: np.ndarray, maha: np.ndarray, model: dict, row) -> np.ndarray:
    """What one M-step needs of a block, as one vector; squares are taken around the current means."""
    k, d = len(model["start"]), x.shape[1]
    alpha, beta, gamma = _smooth(log_b, model, row)
    with np.errstate(divide="ignore"):
        log_a = np.log(model["trans"])
    before = alpha[:-1] if row.block == 0 else np.vstack([np.asarray(row.enter)[None], alpha[:-1]])
    after = (log_b + beta)[len(log_b) - len(before) :]
    moves = np.zeros((k, k))
    if len(before):
        pair = before[:, :, None] + log_a + after[:, None, :]
        flat = pair.reshape(len(pair), -1)
        moves = np.exp(flat - rec.logsumexp(flat, 1)[:, None]).sum(0).reshape(k, k)
    dofs = model["dofs"]
    u = np.ones_like(gamma) if dofs is None else (dofs + d) / (dofs + maha)
    w = gamma * u
    away = x[:, None, :] - model["means"]
    squares = np.einsum("tk,tki,tkj->kij", w, away, away)
    first = gamma[0] if row.block == 0 else np.zeros(k)
    return np.concatenate([first, moves.ravel(), gamma.sum(0), w.sum(0), (gamma * (np.log(u) - u)).sum(0), np.einsum("tk,tki->ki", w, away).ravel(), squares.ravel()])


def improved(model: dict, sums: np.ndarray, covariance: str) -> dict:
    """The model that fits summed statistics best."""
    k, d = model["means"].shape
    cuts = np.cumsum([k, k * k, k, k, k, k * d])
    first, moves, n, weight, level, shift, squares = np.split(sums, cuts)
    first, moves = np.maximum(first, 1e-12), np.maximum(moves.reshape(k, k), 1e-12)
    n, shift = n + 1e-12, shift.reshape(k, d)
    step = shift / (weight[:, None] + 1e-12)  # from the old means to the new
    covs = squares.reshape(k, d, d) - np.einsum("ki,kj->kij", step, shift) - np.einsum("ki,kj->kij", shift, step) + weight[:, None, None] * np.einsum("ki,kj->kij", step, step)
    out = model | {"start": first / first.sum(), "trans": moves / moves.sum(1, keepdims=True), "means": model["means"] + step, "covs": hmm.reduce_covariance(covs / n[:, None, None], n, covariance)}
    if model["dofs"] is not None:
        out["dofs"] = hmm.next_dofs(model["dofs"], level / n, d)
    return out


def em_round(rows: DataFrame, models: DataFrame, covariance: str = "full") -> DataFrame:
    """series, id, model, log_likelihood: each model after one round, and the likelihood before it.

    Blocks give vectors of statistics; Spark sums them, first within
    tasks, and only sums meet by model.
    """
    links = _links(_matrices(rows, _heads(rows, models), "sum", False), "sum")

    def run(bars: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("n")
        out = []
        for row, model in _decoded(head):
            x, log_b, maha = density(model, bars)
            out.append((row.series, row.id, block_statistics(log_b, x, maha, model, row).tolist()))
        return pd.DataFrame(out, columns=["series", "id", "sums"])

    parts = rows.groupBy(*KEYS).cogroup(links.groupBy(*KEYS)).applyInPandas(run, "series string, id string, sums array<double>")
    sums = parts.select("series", "id", F.posexplode("sums").alias("i", "v")).groupBy("series", "id", "i").agg(F.sum("v").alias("v"))
    sums = sums.groupBy("series", "id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("series", "id", F.col("s.v").alias("sums"))
    both = sums.join(links.where("block = 0").select("series", "id", "model", "log_likelihood"), ["series", "id"])

    def step(batches):
        for b in batches:
            b["model"] = [hmm.to_json(improved(hmm.from_json(m), np.asarray(s), covariance)) for m, s in zip(b["model"], b["sums"])]
            yield b[["series", "id", "model", "log_likelihood"]]

    return both.mapInPandas(step, "series string, id string, model string, log_likelihood double")


def parameters(models: DataFrame) -> DataFrame:
    """A row for each state of each model: start, transitions from it, mean and covariance of scaled features."""

    def run(batches):
        for b in batches:
            out = []
            for series, id_, text, ll in b[["series", "id", "model", "log_likelihood"]].itertuples(index=False):
                m = hmm.from_json(text)
                out += [(series, id_, k, float(m["start"][k]), m["trans"][k].tolist(), m["means"][k].tolist(), m["covs"][k].tolist(), ll) for k in range(len(m["start"]))]
            yield pd.DataFrame(out, columns=["series", "id", "state", "start", "trans", "mean", "cov", "log_likelihood"])

    return models.mapInPandas(run, "series string, id string, state int, start double, trans array<double>, mean array<double>, cov array<array<double>>, log_likelihood double")


def _first_models(rows: DataFrame, scale: DataFrame, features: list[str], counts: list[int], seeds: list[int], covariance: str, emission: str, init: str) -> DataFrame:
    """series, id ("k:seed") and a model to start from, for bars spread evenly over each series, at most ``hmm.START_BARS``."""
    scale = moments.lagged_moments(rows, features, scale) if init == "tensor" else scale.withColumn("m2", F.lit(None)).withColumn("m3", F.lit(None))
    few = rows.join(scale.select("series", F.ceil(F.col("bars") / hmm.START_BARS).alias("every")), "series").where("n % every = 0")
    d = len(features)

    def run(bars: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        of = of.iloc[0]
        mean, sd = np.asarray(of["mean"]), np.asarray(of["sd"])
        x = (bars.sort_values("n")[features].to_numpy(float) - mean) / sd
        sums = (np.asarray(of["m2"]).reshape(d, d), np.asarray(of["m3"]).reshape(d, d, d), int(of["bars"])) if init == "tensor" else None
        out = []
        for k in counts:
            for seed in seeds:
                m = hmm.first_guess(x, k, seed, covariance, emission, init, mean / sd, sums)
                out.append((of["series"], f"{k}:{seed}", hmm.to_json(m | {"mean": mean, "sd": sd, "features": features})))
        return pd.DataFrame(out, columns=["series", "id", "model"])

    return few.groupBy("series").cogroup(scale.groupBy("series")).applyInPandas(run, "series string, id string, model string")


def fit_long(df: DataFrame, features: list[str], counts: list[int], restarts: int = 10, seed: int = 42, covariance: str = "full", emission: str = "gaussian", init: str = "kmeans", n_iter: int = 200, tol: float = 1e-4) -> DataFrame:
    """The best fit of each series and state count over blocks: one Spark job a round, for all models that still improve.

    A model is done when a round would start from a likelihood less than ``tol`` above
    the one before. Every round's models are a table, so a lost executor costs its blocks only.
    """
    rows = block_rows(df, features)
    scale = stored(moments.scales(rows, features))
    live = stored(_first_models(rows, scale, features, counts, [seed + i for i in range(restarts)], covariance, emission, init).withColumn("before", F.lit(-np.inf)))
    ended = []
    for i in range(n_iter):
        now = em_round(rows, live, covariance)
        old = live.select("series", "id", F.col("model").alias("was"), "before")
        now = stored(now.join(old, ["series", "id"]).withColumn("done", (F.col("log_likelihood") - F.col("before") < tol) | F.lit(i + 1 == n_iter)))
        now = now.where("not isnan(log_likelihood) and abs(log_likelihood) < double('infinity')")
        gone = now.where("done").withColumn("converged", F.col("log_likelihood") - F.col("before") < tol)
        ended.append(gone.select("series", "id", F.col("was").alias("model"), "log_likelihood", "converged"))
        live = now.where("not done").select("series", "id", "model", F.col("log_likelihood").alias("before"))
        if live.isEmpty():
            break
    fits = ended[0]
    for x in ended[1:]:
        fits = fits.unionByName(x)
    best = F.max_by(F.struct("log_likelihood", "converged", "model"), "log_likelihood").alias("best")
    out = fits.groupBy("series", F.split("id", ":")[0].cast("int").alias("k")).agg(best, F.count("*").alias("finite_restarts"), F.sum(F.col("converged").cast("long")).alias("converged_restarts"))
    return out.join(scale.select("series", F.col("bars").alias("n")), "series").select("series", "k", "best.*", "n", "finite_restarts", "converged_restarts")
