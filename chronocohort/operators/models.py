"""Per-entity Gaussian-process interpolation and the logistic baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F


SEGMENT = 256


def _process(params: dict, jitter: float):
    """Filter and smoother of one entity's series, as functions the workers carry with them.

    Every term of the covariance, a feature covariance times ``exp(-|dt|/length)``, is a stationary first-order process,
    so the series is a linear system: a state of one number per term and feature that decays between times. One pass
    forwards and one backwards give what a matrix of all times would, in time linear in the times. Filtered states are
    kept at the head of every segment only and filtered again inside it, so memory is linear in the segments.
    """
    import numpy as np

    terms = [(np.asarray(params[name], float), float(params[f"{name}_length"])) for name in ("fast", "slow")]
    terms = [term for term in terms if term[0].any()]
    noise = np.asarray(params["noise"], float) + jitter
    n, d = len(noise), len(noise) * len(terms)
    start = np.zeros((d, d))
    for i, (cov, _) in enumerate(terms):
        start[i * n : i * n + n, i * n : i * n + n] = cov
    rates = np.repeat([1 / length for _, length in terms], n)
    read = np.tile(np.eye(n), len(terms))  # features from the state

    def solve(a, b):
        try:
            return np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            return np.linalg.pinv(a, hermitian=True) @ b

    def root(cov):
        value, vector = np.linalg.eigh((cov + cov.T) / 2)
        return vector * np.sqrt(np.maximum(value, 0.0))

    def series(t, v, y, grid, draws, rng):
        """Means and variances (grid x features) and draws (draws x grid x features) given the observations."""
        order = np.lexsort((y, v, t))
        t, v, y = t[order], v[order], y[order]
        times = np.unique(np.concatenate([t, grid]))
        first = np.searchsorted(t, times)
        last = np.append(first[1:], len(t))
        wanted = np.searchsorted(grid, times), np.searchsorted(grid, times, side="right")

        def predicted(k, mean, cov):
            if k == 0:
                return np.zeros(d), start, np.zeros(d)
            decay = np.exp(-(times[k] - times[k - 1]) * rates)
            both = np.outer(decay, decay)
            return decay * mean, both * cov + (1 - both) * start, decay

        def filtered(k, mean, cov):
            mean, cov, _ = predicted(k, mean, cov)
            for i in range(first[k], last[k]):
                gain = cov @ read[v[i]]
                spread = read[v[i]] @ gain + noise[v[i]]
                mean = mean + gain * ((y[i] - read[v[i]] @ mean) / spread)
                cov = cov - np.outer(gain, gain / spread)
            return mean, cov

        heads, state = [], (np.zeros(d), start)
        for k in range(len(times)):
            if k % SEGMENT == 0:
                heads.append(state)
            state = filtered(k, *state)
        means, variances = np.empty((len(grid), n)), np.empty((len(grid), n))
        drawn = np.empty((draws, len(grid), n))
        after = None
        for head in range(len(heads) - 1, -1, -1):
            states, state = [], heads[head]
            for k in range(head * SEGMENT, min(len(times), (head + 1) * SEGMENT)):
                state = filtered(k, *state)
                states.append(state)
            for k in range(head * SEGMENT + len(states) - 1, -1 + head * SEGMENT, -1):
                mean, cov = states[k - head * SEGMENT]
                if after is None:
                    smooth, spread = mean, cov
                    paths = mean[:, None] + root(cov) @ rng.standard_normal((d, draws)) if draws else None
                else:
                    ahead, ahead_cov, decay = predicted(k + 1, mean, cov)
                    gain = solve(ahead_cov, decay[:, None] * cov).T
                    smooth, spread = mean + gain @ (after[0] - ahead), cov + gain @ (after[1] - ahead_cov) @ gain.T
                    if draws:
                        rest = root(cov - gain @ ahead_cov @ gain.T)
                        paths = mean[:, None] + gain @ (after[2] - ahead[:, None]) + rest @ rng.standard_normal((d, draws))
                after = (smooth, spread, paths if draws else None)
                own = slice(wanted[0][k], wanted[1][k])
                if own.start < own.stop:
                    means[own] = read @ smooth
                    variances[own] = np.einsum("ij,jk,ik->i", read, spread, read)
                    if draws:
                        drawn[:, own] = (read @ paths).T[:, None, :]
        return means, variances, drawn

    return series


def _marginals(params: dict, jitter: float):
    """The filter and smoother of ``_process`` without draws, for many entities at once.

    Entities stand in falling order of their number of times, so those that have a k-th time are the first ones, and a
    step forwards or backwards is a few array operations over all of them.
    """
    import numpy as np

    terms = [(np.asarray(params[name], float), float(params[f"{name}_length"])) for name in ("fast", "slow")]
    terms = [term for term in terms if term[0].any()]
    noise = np.asarray(params["noise"], float) + jitter
    n, d = len(noise), len(noise) * len(terms)
    start = np.zeros((d, d))
    for i, (cov, _) in enumerate(terms):
        start[i * n : i * n + n, i * n : i * n + n] = cov
    rates = np.repeat([1 / length for _, length in terms], n)
    read = np.tile(np.eye(n), len(terms))

    def solve(a, b):
        try:
            return np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            if len(a) == 1:
                return np.linalg.pinv(a, hermitian=True) @ b
            return np.concatenate([solve(a[i : i + 1], b[i : i + 1]) for i in range(len(a))])

    def batch(e, t, v, y, ge, grid):
        """Means and variances (grid rows x features); ``e`` and ``ge`` number the entities of readings and grid rows."""
        order = np.lexsort((y, v, t, e))
        e, t, v, y = e[order], t[order], v[order], y[order]
        every, when = np.concatenate([e, ge]), np.concatenate([t, grid])
        order = np.lexsort((when, every))
        fresh = np.append(True, (np.diff(every[order]) != 0) | (when[order][1:] != when[order][:-1]))
        at = np.empty(len(order), int)
        at[order] = np.cumsum(fresh) - 1
        of, times = every[order][fresh], when[order][fresh]
        count = np.bincount(at[: len(e)], minlength=len(times))
        first = np.searchsorted(at[: len(e)], np.arange(len(times)))
        asked = np.bincount(at[len(e) :], minlength=len(times)) > 0
        steps = np.bincount(of)
        heads_of = (np.cumsum(steps) - steps)[np.argsort(-steps, kind="stable")]
        steps = -np.sort(-steps)
        active = lambda k: np.searchsorted(-steps, -k, side="left")  # noqa: E731  entities with more than k times

        def predicted(k, mean, cov):
            own = heads_of[: active(k)] + k
            if k == 0:
                return np.zeros((len(own), d)), np.broadcast_to(start, (len(own), d, d)).copy(), None
            decay = np.exp(-(times[own] - times[own - 1])[:, None] * rates)
            both = decay[:, :, None] * decay[:, None, :]
            return decay * mean[: len(own)], both * cov[: len(own)] + (1 - both) * start, decay

        def filtered(k, state):
            mean, cov, _ = predicted(k, *state)
            own = heads_of[: len(mean)] + k
            for j in range(count[own].max()):
                some = np.flatnonzero(count[own] > j)
                i = first[own[some]] + j
                row = read[v[i]]
                gain = np.einsum("aij,aj->ai", cov[some], row)
                spread = np.einsum("ai,ai->a", row, gain) + noise[v[i]]
                mean[some] += gain * ((y[i] - np.einsum("ai,ai->a", row, mean[some])) / spread)[:, None]
                cov[some] -= gain[:, :, None] * (gain / spread[:, None])[:, None, :]
            return mean, cov

        heads, state = [], (None, None)
        for k in range(steps[0]):
            if k % SEGMENT == 0:
                heads.append(state)
                states = []
            state = filtered(k, state)
            states.append(state)
        means, variances = np.full((len(times), n), np.nan), np.full((len(times), n), np.nan)
        after = None
        for head in range(len(heads) - 1, -1, -1):
            if head < len(heads) - 1:
                states, state = [], heads[head]
                for k in range(head * SEGMENT, (head + 1) * SEGMENT):
                    state = filtered(k, state)
                    states.append(state)
            for k in range(head * SEGMENT + len(states) - 1, head * SEGMENT - 1, -1):
                smooth, spread = states[k - head * SEGMENT]
                smooth, spread = smooth.copy(), spread.copy()
                if after is not None:
                    m = len(after[0])
                    ahead, ahead_cov, decay = predicted(k + 1, smooth, spread)
                    gain = solve(ahead_cov, decay[:, :, None] * spread[:m]).transpose(0, 2, 1)
                    smooth[:m] += np.einsum("aij,aj->ai", gain, after[0] - ahead)
                    spread[:m] += gain @ (after[1] - ahead_cov) @ gain.transpose(0, 2, 1)
                after = (smooth, spread)
                own = heads_of[: len(smooth)] + k
                some = np.flatnonzero(asked[own])
                means[own[some]] = smooth[some] @ read.T
                variances[own[some]] = np.einsum("ij,ajk,ik->ai", read, spread[some], read)
        return means[at[len(e) :]], variances[at[len(e) :]]

    return batch


# Rows of the entities that are worked on at once, and numbers in their states of one time.
BATCH_ROWS = 100_000
BATCH_STATE = 100_000


def _in_batches(key: str, params: dict, jitter: float):
    """Whole entities from rows in the order of the key, some at a time."""
    import numpy as np
    import pandas as pd

    batch, n = _marginals(params, jitter), len(params["noise"])
    most = max(1, BATCH_STATE // (2 * n + 4 * n * n))

    def worked(pdf: pd.DataFrame):
        entity, code = np.unique(pdf[key].to_numpy(), return_inverse=True)
        for low in range(0, len(entity), most):
            some = (code >= low) & (code < low + most)
            part, own = pdf[some], code[some] - low
            seen = part["var_id"].notna().to_numpy()
            t, grid = part["t"].to_numpy(float), ~seen
            if not grid.any():
                continue
            mean, variance = batch(own[seen], t[seen], part["var_id"].to_numpy()[seen].astype(int), part["value"].to_numpy(float)[seen], own[grid], t[grid])
            yield pd.DataFrame({
                key: np.repeat(entity[low : low + most][own[grid]], n), "t": np.repeat(t[grid], n), "var_id": np.tile(np.arange(n, dtype=np.int32), grid.sum()),
                "mean": mean.ravel(), "variance": variance.ravel(),
            })

    def run(parts):
        held, rows = [], 0
        for pdf in parts:
            if not len(pdf):
                continue
            last = pdf[key].iloc[-1]
            if rows + len(pdf) >= BATCH_ROWS and (pdf[key].iloc[0] != last or (held and held[-1][key].iloc[-1] != last)):
                whole = pdf[key] != last  # the last entity may go on in the next rows
                yield from worked(pd.concat([*held, pdf[whole]]))
                held, rows, pdf = [], 0, pdf[~whole]
            held.append(pdf)
            rows += len(pdf)
        if held:
            yield from worked(pd.concat(held))

    return run


def _per_entity(key: str, params: dict, draws: int, jitter: float, seed: int):
    import numpy as np
    import pandas as pd

    series = _process(params, jitter)
    n_vars = len(params["noise"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entity = pdf[key].iloc[0]
        seen = pdf["var_id"].notna()
        obs, grid = pdf[seen], np.sort(pdf.loc[~seen, "t"].to_numpy(float))
        rng = np.random.default_rng([seed, abs(int(entity))])
        mean, _, drawn = series(obs["t"].to_numpy(float), obs["var_id"].to_numpy(int), obs["value"].to_numpy(float), grid, draws, rng)
        hour, var = np.repeat(grid, n_vars), np.tile(np.arange(n_vars, dtype=np.int32), len(grid))
        # The draws of the dense form carry the jitter on their diagonal.
        drawn = drawn + np.sqrt(jitter) * rng.standard_normal(drawn.shape)
        value = np.concatenate([mean.ravel(), drawn.ravel()])
        sample = np.repeat(np.arange(draws + 1, dtype=np.int32), mean.size)
        return pd.DataFrame({key: np.int64(entity), "sample": sample, "t": np.tile(hour, draws + 1), "var_id": np.tile(var, draws + 1), "value": value})

    return run


def starting_params(n_vars: int, n_fast: int, noise_log: float = -2.0, fast_length: float = 0.5, slow_length: float = 10.0) -> dict:
    """Hyper-parameters before any fitting: unit variance for the fast variables in the fast kernel
    and for the slow ones in the slow kernel, 0.01 for the others, and noise ``exp(noise_log)``."""
    import math

    def diagonal(values: Sequence[float]) -> list[list[float]]:
        return [[values[i] ** 2 if i == j else 0.0 for j in range(n_vars)] for i in range(n_vars)]

    return {
        "fast": diagonal([1.0 if i < n_fast else 0.01 for i in range(n_vars)]),
        "slow": diagonal([0.01 if i < n_fast else 1.0 for i in range(n_vars)]),
        "noise": [math.exp(noise_log)] * n_vars,
        "fast_length": fast_length,
        "slow_length": slow_length,
    }


def _dealt(long: DataFrame, grid: DataFrame, key: str, t: str, var: str, value: str, grid_time: str):
    """Observations and grid rows of the entities that have observations, dealt by entity."""
    observed = long.select(
        F.col(key).cast("bigint"),
        F.col(t).cast("double").alias("t"),
        F.col(var).cast("int").alias("var_id"),
        F.col(value).cast("double").alias("value"),
    ).where(f"{key} is not null and t is not null and var_id is not null and value is not null")
    targets = grid.join(observed.select(key).distinct(), key, "left_semi").select(
        F.col(key).cast("bigint"),
        F.col(grid_time).cast("double").alias("t"),
        F.lit(None).cast("int").alias("var_id"),
        F.lit(None).cast("double").alias("value"),
    )
    # The rows are few and the work per entity is large, so the partition count is set rather than
    # left to be merged by size.
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return observed.unionByName(targets).repartition(parts, key)


def gp_interpolate(
    long: DataFrame,
    grid: DataFrame,
    key: str,
    t: str,
    var: str,
    value: str,
    grid_time: str,
    params: dict,
    draws: int = 0,
    jitter: float = 0.001,
    seed: int = 11,
) -> DataFrame:
    """Multitask Gaussian-process interpolation of each entity onto its grid:
    ``(key, sample, t, var_id, value)``, sample 0 being the posterior mean and 1..n joint draws.

    The covariance is a sum of two terms, each a feature covariance times ``exp(-|dt|/length)``, plus
    noise per feature. Mean and draws come from a filter and a backward pass, so an entity costs time
    linear in its observations and grid hours. Draws are joint over all hours and features, and repeat
    with the seed. Grid rows of entities without observations give no output; incomplete rows are no
    observations.
    """
    schema = f"{key} bigint, sample int, t double, var_id int, value double"
    dealt = _dealt(long, grid, key, t, var, value, grid_time)
    return dealt.groupBy(key).applyInPandas(_per_entity(key, params, draws, jitter, seed), schema)


def gp_marginals(
    long: DataFrame, grid: DataFrame, key: str, t: str, var: str, value: str, grid_time: str, params: dict, jitter: float = 0.001
) -> DataFrame:
    """Posterior mean and variance of each feature at each grid hour: ``(key, t, var_id, mean, variance)``."""
    schema = f"{key} bigint, t double, var_id int, mean double, variance double"
    dealt = _dealt(long, grid, key, t, var, value, grid_time)
    return dealt.sortWithinPartitions(key).mapInPandas(_in_batches(key, params, jitter), schema)


def _logistic(train: DataFrame, features: str, label: str, l2: float, iterations: int):
    return LogisticRegression(
        featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_raw",
        regParam=l2, elasticNetParam=0.0, maxIter=iterations, tol=1e-10,
    ).fit(train.select(array_to_vector(features).alias("_x"), F.col(label).cast("double").alias("_y")))


def logistic_gradient(train: DataFrame, features: str, label: str, l2: float = 0.01, iterations: int = 200) -> DataFrame:
    """Gradient of the penalised mean log loss at the fitted weights, one row per feature (-1: the intercept).

    Zero but for rounding if the fit is the optimum. The penalty is on weights of standardised features, the intercept
    has none. A feature that does not vary is held at weight 0, so its gradient counts as 0; ``scale`` is null there.
    """
    model = _logistic(train, features, label, l2, iterations)
    weights = [float(w) for w in model.coefficients]
    dot = F.aggregate(F.zip_with(features, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    miss = 1 / (1 + F.exp(-(dot + F.lit(float(model.intercept))))) - F.col(label).cast("double")
    with_one = F.concat(F.array(F.lit(1.0)), F.col(features))
    rows = train.select(miss.alias("miss"), F.posexplode(with_one).alias("i", "x"))
    sums = rows.groupBy((F.col("i") - 1).alias("feature")).agg(F.avg(F.col("miss") * F.col("x")).alias("slope"), F.var_samp("x").alias("var"))
    by_feature = F.array(*[F.lit(w) for w in weights])
    weight = F.when(F.col("feature") < 0, F.lit(0.0)).otherwise(F.element_at(by_feature, (F.greatest("feature", F.lit(0)) + 1).cast("int")))
    varies = (F.col("feature") < 0) | (F.col("var") > 0)
    slope = F.when(varies, F.col("slope") + F.lit(l2) * weight * F.col("var")).otherwise(0.0)
    scale = F.when(F.col("feature") < 0, F.lit(1.0)).when(varies, F.sqrt("var"))
    return sums.select("feature", slope.alias("gradient"), scale.alias("scale"))


def logistic_baseline(train: DataFrame, rows: DataFrame, features: str, label: str, l2: float = 0.01, iterations: int = 50) -> DataFrame:
    """Scores of an L2-regularised logistic regression on array features, fitted by Spark ML."""
    model = _logistic(train, features, label, l2, iterations)
    scored = model.transform(rows.withColumn("_x", array_to_vector(features)))
    return scored.withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_c", "_raw")
