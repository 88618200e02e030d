"""Block bootstrap over days, Monte-Carlo p-values and jackknife errors.

A group enters as one row with prefix sums of its days (at most one entry per calendar day), so
one draw adds up a few differences. Draws are split into chunks before they are computed, which spreads one large group over
many tasks, and travel packed: one array for each (group, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.rng import PRIME, STEP, stable_seed
from barloom.params import BLOCK_DAYS, MASTER_SEED

CHUNK = 1000
STRIDE = 1 << 20  # random numbers a draw may use
TIE = 1e-12  # draws no further apart are equal


def day_prefixes(daily: DataFrame, keys: list[str], n: str = "n", total: str = "total",
                 order: str = "date") -> DataFrame:
    """Per key: day count, trade count, sum, and prefix arrays that start at 0."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = daily.withColumns({"_pn": F.sum(n).over(so_far), "_ps": F.sum(total).over(so_far)})
    x = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nd"), F.sum(n).alias("n_trades"),
        F.sum(total).alias("sum_r"),
        F.array_sort(F.collect_list(F.struct(order, "_pn", "_ps"))).alias("_days"))
    return x.withColumns({
        "prefix_n": F.concat(F.array(F.lit(0).cast("bigint")), F.col("_days._pn")),
        "prefix_sum": F.concat(F.array(F.lit(0.0)), F.col("_days._ps")),
    }).drop("_days")


def own_size_blocks(block_days: int) -> Column:
    """Blocks that cover the group's own number of days."""
    width = F.greatest(F.lit(1), F.least(F.lit(block_days), F.col("nd")))
    return F.ceil(F.col("nd") / width)


def observed_size_blocks(n_obs: Column, block_days: int) -> Column:
    """Blocks of a control pool that cover ``n_obs`` trades at its trades-per-day rate."""
    width = F.greatest(F.lit(1), F.least(F.lit(block_days), F.col("nd")))
    per_day = F.greatest(F.lit(1.0), F.col("n_trades") / F.col("nd"))
    return F.greatest(F.lit(1), F.ceil(F.ceil(n_obs / per_day) / width))


def draw_vectors(prefixes: DataFrame, keys: list[str], draws: int, n_blocks: Column,
                 seed: Column, block_days: int = BLOCK_DAYS, chunk: int = CHUNK) -> DataFrame:
    """One row per (keys, chunk): ``means``, an array of the draws chunk * CHUNK and on, in order.

    A draw is the mean over blocks of consecutive days whose starts are uniform over the days at which a whole block fits. The
    sums of all blocks of a group are made once, so a draw adds up a few of them. Block j of draw b takes the random number
    b * STRIDE + j whatever the number of blocks, so under one seed groups of equal days share their resamples.
    The arithmetic is NumPy's, vector by vector; rows stay packed.
    """
    x = prefixes.withColumns({"_k": n_blocks.cast("bigint"), "_seed": seed.cast("bigint")})
    x = x.withColumn("_w", F.greatest(F.lit(1), F.least(F.lit(block_days), F.col("nd"))).cast("bigint"))
    # The rows are few and small but each stands for much arithmetic, so they are spread over a
    # fixed number of tasks; sizing by bytes would pack them into one.
    tasks = 2 * prefixes.sparkSession.sparkContext.defaultParallelism
    x = x.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // chunk)))).repartition(tasks, *keys, "chunk")
    prime, step, stride, cells = PRIME, STEP, STRIDE, 1 << 20

    def means(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, r in enumerate(batch.select(["chunk", "nd", "_k", "_w", "_seed"]).to_pylist()):
                n, total = batch["prefix_n"][i].values.to_numpy(), batch["prefix_sum"][i].values.to_numpy()
                w = r["_w"]
                n, total = n[w:] - n[:-w], total[w:] - total[:-w]
                first = r["chunk"] * chunk
                of = np.arange(first, min(first + chunk, draws), dtype=np.int64)
                sums, counts = np.zeros(len(of)), np.zeros(len(of), np.int64)
                width = max(1, cells // len(of))
                for j in range(0, r["_k"], width):
                    blocks = np.arange(j, min(j + width, r["_k"]), dtype=np.int64)
                    v = (r["_seed"] + (of[:, None] * stride + blocks) * step) % prime
                    square = v * v % prime
                    start = square * square % prime * v % prime % (r["nd"] - w + 1)
                    sums += total[start].sum(axis=1)
                    counts += n[start].sum(axis=1)
                out.append(sums / counts)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], batch["chunk"], pa.array(out, pa.list_(pa.float64()))],
                                             names=[*keys, "chunk", "means"])

    kinds = dict(x.select(*keys).dtypes)
    return x.select(*keys, "chunk", "prefix_n", "prefix_sum", "nd", "_k", "_w", "_seed").mapInArrow(
        means, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk int, means array<double>")


def block_bootstrap(prefixes: DataFrame, keys: list[str], draws: int, n_blocks: Column,
                    seed: Column, block_days: int = BLOCK_DAYS, chunk: int = CHUNK) -> DataFrame:
    """One row per (keys, draw): the draws of draw_vectors, unpacked."""
    vectors = draw_vectors(prefixes, keys, draws, n_blocks, seed, block_days, chunk)
    return vectors.select(*keys, "chunk", F.posexplode("means").alias("_at", "mean_r")).select(
        *keys, (F.col("chunk") * chunk + F.col("_at")).alias("draw"), "mean_r")


def vector_stats(vectors: DataFrame, keys: list[str], observed: DataFrame | None = None, obs: str | None = None) -> DataFrame:
    """Per key: null_mean, null_p95, null_std, null_draws and, given an observed value, p_value: (1 + draws above + half the
    ties) / (1 + draws), ties judged at 1e-12; draws that are all tied have null_std 0. A group is the packed draws of one key,
    so its size is fixed by their number."""
    kinds = dict(vectors.dtypes)
    x = vectors.withColumn("_obs", F.lit(None).cast("double")) if observed is None else \
        vectors.join(observed.select(*keys, F.col(obs).cast("double").alias("_obs")), keys)

    def stats(table):
        import numpy as np
        import pyarrow as pa

        v = table["means"].combine_chunks().flatten().to_numpy()
        at = table["_obs"][0].as_py()
        p = None if at is None else float((1 + (v - at > TIE).sum() + 0.5 * (np.abs(v - at) <= TIE).sum()) / (1 + len(v)))
        # The mean of equal draws may be off by the last bit, which would leave a deviation of about 1e-17.
        std = 0.0 if v.max() - v.min() <= TIE else v.std()
        return pa.table([*[table[k].slice(0, 1) for k in keys], pa.array([v.mean()]), pa.array([np.quantile(v, 0.95)]),
                         pa.array([std]), pa.array([len(v)], pa.int64()), pa.array([p], pa.float64())],
                        names=[*keys, "null_mean", "null_p95", "null_std", "null_draws", "p_value"])

    return x.groupBy(*keys).applyInArrow(stats, ", ".join(f"`{k}` {kinds[k]}" for k in keys) +
                                         ", null_mean double, null_p95 double, null_std double, null_draws long, p_value double")


def bootstrap_ci(trades: DataFrame, keys: list[str], draws: int, value: str = "gross_r",
                 block_days: int = BLOCK_DAYS, master: int = MASTER_SEED, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the per-trade mean; a single day gives the point value twice."""
    daily = trades.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    prefixes = day_prefixes(daily, keys)
    seed = stable_seed(*[F.col(k) for k in keys], master=master)
    means = block_bootstrap(prefixes, keys, draws, own_size_blocks(block_days), seed, block_days)
    return means.groupBy(*keys).agg(
        F.percentile("mean_r", F.lit(alpha / 2)).alias("ci_lo"),
        F.percentile("mean_r", F.lit(1 - alpha / 2)).alias("ci_hi"))


def iid_bootstrap_ci(values: DataFrame, value: str, order: list[str], draws: int,
                     master: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the plain mean of a small vector: blocks of one row."""
    w = Window.partitionBy("_one").orderBy(*order)
    x = values.withColumn("_one", F.lit(1)).withColumns({
        "_i": F.row_number().over(w), "n": F.lit(1).cast("bigint"), "total": F.col(value)})
    prefixes = day_prefixes(x, ["_one"], order="_i")
    means = block_bootstrap(prefixes, ["_one"], draws, F.col("nd"),
                            F.lit(master).cast("bigint"), block_days=1)
    return means.agg(F.percentile("mean_r", F.lit(alpha / 2)).alias("ci_lo"),
                     F.percentile("mean_r", F.lit(1 - alpha / 2)).alias("ci_hi"))


def jackknife_se(daily: DataFrame, keys: list[str], n: str = "n", total: str = "total") -> DataFrame:
    """Standard error of the pooled mean from leaving out one day at a time."""
    w = Window.partitionBy(*keys)
    x = daily.withColumns({"_n": F.sum(n).over(w), "_s": F.sum(total).over(w),
                           "_d": F.count(F.lit(1)).over(w)})
    x = x.withColumn("_est", ratio(F.col("_s") - F.col(total), F.col("_n") - F.col(n)))
    x = x.withColumn("_dev", F.pow(F.col("_est") - F.avg("_est").over(w), 2))
    d = F.max("_d")
    return x.groupBy(*keys).agg(
        d.alias("days"),
        F.when(d >= 2, F.sqrt((d - 1) / d * F.sum("_dev"))).alias("jackknife_se"))
