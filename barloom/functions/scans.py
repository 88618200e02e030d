"""Ordered scans over groups of any size.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task, which fails
when one key holds a large part of the data. A scan cuts each key into consecutive
chunks (``chunk`` must not decrease along ``order``), scans inside (key, chunk), summarises one
row per chunk, scans the chunk summaries, and joins what comes before each chunk back, once for all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, Column] | None = None,
         peaks: dict[str, str] | None = None, lags: dict[str, str] | None = None, known: dict[str, str] | None = None,
         tops: dict[str, str] | None = None) -> DataFrame:
    """Adds running ``sums`` {new: expr}, running ``peaks`` {new: name of a sum} of those sums, ``lags`` {new: column} (the row before)
    ``known`` {new: column} (the last non-null at or before the row) and ``tops`` {new: column} (the running maximum), all along ``order`` within ``keys``.

    A chunk's summary is (sum, greatest prefix sum, last row, last known); two neighbours make (s1 + s2, max(m1, s1 + m2), ...), so
    the summaries before a chunk fold into the one row that is joined to it.
    """
    sums, peaks, lags, known, tops = sums or {}, peaks or {}, lags or {}, known or {}, tops or {}
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    x = df.withColumns({
        **{f"_sum_{n}": F.sum(e).over(running) for n, e in sums.items()},
        **{f"_known_{n}": F.last(c, ignorenulls=True).over(running) for n, c in known.items()},
        **{f"_high_{n}": F.max(c).over(running) for n, c in tops.items()},
        **{f"_lag_{n}": F.lag(c).over(inner) for n, c in lags.items()},
        **({"_first": F.row_number().over(inner) == 1} if lags else {}),
    })
    x = x.withColumns({f"_peak_{n}": F.max(f"_sum_{s}").over(running) for n, s in peaks.items()})
    chunks = x.groupBy(*keys, chunk).agg(*[
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.max(f"_peak_{n}").alias(f"_p_{n}") for n in peaks],
        *[F.max(c).alias(f"_t_{n}") for n, c in tops.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_k_{n}") for n, c in known.items()],
        *([F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lags.items()]), place).alias("_tail")] if lags else []),
    ])
    outer = Window.partitionBy(*keys).orderBy(chunk)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.withColumns({
        **{f"_before_{n}": F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)) for n in sums},
        **{f"_above_{n}": F.max(f"_t_{n}").over(earlier) for n in tops},
        **{f"_last_{n}": F.last(f"_k_{n}", ignorenulls=True).over(earlier) for n in known},
        **({"_prev": F.lag("_tail").over(outer)} if lags else {}),
    })
    carry = carry.withColumns({f"_top_{n}": F.max(F.col(f"_before_{s}") + F.col(f"_p_{n}")).over(earlier) for n, s in peaks.items()})
    carry = carry.drop(*[c for c in carry.columns if c.startswith(("_s_", "_p_", "_k_", "_t_", "_tail"))])
    out = x.join(carry, [*keys, chunk], "left")
    made = {
        **{n: F.col(f"_sum_{n}") + F.col(f"_before_{n}") for n in sums},
        **{n: F.greatest(F.col(f"_peak_{n}") + F.col(f"_before_{s}"), F.col(f"_top_{n}")) for n, s in peaks.items()},
        **{n: F.greatest(f"_high_{n}", f"_above_{n}") for n in tops},
        **{n: F.coalesce(f"_known_{n}", f"_last_{n}") for n in known},
        **{n: F.when(F.col("_first"), F.col("_prev")[n]).otherwise(F.col(f"_lag_{n}")) for n in lags},
    }
    return out.select(*df.columns, *[c.alias(n) for n, c in made.items()])


def scan_lag(df: DataFrame, keys: list[str], chunk: str, order: list[str],
             values: dict[str, str]) -> DataFrame:
    """Add ``{new: previous row's old}`` along ``order`` within ``keys``."""
    return scan(df, keys, chunk, order, lags=values)


def scan_last_known(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                    value: str, new: str) -> DataFrame:
    """Forward fill: the last non-null ``value`` at or before each row."""
    return scan(df, keys, chunk, order, known={new: value})


def scan_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str],
             values: dict[str, Column]) -> DataFrame:
    """Add running sums ``{new: running sum of expr}`` along ``order`` within ``keys``."""
    return scan(df, keys, chunk, order, sums=values)


def scan_max(df: DataFrame, keys: list[str], chunk: str, order: list[str],
             value: str, new: str) -> DataFrame:
    """Running maximum of ``value`` along ``order`` within ``keys``."""
    return scan(df, keys, chunk, order, tops={new: value})
