"""Column factories: null-safe arithmetic, row windows of a series, cross-section statistics.

Missing is NULL throughout, never NaN. Row windows are over (``ticker``,
``date``): all that stand in one ``select`` share one exchange, one sort and
one Window node. ``least`` is the number of non-null values that a window needs.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.currentRow)
EPS = 1e-9


def series() -> WindowSpec:
    """The rows of an instrument in the order of dates. A function, as a window needs a session."""
    return Window.partitionBy("ticker").orderBy("date")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str, tiny: float = 0.0) -> Column:
    """``a / b``; NULL where ``b`` is NULL or not above ``tiny`` in size."""
    a, b = col(a), col(b)
    return F.when(F.abs(b) > tiny, a / b)


def log(x: Column | str, tiny: float = 0.0) -> Column:
    x = col(x)
    return F.when(x > tiny, F.ln(x))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; NULL stays NULL, which ``greatest`` and ``least`` alone would lose."""
    x = out = col(x)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def zero(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(0.0))


def positive(x: Column | str) -> Column:
    x = col(x)
    return F.when(x > 0, x)


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a NULL condition is 0."""
    return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)


def mean_of(*xs: Column) -> Column:
    """Of the non-null ones."""
    return div(sum((zero(x) for x in xs[1:]), zero(xs[0])), sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int")))


def frame(n: int, skip: int = 0, w: WindowSpec | None = None) -> WindowSpec:
    """``n`` rows that end ``skip`` rows ago."""
    return (w or series()).rowsBetween(-(n - 1 + skip), -skip)


def lag(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), k).over(w or series()) if k >= 0 else F.lead(col(x), -k).over(w or series())


def diff(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return col(x) - lag(x, k, w)


def change(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return div(x, lag(x, k, w)) - 1


def rolling(f, x: Column | str, n: int, least: int | None = None, skip: int = 0, w: WindowSpec | None = None) -> Column:
    own = frame(n, skip, w)
    return F.when(F.count(col(x)).over(own) >= (n if least is None else least), f(col(x)).over(own))


def mean(x, n, least=None, **k) -> Column:
    return rolling(F.avg, x, n, least, **k)


def std(x, n, least=None, **k) -> Column:
    return rolling(F.stddev_samp, x, n, least, **k)


def total(x, n, least=None, **k) -> Column:
    return rolling(F.sum, x, n, least, **k)


def low(x, n, least=None, **k) -> Column:
    return rolling(F.min, x, n, least, **k)


def high(x, n, least=None, **k) -> Column:
    return rolling(F.max, x, n, least, **k)


def median(x, n, least=None, **k) -> Column:
    return rolling(lambda c: F.percentile(c, 0.5), x, n, least, **k)


def z(x: Column | str, n: int, least: int | None = None, floor: float | None = None, **k) -> Column:
    """Deviation from the window's mean in standard deviations: NULL at deviation 0, or not below ``floor``."""
    s = std(x, n, least, **k)
    return div(col(x) - mean(x, n, least, **k), s if floor is None else clip(s, floor))


def correlation(x: Column | str, y: Column | str, n: int, least: int, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows that have both values; NULL where either is constant.

    From sums, as ``corr`` fails on a division where rounding leaves a constant
    series an odd deviation.
    """
    own = frame(n, w=w)
    both = col(x) + col(y)
    u, v = (F.when(both.isNotNull(), col(c)) for c in (x, y))
    cov, a, b = F.covar_pop(u, v).over(own), F.stddev_pop(u).over(own), F.stddev_pop(v).over(own)
    return F.when(F.count(both).over(own) >= least, div(cov, a * b))


def running(x: Column | str, w: WindowSpec | None = None) -> Column:
    return F.sum(col(x)).over((w or series()).rowsBetween(*ALL))


def slope(x: Column | str, n: int, position: str = "_i", w: WindowSpec | None = None) -> Column:
    """Least-squares slope against the row number over full windows; needs :func:`numbered` first."""
    return rolling(lambda c: F.regr_slope(c, F.col(position)), x, n, w=w)


def r_squared(x: Column | str, n: int, position: str = "_i", w: WindowSpec | None = None) -> Column:
    own = frame(n, w=w)
    fit = F.when(F.var_pop(col(x)).over(own) == 0, 0.0).otherwise(F.regr_r2(col(x), F.col(position)).over(own))
    return F.when(F.count(col(x)).over(own) == n, fit)


def numbered(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or series()).cast("double")


def rank_share(x: Column | str, *by: str, descending: bool = False) -> Column:
    """Average-method percentile rank of the non-null values within a group; NULL groups get NULL.

    Rank, ties and the group's size are frames of one window, so that a rank costs one sort.
    """
    x = col(x)
    own = Window.partitionBy(*by).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    ties = own.rangeBetween(Window.currentRow, Window.currentRow)
    rank = F.rank().over(own) + (F.count(F.lit(1)).over(ties) - 1) / 2
    known = x.isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    return F.when(known, rank / F.count(x).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def group_z(x: Column | str, *by: str, least: int = 2) -> Column:
    """Deviation from the group's mean in its sample deviations."""
    own = Window.partitionBy(*by)
    return F.when(F.count(col(x)).over(own) >= least, div(col(x) - F.avg(col(x)).over(own), F.stddev_samp(col(x)).over(own)))


def streak(condition: Column, w: WindowSpec | None = None, by: tuple[str, ...] = ("ticker",), order: str = "date") -> tuple[Column, str]:
    """The number of the island (rises at each row that breaks the condition); see :func:`streak_length`."""
    return F.sum(F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)).over((w or series()).rowsBetween(*ALL)), "island"


def streak_length(condition: Column, island: str, order: str = "date", by: tuple[str, ...] = ("ticker",)) -> Column:
    """Consecutive rows up to this one that meet the condition."""
    hit = F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    return F.sum(hit).over(Window.partitionBy(*by, island).orderBy(order).rowsBetween(*ALL))


def winsorized(x: Column | str, *by: str, k: float = 5.0, collapse: bool = True) -> Column:
    """Within ``k`` median absolute deviations of the group's median; needs the column ``_med`` of :func:`group_median`.

    At deviation 0, ``collapse`` gives the median, else the value as it is.
    """
    x, med = col(x), F.col("_med")
    mad = F.median(F.abs(x - med)).over(Window.partitionBy(*by))
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, med - k * mad), med + k * mad))
    return clipped if collapse else F.when(mad > 0, clipped).otherwise(x)


def group_median(x: Column | str, *by: str) -> Column:
    return F.median(col(x)).over(Window.partitionBy(*by))


def nonzero(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(0.0))


def money(x: Column | str) -> Column:
    """``$1,234``: whole dollars, towards zero, the sign before them."""
    x = col(x)
    return F.concat(F.when(x <= -1, "-$").otherwise("$"), F.format_number(F.floor(F.abs(x)), 0))


def file_name(x: Column | str, most: int = 120) -> Column:
    """A text as a file's name: runs of characters other than letters, digits, dot, dash and underscore become one underscore, none at the ends."""
    return F.left(F.regexp_replace(F.regexp_replace(col(x), r"[^A-Za-z0-9._-]+", "_"), r"^[_.]+|_+$", ""), F.lit(most))
