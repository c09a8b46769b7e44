"""Dynamic panels by GMM: instruments from the levels of earlier dates, one and two steps, corrected errors.

With Z_i, X_i and y_i a unit's instruments, regressors and outcomes, all that the estimates and tests
need of a unit is Z_i'X_i, Z_i'y_i and the cross-products of its rows with those one and two dates before:
Z_i'u_i is linear in the coefficients, and so are the residuals whose products the tests of serial
correlation sum. A unit's observations are gathered once, become that one row, and each step is a sum over the
rows of units; the driver gets matrices of the size of the instruments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.stats import chi2_sf, norm_cdf


@dataclass(frozen=True)
class Design:
    """Which columns of a unit's observations (y, endogenous, predetermined, exogenous) instrument what.

    ``cells`` has the instruments made of levels: (column, lag, date), date None where a lag has one instrument for all dates.
    """

    n_lags: int
    n_endog: int
    n_pred: int
    n_exog: int
    cells: tuple[tuple[int, int, int | None], ...]
    system: bool

    @property
    def k(self) -> int:
        return self.n_lags + self.n_endog + self.n_pred + self.n_exog

    @property
    def m(self) -> int:
        return len(self.cells) + self.n_exog + (self.k if self.system else 0)

    def rows(self, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(Z, X and y side by side, date, whether in differences) of a unit with values ``v`` at dates ``t``."""

        def at(s: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(t, s), len(t) - 1)
            return np.where((t[i] == s)[:, None], v[i], np.nan)

        d = t[np.isin(t - 1, t)]
        now, lags = at(d) - at(d - 1), [at(d - p) - at(d - p - 1) for p in range(1, self.n_lags + 1)]
        w = np.column_stack([*[x[:, 0] for x in lags], now[:, 1:], now[:, 0]])
        exog = now[:, 1 + self.n_endog + self.n_pred :]
        z = np.zeros((len(d), self.m))
        for j, (c, lag, date) in enumerate(self.cells):
            level = np.nan_to_num(at(d - lag)[:, c])
            z[:, j] = level if date is None else np.where(d == date, level, 0.0)
        z[:, len(self.cells) : len(self.cells) + self.n_exog] = np.nan_to_num(exog)
        whole = np.isfinite(w).all(axis=1)
        out = [(z[whole], w[whole], d[whole], np.ones(whole.sum(), bool))]
        if self.system:
            # levels, by the differences before; without regressors' differences the row has zeros there
            here, lags = at(t), [at(t - p) for p in range(1, self.n_lags + 1)]
            w = np.column_stack([*[x[:, 0] for x in lags], here[:, 1:], here[:, 0]])
            change = here - at(t - 1)
            z = np.zeros((len(t), self.m))
            own = [*[(at(t - p) - at(t - p - 1))[:, 0] for p in range(1, self.n_lags + 1)], *[change[:, 1 + j] for j in range(self.n_endog + self.n_pred)], *[here[:, 1 + self.n_endog + self.n_pred + j] for j in range(self.n_exog)]]
            z[:, -self.k :] = np.nan_to_num(np.column_stack(own))
            whole = np.isfinite(w).all(axis=1) & np.isin(t - 2, t)
            out.append((z[whole], w[whole], t[whole], np.zeros(whole.sum(), bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def parts(self, t: np.ndarray, v: np.ndarray) -> tuple:
        """n, Z'X and Z'y in one matrix, and sums of row times row one and two dates before, in differences."""
        z, w, date, diff = self.rows(t, v)
        d, dates = w[diff], date[diff]
        lagged = []
        for lag in (1, 2):
            i = np.searchsorted(dates, dates - lag)
            there = np.flatnonzero((i < len(dates)) & (dates[np.minimum(i, len(dates) - 1)] == dates - lag)) if len(dates) else np.array([], int)
            lagged.append(d[there].T @ d[i[there]])
        return len(z), (z.T @ w).ravel(), lagged[0].ravel(), lagged[1].ravel()

    def weight(self, t: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Z'HZ, where H has the covariances of differences of independent errors; Z'Z for systems."""
        z, _, date, _ = self.rows(t, v)
        if self.system:
            return z.T @ z
        next_ = np.flatnonzero(np.diff(date) == 1)
        cross = z[next_].T @ z[next_ + 1]
        return 2 * z.T @ z - cross - cross.T


def _design(d: DataFrame, unit: str, n_lags: int, kinds: tuple[int, int, int], window: tuple[int, int | None], collapse: bool, system: bool) -> Design:
    """The instruments that there are: lags up to the longest before any difference, by date unless they are collapsed."""
    w = Window.partitionBy(unit).orderBy("t")
    d = d.withColumn("step", F.col("t") - F.lag("t").over(w)).withColumn("back", F.col("t") - F.min("t").over(Window.partitionBy(unit)))
    usable = F.col("step") == 1
    low, high = window
    if low < 1 or n_lags < 1:
        raise ValueError("lags begin at 1")
    s = d.agg(F.max(F.when(usable, F.col("back"))).alias("back"), F.min("t").alias("first"), F.count_if(F.col("step") == 0).alias("twice"), (F.lit(None) if collapse else F.collect_set(F.when(usable, F.col("t")))).alias("dates")).first()
    if s.twice:
        raise ValueError("a unit has two rows of one date")
    if s.back is None:
        raise ValueError("no unit has two dates in a row")

    def lags(c: int, lo: int, hi: int | None) -> list[tuple[int, int, int | None]]:
        if collapse:
            return [(c, lag, None) for lag in range(lo, min(s.back, hi or s.back) + 1)]
        return [(c, lag, t) for t in sorted(s.dates) for lag in range(lo, min(t - s.first, hi or t - s.first) + 1)]

    endog, pred, exog = kinds
    cells = [x for c in range(1 + endog) for x in lags(c, low, high)] + [x for c in range(1 + endog, 1 + endog + pred) for x in lags(c, max(1, low - 1), high and high - 1)]
    return Design(n_lags, endog, pred, exog, tuple(cells), system)


def _total(d: DataFrame, column: str) -> np.ndarray:
    """Sums of arrays of one length, place by place."""
    sums = d.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return np.array([x for _, x in sorted(sums)])


def _inverse(a: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix, on the scale of its diagonal; of one without an inverse, that of Moore and Penrose."""
    s = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv((a + a.T) / 2 / np.outer(s, s), rcond=1e-12, hermitian=True) / np.outer(s, s)


def _outer(units: DataFrame, m: int, beta: np.ndarray) -> np.ndarray:
    """The sum over units of g g', g = Z'u at ``beta``."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                g = np.stack(b["zw"]).reshape(len(b), m, -1) @ np.append(-beta, 1.0)
                yield pd.DataFrame({"s": [(g.T @ g).ravel()]})

    return _total(units.select("zw").mapInPandas(each, "s array<double>"), "s").reshape(m, m)


def _slopes(units: DataFrame, m: int, beta: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Columns: the derivative of the sum of g g' by each coefficient, times ``v``, with its sign turned."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                zw = np.stack(b["zw"]).reshape(len(b), m, -1)
                g, zx = zw @ np.append(-beta, 1.0), zw[:, :, :-1]
                out = np.einsum("umk,u->mk", zx, g @ v) + np.einsum("um,uk->mk", g, np.einsum("umk,m->uk", zx, v))
                yield pd.DataFrame({"s": [out.ravel()]})

    return _total(units.select("zw").mapInPandas(each, "s array<double>"), "s").reshape(m, -1)


def gmm(df: DataFrame, unit: str, time: str, y: str, n_lags: int = 1, endog: tuple[str, ...] = (), pred: tuple[str, ...] = (), exog: tuple[str, ...] = (), window: tuple[int, int | None] = (2, None), collapse: bool = True, two_step: bool = True, corrected: bool = True, system: bool = False) -> DataFrame:
    """y on ``n_lags`` of its own lags and on regressors, with unit effects: term, estimate, se, z, p_value, df.

    In differences, instrumented by levels of y and of the endogenous regressors at the lags in ``window`` (None: all there
    are), of the predetermined ones at one lag less, and by differences of the exogenous ones; one instrument per lag, or with
    ``collapse=False`` one per lag and date. ``system`` adds the equation in levels, instrumented by differences. Two steps use the first one's
    residuals by unit as the weight, and ``corrected`` its influence on the error (with the residuals of the second step). One
    step has errors robust within units. Terms: L1, L2, ..., the regressors, and the tests hansen_j (of surplus instruments: estimate, df, p_value),
    ar1 and ar2 (of residuals in differences: z, p_value); n_obs, n_units and n_instruments are columns.

    ``time`` is a whole number, one step a period. Rows with a null or NaN among the columns used are as if absent, so a unit may have holes;
    what an instrument can't be read from is 0. Units without a row in differences don't count. Two rows of one unit and date, or no unit with two
    dates in a row, are an error. A unit's dates must fit in one row, and instruments in a matrix on the driver (thousands at most).
    """
    names = [*[f"L{p}" for p in range(1, n_lags + 1)], *endog, *pred, *exog]
    cols = [y, *endog, *pred, *exog]
    values = [F.col(c).cast("double") for c in cols]
    d = df.select(F.col(unit).alias("unit"), F.col(time).cast("long").alias("t"), F.array(*values).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).dropna(subset=["unit", "t"])
    design = _design(d, "unit", n_lags, (len(endog), len(pred), len(exog)), window, collapse, system)
    k, m, spark = design.k, design.m, df.sparkSession
    if m < k:
        raise ValueError(f"{m} instruments for {k} coefficients")
    series = checkpointed(d.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s")).select("unit", F.transform("s", lambda x: x["t"]).alias("t"), F.flatten(F.transform("s", lambda x: x["v"])).alias("v")))
    read = lambda b: ((np.asarray(t), np.asarray(v).reshape(len(t), -1)) for t, v in zip(b["t"], b["v"], strict=True))

    def parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([design.parts(t, v) for t, v in read(b)], columns=["n", "zw", "r1", "r2"])

    def weight(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"s": [sum(design.weight(t, v) for t, v in read(b)).ravel()]})

    units = checkpointed(series.select("t", "v").mapInPandas(parts, "n long, zw array<double>, r1 array<double>, r2 array<double>").where("n > 0"))
    n_obs, n_units = units.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n_obs < k + 1:
        raise ValueError(f"{n_obs} rows for {k} coefficients")
    zw = _total(units, "zw").reshape(m, k + 1)
    a, b = zw[:, :k], zw[:, k]
    w1 = _inverse(_total(series.select("t", "v").mapInPandas(weight, "s array<double>"), "s").reshape(m, m))
    bread = _inverse(a.T @ w1 @ a)
    beta = bread @ a.T @ w1 @ b
    s = _outer(units, m, beta)
    w2 = _inverse(s)
    cov = bread @ a.T @ w1 @ s @ w1 @ a @ bread
    if two_step:
        first, bread = cov, _inverse(a.T @ w2 @ a)
        beta = bread @ a.T @ w2 @ b
        cov = bread
        if corrected:
            turn = bread @ a.T @ w2 @ _slopes(units, m, beta, w2 @ (b - a @ beta))
            cov = bread + turn @ bread + bread @ turn.T + turn @ first @ turn.T
    g = b - a @ beta
    p_of = lambda z: 2 * (1 - norm_cdf(abs(z)))
    out = [(name, float(e), float(se), float(e / se) if se > 0 else None, p_of(e / se) if se > 0 else None, None) for name, e, se in zip(names, beta, np.sqrt(np.maximum(np.diag(cov), 0)), strict=True)]
    j = float(g @ w2 @ g)
    out.append(("hansen_j", j, None, None, chi2_sf(j, m - k) if m > k else None, m - k))
    c = np.append(-beta, 1.0)
    weights = F.array(*[F.lit(float(x)) for x in np.outer(c, c).ravel()])
    for lag in (1, 2):
        product = F.aggregate(F.zip_with(f"r{lag}", weights, lambda x, q: x * q), F.lit(0.0), lambda x, q: x + q)
        total, squares = units.select(product.alias("s")).agg(F.sum("s"), F.sum(F.col("s") * F.col("s"))).first()
        z = total / squares**0.5 if squares else None
        out.append((f"ar{lag}", None, None, z, None if z is None else p_of(z), None))
    return spark.createDataFrame([(*r, int(n_obs), int(n_units), m) for r in out], "term string, estimate double, se double, z double, p_value double, df int, n_obs long, n_units long, n_instruments int")
