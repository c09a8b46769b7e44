"""Vector autoregressions under a Minnesota prior: dummy observations add their moments to the data's.

The data come as one aggregation of cross-products. Posterior draws are rows of ``range``: each task makes its own from the
posterior's few matrices, seeded by the draw's number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .regression import moments, square


class Moments(NamedTuple):
    """Cross-products of constant, lags (all columns of one lag after another) and columns, and the number of dates."""

    gram: np.ndarray
    t: int
    n: int
    p: int


class Posterior(NamedTuple):
    """B (constant and lags by column) given Sigma is normal about ``mean`` with Sigma x ``inverse``; Sigma is inverse Wishart."""

    mean: np.ndarray
    inverse: np.ndarray
    scale: np.ndarray
    freedom: int
    n: int
    p: int


def var_moments(df: DataFrame, order: str, cols: list[str], p: int) -> Moments:
    w = Window.orderBy(order)  # one row a date
    lagged = [F.lag(c, k).over(w).alias(f"{c}_L{k}") for k in range(1, p + 1) for c in cols]
    d = df.select(order, *cols, *lagged).dropna()
    row = moments(d, [], [F.lit(1.0), *[F.col(f"{c}_L{k}").cast("double") for k in range(1, p + 1) for c in cols], *[F.col(c).cast("double") for c in cols]]).first()
    if not row["n"]:
        raise ValueError("no date has all lags")
    return Moments(square(row["m"], 1 + len(cols) * (p + 1)), row["n"], len(cols), p)


def own_deviations(m: Moments) -> np.ndarray:
    """Residual deviation of each column on a constant and its own lags, which scales the prior (1 where there is none)."""
    out = []
    for i in range(m.n):
        own, at = [0, *[1 + k * m.n + i for k in range(m.p)]], 1 + m.n * m.p + i
        a, b = m.gram[np.ix_(own, own)], m.gram[own, at]
        out.append(float(np.sqrt(max(m.gram[at, at] - b @ np.linalg.pinv(a, hermitian=True) @ b, 0) / m.t)) or 1.0)
    return np.array(out)


def minnesota_mean(m: Moments, tight: float = 0.2, cross: float = 0.5, decay: float = 1.0, constant_sd: float = 1e3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(constant, A of shape (p, n, n), Sigma): each equation's mean under a random walk prior.

    A coefficient's prior deviation is ``tight`` times (for other columns' lags times ``cross``) the lag to the power -``decay``, over the lagged column's
    own deviation. Sigma is of the residuals at the mean, over t - 1.
    """
    k, sd = 1 + m.n * m.p, own_deviations(m)
    constant, a = np.zeros(m.n), np.zeros((m.p, m.n, m.n))
    beta = np.zeros((k, m.n))
    for i in range(m.n):
        weight = np.array([sd[j] * lag**decay / (tight if j == i else tight * cross) for lag in range(1, m.p + 1) for j in range(m.n)])
        prior = np.diag(np.concatenate([[1 / constant_sd], weight]) ** 2)
        right = m.gram[:k, k + i].copy()
        right[1 + i] += weight[i] ** 2
        beta[:, i] = np.linalg.solve(m.gram[:k, :k] + prior, right)
        constant[i] = beta[0, i]
        a[:, i] = beta[1:, i].reshape(m.p, m.n)
    cross_ = beta.T @ m.gram[:k, k:]
    return constant, a, (m.gram[k:, k:] - cross_ - cross_.T + beta.T @ m.gram[:k, :k] @ beta) / max(1, m.t - 1)


def minnesota_posterior(m: Moments, tight: float = 0.2, decay: float = 1.0, constant_sd: float = 1e3) -> Posterior:
    """The conjugate posterior: one prior for all equations, so other columns' lags are shrunk as own ones are."""
    k, sd = 1 + m.n * m.p, own_deviations(m)
    weight = np.array([sd[j] * lag**decay / tight for lag in range(1, m.p + 1) for j in range(m.n)])
    gram = m.gram.copy()
    gram[:k, :k] += np.diag(np.concatenate([[1 / constant_sd], weight]) ** 2)
    for i in range(m.n):
        gram[1 + i, k + i] += weight[i] ** 2
        gram[k + i, 1 + i] += weight[i] ** 2
        gram[k + i, k + i] += weight[i] ** 2 + sd[i] ** 2
    inverse = np.linalg.inv(gram[:k, :k])
    mean = inverse @ gram[:k, k:]
    return Posterior(mean, (inverse + inverse.T) / 2, gram[k:, k:] - mean.T @ gram[:k, k:], m.t + m.n * m.p + m.n + 1 - k, m.n, m.p)


def draw(post: Posterior, seed: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(B, Sigma) of one draw: Sigma by Bartlett's triangular factor of its inverse, then B."""
    r, n = np.random.default_rng([seed, number]), post.n
    factor = np.tril(r.standard_normal((n, n)), -1) + np.diag(np.sqrt(r.chisquare(post.freedom - np.arange(n))))
    root = np.linalg.cholesky(np.linalg.inv(post.scale)) @ factor
    sigma = np.linalg.inv(root @ root.T)
    sigma = (sigma + sigma.T) / 2
    return post.mean + np.linalg.cholesky(post.inverse) @ r.standard_normal(post.mean.shape) @ np.linalg.cholesky(sigma).T, sigma


def posterior_responses(spark: SparkSession, cols: list[str], post: Posterior, draws: int = 1000, horizon: int = 12, seed: int = 0) -> DataFrame:
    """draw, h, response, shock, value: orthogonal responses of posterior draws, any number of tasks. A draw depends on seed and number alone."""
    from .series import moving_average

    n, p = post.n, post.p

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                b, sigma = draw(post, seed, int(k))
                path = moving_average(np.array([b[1 + j * n : 1 + (j + 1) * n].T for j in range(p)]), horizon) @ np.linalg.cholesky(sigma)
                out += [(int(k), h, cols[i], cols[j], float(path[h, i, j])) for h in range(horizon + 1) for i in range(n) for j in range(n)]
            yield pd.DataFrame(out, columns=["draw", "h", "response", "shock", "value"])

    return spark.range(draws).mapInPandas(run, "draw long, h int, response string, shock string, value double")
