"""Logistic regressions by Newton's method: one pass of sums a step, for any number of models at once.

A step needs the gradient and the second derivatives, which are sums over the rows. Each task adds them up for its batches
of rows, the sums of the tasks are added by position, and only they come to the driver: a number per pair of coefficients
and model. A step costs the square of the number of coefficients per row, but there are about ten steps, however closely
the inputs depend on each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Parts = Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray, np.ndarray]]]


def newton_logistic(
    rows: DataFrame, parts: Parts, positives: list[int], negatives: list[int], width: int, max_iter: int = 100, tol: float = 1e-6
) -> np.ndarray:
    """One line per model, intercept first: the minimum of the mean class-balanced loss with unit L2 strength.

    ``parts`` gives what a batch of ``rows`` holds for the models: (model, inputs, labels). ``positives`` and
    ``negatives`` are the models' rows of both classes, so that the balanced weights of a model sum to its rows.
    A step is halved until it lowers the loss.
    """
    models, size = len(positives), width + 1
    upper = np.triu_indices(size)
    length = 1 + size + len(upper[0])
    pos, neg = np.array(positives, dtype=float), np.array(negatives, dtype=float)
    n = pos + neg

    def sums(beta: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, curve = np.zeros(models), np.zeros((models, size)), np.zeros((models, size, size))
            for batch in batches:
                for k, inputs, y in parts(batch):
                    if not live[k] or not len(y):
                        continue
                    x = np.hstack([np.ones((len(y), 1)), inputs])
                    margin = x @ beta[k]
                    weight = np.where(y == 1, 0.5 / pos[k], 0.5 / neg[k])
                    p = np.exp(-np.logaddexp(0, -margin))
                    loss[k] += weight @ (np.logaddexp(0, margin) - y * margin)
                    grad[k] += (weight * (p - y)) @ x
                    curve[k] += (x * (weight * p * (1 - p))[:, None]).T @ x
            for k in np.flatnonzero(live):
                values = np.concatenate([[loss[k]], grad[k], curve[k][upper]])
                place = np.arange(k * length, (k + 1) * length, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(values)], ["place", "v"])

        added = rows.mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(models * length)
        flat[added["place"].to_numpy()] = added["v"].to_numpy()
        flat = flat.reshape(models, length)
        curve = np.zeros((models, size, size))
        curve[:, upper[0], upper[1]] = curve[:, upper[1], upper[0]] = flat[:, 1 + size :]
        penalised = beta.copy()
        penalised[:, 0] = 0
        ridge = np.diag(np.append(0, np.ones(width)))
        return (
            flat[:, 0] + (penalised**2).sum(axis=1) / (2 * n),
            flat[:, 1 : 1 + size] + penalised / n[:, None],
            curve + ridge / n[:, None, None],
        )

    beta, live = np.zeros((models, size)), np.ones(models, dtype=bool)
    loss, grad, curve = sums(beta, live)
    step, part = np.zeros((models, size)), np.ones(models)
    fresh = live.copy()
    for _ in range(max_iter):
        live &= np.abs(grad).max(axis=1) > tol
        if not live.any():
            break
        for k in np.flatnonzero(live & fresh):
            step[k] = np.linalg.lstsq(curve[k], grad[k], rcond=None)[0]
        ahead = beta - part[:, None] * step
        found = sums(ahead, live)
        better = live & (found[0] <= loss)
        moved = loss - found[0]
        beta[better] = ahead[better]
        for old, new in zip((loss, grad, curve), found):
            old[better] = new[better]
        # a step that changes the loss by rounding only ends the search
        live &= ~(np.abs(moved) <= 1e-15 * np.abs(loss)) & (part > 1e-6)
        part, fresh = np.where(better, 1.0, part / 2), better
    return beta
