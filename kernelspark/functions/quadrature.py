"""Quadrature nodes and zeros of Bessel functions, as eigenvalues of tridiagonal matrices."""

from __future__ import annotations

import itertools
import math

import numpy as np


def gauss_legendre(n: int, low: float = -1.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """n nodes and weights on low .. high: the nodes are the eigenvalues of the Legendre recurrence's matrix, the weights come of its vectors."""
    if n < 1:
        raise ValueError("at least one node")
    k = np.arange(1, n)
    off = k / np.sqrt(4.0 * k * k - 1)
    x, v = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    # the rule is symmetric; what rounding takes of that is put back
    x, w = (x - x[::-1]) / 2, (v[0] ** 2 + v[0, ::-1] ** 2)
    return (low + high) / 2 + (high - low) / 2 * x, (high - low) / 2 * w


def bessel_zeros(nu: float, n: int) -> np.ndarray:
    """The first n positive zeros of J_nu, nu > -1: 4 over their squares are the eigenvalues of the recurrence's compact matrix, which is cut where they have settled."""
    size = 3 * n + 40
    k = np.arange(1, size + 1)
    main = 2 / ((nu + 2 * k - 1) * (nu + 2 * k + 1))
    off = 1 / ((nu + 2 * k[:-1] + 1) * np.sqrt((nu + 2 * k[:-1]) * (nu + 2 * k[:-1] + 2)))
    t = np.linalg.eigvalsh(np.diag(main) + np.diag(off, 1) + np.diag(off, -1))[::-1][:n]
    return 2 / np.sqrt(t)


def tensor_rule(n: int, dim: int, low: float = -1.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (n^dim, dim) and weights of the product rule, the last dimension fastest."""
    x, w = gauss_legendre(n, low, high)
    return np.array(list(itertools.product(x, repeat=dim))).reshape(-1, dim), np.array([math.prod(p) for p in itertools.product(w, repeat=dim)])
