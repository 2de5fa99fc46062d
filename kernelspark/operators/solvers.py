"""Krylov and gradient solvers for Hermitian positive systems, on the driver: their size is the grid's, not the data's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Op = Callable[[np.ndarray], np.ndarray]


@dataclass
class Result:
    x: np.ndarray
    iterations: int
    residual: float
    converged: bool
    history: list[float] = field(default_factory=list)


def _finish(apply: Op, b: np.ndarray, x: np.ndarray, k: int, tol: float, history: list[float]) -> Result:
    scale = np.linalg.norm(b) or 1.0
    res = float(np.linalg.norm(b - apply(x)) / scale)
    return Result(x, k, res, bool(res <= 10 * tol), history)


def pcg(apply: Op, b: np.ndarray, tol: float = 1e-8, most: int = 1000, precond: Op | None = None, x0: np.ndarray | None = None) -> Result:
    """Preconditioned conjugate gradients; a direction without positive curvature is an error."""
    x = np.zeros_like(b) if x0 is None else x0.astype(b.dtype).copy()
    r = b - apply(x) if x0 is not None else b.copy()
    z = precond(r) if precond else r
    p, rz, scale = z.copy(), np.vdot(r, z).real, np.linalg.norm(b) or 1.0
    history = [float(np.linalg.norm(r) / scale)]
    k = 0
    while history[-1] > tol and k < most:
        ap = apply(p)
        curve = np.vdot(p, ap).real
        if not curve > 0:
            raise ArithmeticError("the operator is not positive definite")
        a = rz / curve
        x, r = x + a * p, r - a * ap
        z = precond(r) if precond else r
        new = np.vdot(r, z).real
        p, rz = z + (new / rz) * p, new
        history.append(float(np.linalg.norm(r) / scale))
        k += 1
    return _finish(apply, b, x, k, tol, history)


@dataclass
class BlockResult:
    """Solutions of many right-hand sides, with each column's steps and relative residual (recomputed at the end)."""

    x: np.ndarray
    iterations: np.ndarray
    residual: np.ndarray


def block_pcg(apply: Op, b: np.ndarray, tol: float = 1e-8, most: int = 1000, precond: Op | None = None) -> BlockResult:
    """Conjugate gradients for all columns of b at once: one product a step for those that have not stopped; each column stops by itself."""
    x, r = np.zeros_like(b), b.copy()
    scale = np.linalg.norm(b, axis=0)
    scale[scale == 0] = 1.0
    steps = np.zeros(b.shape[1], int)
    live = np.flatnonzero(np.linalg.norm(r, axis=0) / scale > tol)
    z = precond(r[:, live]) if precond else r[:, live]
    p, rz = z.copy(), np.einsum("ij,ij->j", r[:, live].conj(), z).real
    for _ in range(most):
        if not len(live):
            break
        ap = apply(p)
        curve = np.einsum("ij,ij->j", p.conj(), ap).real
        if not (curve > 0).all():
            raise ArithmeticError("the operator is not positive definite")
        a = rz / curve
        x[:, live] += a * p
        r[:, live] -= a * ap
        steps[live] += 1
        go = np.linalg.norm(r[:, live], axis=0) / scale[live] > tol
        live, p, rz = live[go], p[:, go], rz[go]
        if len(live):
            z = precond(r[:, live]) if precond else r[:, live]
            new = np.einsum("ij,ij->j", r[:, live].conj(), z).real
            p, rz = z + (new / rz) * p, new
    return BlockResult(x, steps, np.linalg.norm(b - apply(x), axis=0) / scale)


def richardson(apply: Op, b: np.ndarray, eta: float, tol: float = 1e-8, most: int = 10_000, precond: Op | None = None, recompute: bool = False, every: int = 1) -> Result:
    """x += eta P (b - A x); stops where the residual is no longer finite.

    The residual is updated along with x, one product a step; recompute: made
    anew from x, which drifts less.  every: steps between two looks at its norm.
    """
    x, r, scale = np.zeros_like(b), b.copy(), np.linalg.norm(b) or 1.0
    history, k = [1.0], 0
    while history[-1] > tol and k < most:
        step = eta * (precond(r) if precond else r)
        x = x + step
        r = b - apply(x) if recompute else r - apply(step)
        k += 1
        if k % every and k < most:
            continue
        now = float(np.linalg.norm(r) / scale)
        if not np.isfinite(now):
            break
        history.append(now)
    return _finish(apply, b, x, k, tol, history)


def tune_step(apply: Op, b: np.ndarray, etas: list[float], steps: int = 25, precond: Op | None = None) -> float:
    """The step size with the lowest residual after a pilot run; the fewer iterations decide a tie."""
    runs = [(richardson(apply, b, e, 0.0, steps, precond), e) for e in etas]
    return min(((r.residual if np.isfinite(r.residual) else np.inf, r.iterations, e) for r, e in runs))[2]


def direct(matrix: np.ndarray, b: np.ndarray, most: int = 6000) -> Result:
    if len(b) > most:
        raise ValueError(f"{len(b)} unknowns are too many for a direct solve")
    x = np.linalg.solve(matrix, b)
    return _finish(lambda v: matrix @ v, b, x, 0, 1e-10, [])


# spectra --------------------------------------------------------------------------------------------------------------


def top_eigen(apply: Op, size: int, q: int, method: str = "subspace", tol: float = 1e-6, most: int = 200, seed: int = 0, complex_: bool = True, precond: Op | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The q + 1 largest eigenvalues, descending, and q eigenvectors; apply takes blocks (size, columns). precond: for methods that take one (lobpcg)."""
    q = min(q, size - 1)
    more = {"precond": precond} if precond is not None else {}
    return METHODS[method](apply, size, q, tol, most, seed, complex_, **more)


def _start(size: int, n: int, seed: int, complex_: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((size, n))
    return np.linalg.qr(x + 1j * rng.standard_normal((size, n)) if complex_ else x)[0]


def _ritz(apply: Op, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    av = apply(v)
    t, u = np.linalg.eigh((v.conj().T @ av + (v.conj().T @ av).conj().T) / 2)
    order = np.argsort(-t)
    return t[order], v @ u[:, order], av @ u[:, order]


def _settled(t, v, av, q, tol) -> bool:
    res = np.linalg.norm(av[:, :q] - v[:, :q] * t[:q], axis=0) / np.maximum(np.abs(t[:q]), 1e-300)
    return bool(np.quantile(res, 0.9) <= tol and res.max() <= 5 * tol)


def _subspace(apply, size, q, tol, most, seed, complex_):
    v = _start(size, min(size, q + 1 + max(8, q // 4)), seed, complex_)
    for k in range(most):
        v = np.linalg.qr(apply(v))[0]
        if k % 4 == 3 or k == most - 1:
            t, w, aw = _ritz(apply, v)
            if _settled(t, w, aw, q, tol):
                break
            v = w
    t, w, _ = _ritz(apply, v)
    return t[: q + 1], w[:, :q]


def _lanczos(apply, size, q, tol, most, seed, complex_):
    """Lanczos with full reorthogonalisation, then Rayleigh-Ritz. Where its space is exhausted (repeated values) a new start outside of it goes on."""
    steps = min(size, max(4 * q + 40, 60))
    basis = np.zeros((size, steps), complex if complex_ else float)
    v, top = _start(size, 1, seed, complex_), 0.0
    for k in range(steps):
        basis[:, k : k + 1] = v
        w = apply(v)
        top = max(top, float(np.linalg.norm(w)))
        for _ in range(2):
            w = w - basis[:, : k + 1] @ (basis[:, : k + 1].conj().T @ w)
        if np.linalg.norm(w) < 1e-10 * top:
            w = _start(size, 1, seed + k + 1, complex_)
            for _ in range(2):
                w = w - basis[:, : k + 1] @ (basis[:, : k + 1].conj().T @ w)
        n = np.linalg.norm(w)
        if not n:
            break
        v = w / n
    t, w, _ = _ritz(apply, np.linalg.qr(basis[:, : k + 1])[0])
    return t[: q + 1], w[:, :q]


def _krylov(apply, size, q, tol, most, seed, complex_):
    """Block Krylov spaces with thick restarts: Ritz vectors are kept, settled ones are locked, and only the others' residuals are multiplied again."""
    block = min(size, max(4, q // 2 + 1))
    kept = min(size, q + 1 + max(4, q // 4))
    room = min(size, kept + 4 * block)
    new = _start(size, block, seed, complex_)
    basis, image = new[:, :0], new[:, :0]
    t, v, av = np.zeros(0), basis, basis
    for _ in range(most):
        while basis.shape[1] < room and new.shape[1]:
            turned = apply(new)
            basis, image = np.concatenate((basis, new), 1), np.concatenate((image, turned), 1)
            new = _more(basis, turned)[:, : room - basis.shape[1]]
        h = basis.conj().T @ image
        t, u = np.linalg.eigh((h + h.conj().T) / 2)
        t, u = t[::-1][:kept], u[:, ::-1][:, :kept]
        v, av = basis @ u, image @ u
        # one settled more than asked for: the value after the vectors counts as well
        if basis.shape[1] >= size or _settled(t, v, av, min(q + 1, len(t)), tol):
            break
        off = np.linalg.norm(av - v * t, axis=0) > tol * np.abs(t[0])
        basis, image = v, av
        new = _more(basis, (av - v * t)[:, off][:, :block])
        if not new.shape[1]:
            break
    return t[: q + 1], v[:, :q]


def _more(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Orthonormal directions of x outside of the basis; those that are nearly inside are dropped."""
    scale = np.linalg.norm(x, axis=0).max(initial=0.0)
    for _ in range(2):
        x = x - basis @ (basis.conj().T @ x)
    if not scale or not x.shape[1]:
        return x[:, :0]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-12 * scale]
    u = u - basis @ (basis.conj().T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def _chebyshev(apply, size, q, tol, most, seed, complex_):
    """Subspace iteration with Chebyshev filters. The damped band ends at the block's last Ritz value and follows it; the degree is what lifts the q-th wanted value well above the band."""
    v = _start(size, min(size, q + 1 + max(8, q // 4)), seed, complex_)
    t, v, av = _ritz(apply, v)
    for _ in range(max(1, most // 4)):
        if _settled(t, v, av, q, tol):
            break
        low, high = 0.0, max(t[-1], 1e-300)
        centre, half = (high + low) / 2, (high - low) / 2
        above = max((t[q - 1] - centre) / half, 1 + 1e-6)
        degree = int(np.clip(np.ceil(np.arccosh(1e3) / np.arccosh(above)), 2, 30))
        # the first product with the block is known
        old, new = v, (av - centre * v) / half
        for _ in range(degree - 1):
            old, new = new, 2 * (apply(new) - centre * new) / half - old
            size_ = np.linalg.norm(new)
            if size_ > 1e100:
                old, new = old / size_, new / size_
        t, v, av = _ritz(apply, np.linalg.qr(new)[0])
    return t[: q + 1], v[:, :q]


def _lobpcg(apply, size, q, tol, most, seed, complex_, precond: Op | None = None):
    """Locally optimal block search: Ritz vectors, residuals (preconditioned, if there is something to do it with) and last directions. Where it stalls or fails, subspace iteration takes over."""
    v = _start(size, min(size, q + 1 + 4), seed, complex_)
    n, p, best, idle = v.shape[1], v[:, :0], np.inf, 0
    t, v, av = _ritz(apply, v)
    ap = av[:, :0]
    try:
        for _ in range(most):
            if _settled(t, v, av, q, tol):
                return t[: q + 1], v[:, :q]
            r = av - v * t
            off = float(np.linalg.norm(r[:, :q], axis=0).max())
            idle = 0 if off < 0.9 * best else idle + 1
            best = min(best, off)
            if idle > 25 or not np.isfinite(off):
                break
            w = _more(v, precond(r) if precond else r)
            aw = apply(w)
            # directions of the step before, outside of what is there; their products follow by the same combination
            both = np.concatenate((v, w), 1)
            images = np.concatenate((av, aw), 1)
            c = both.conj().T @ p
            p, ap = p - both @ c, ap - images @ c
            u, s, z = np.linalg.svd(p, full_matrices=False)
            keep = s > 1e-8 * s.max(initial=1e-300)
            p, ap = u[:, keep], (ap @ z.conj().T[:, keep]) / s[keep]
            basis, image = np.concatenate((both, p), 1), np.concatenate((images, ap), 1)
            # whatever orthogonality rounding has taken is made good by solving with the Gram matrix
            g, h = basis.conj().T @ basis, basis.conj().T @ image
            root = np.linalg.inv(np.linalg.cholesky((g + g.conj().T) / 2))
            h = root @ ((h + h.conj().T) / 2) @ root.conj().T
            t2, y = np.linalg.eigh(h)
            y = root.conj().T @ y[:, ::-1][:, :n]
            new, anew = basis @ y, image @ y
            p, ap = new - v @ y[:n], anew - av @ y[:n]
            t, v, av = t2[::-1][:n], new, anew
    except np.linalg.LinAlgError:
        pass
    return _subspace(apply, size, q, tol, most, seed, complex_)


def _mixed(apply, size, q, tol, most, seed, complex_):
    """Subspace iteration in single precision (with the operator's own form of it, if it has one), Rayleigh-Ritz in double; below what single precision reaches, double goes on."""
    kind = np.complex64 if complex_ else np.float32
    low = apply.single() if hasattr(apply, "single") else apply
    v = _start(size, min(size, q + 1 + max(8, q // 4)), seed, complex_).astype(kind)
    last = np.inf
    for _ in range(most // 4):
        for _ in range(4):
            v = np.linalg.qr(low(v).astype(kind, copy=False))[0]
        t, w, aw = _ritz(apply, np.linalg.qr(v.astype(complex if complex_ else float))[0])
        off = float((np.linalg.norm(aw - w * t, axis=0)[:q] / np.maximum(np.abs(t[:q]), 1e-300)).max())
        if _settled(t, w, aw, q, tol):
            return t[: q + 1], w[:, :q]
        if off < 1e-5 or off > 0.5 * last and off < 1e-3:
            break
        last, v = off, w.astype(kind)
    for _ in range(most):
        t, w, aw = _ritz(apply, np.linalg.qr(aw)[0])
        if _settled(t, w, aw, q, tol):
            break
    return t[: q + 1], w[:, :q]


def _block_power(apply, size, q, tol, most, seed, complex_):
    """Powers of A on a block, orthonormal again after every second product; one Rayleigh-Ritz step when its span has settled."""
    v = np.linalg.qr(_start(size, min(size, q + 1 + max(8, q // 4)), seed, complex_))[0]
    for _ in range(most // 2):
        w = apply(v)
        w = np.linalg.qr(apply(w / np.linalg.norm(w)))[0]
        turned = np.linalg.norm(w - v @ (v.conj().T @ w), axis=0)[:q].max()
        v = w
        if turned <= tol:
            break
    t, w, _ = _ritz(apply, v)
    return t[: q + 1], w[:, :q]


#: Methods by name; more can be put in.
METHODS: dict[str, Callable] = {"subspace": _subspace, "lanczos": _lanczos, "block_krylov": _krylov, "chebyshev": _chebyshev, "lobpcg": _lobpcg, "mixed": _mixed, "block_power": _block_power}


class Deflation:
    """P v = v - U ((1 - mu / theta) U* v): the top eigenvalues theta become mu."""

    def __init__(self, vectors: np.ndarray, theta: np.ndarray, mu: float | None = None):
        q = vectors.shape[1]
        mu = float(theta[q] if mu is None and len(theta) > q else theta[q - 1] if mu is None else mu)
        theta = np.asarray(theta[:q], float)
        if vectors.ndim != 2 or len(theta) != q:
            raise ValueError("one value a vector")
        if np.any(theta <= 0) or np.any(np.diff(theta) > 1e-12 * np.abs(theta[:1])):
            raise ValueError("values must be positive and descending")
        if not 0 < mu <= theta.min() * (1 + 1e-12):
            raise ValueError("mu must lie between 0 and the smallest value")
        self.u, self.theta, self.mu = vectors, theta, mu

    def __call__(self, v: np.ndarray) -> np.ndarray:
        f = (1 - self.mu / self.theta).reshape(-1, *[1] * (v.ndim - 1))
        return v - self.u @ (f * (self.u.conj().T @ v))

    def root(self, v: np.ndarray) -> np.ndarray:
        """P^(1/2) v, so that the preconditioned operator stays Hermitian."""
        f = (1 - np.sqrt(self.mu / self.theta)).reshape(-1, *[1] * (v.ndim - 1))
        return v - self.u @ (f * (self.u.conj().T @ v))


class DominantSubspace:
    """P^-1 v = v + U ((1 / theta - 1) U* v), the values of rank above a threshold (absolute, relative to the first, or above a shift)."""

    def __init__(self, vectors: np.ndarray, theta: np.ndarray, threshold: float = 0.0, mode: str = "absolute", shift: float = 0.0):
        edge = {"absolute": threshold, "relative": threshold * theta[0], "shifted": shift + threshold}[mode]
        keep = theta[: vectors.shape[1]] > edge
        self.u, self.theta = vectors[:, keep], theta[: vectors.shape[1]][keep]

    def __call__(self, v: np.ndarray) -> np.ndarray:
        f = (1 / self.theta - 1).reshape(-1, *[1] * (v.ndim - 1))
        return v + self.u @ (f * (self.u.conj().T @ v))


def sample_modes(weights: np.ndarray, n: int, low: float = 0.5, seed: int = 0) -> np.ndarray:
    """Indices of n modes: a share ``low`` by largest squared weight, the rest drawn by squared weight without replacement."""
    p = weights**2
    first = np.argsort(-p, kind="stable")[: int(round(n * low))]
    rest = np.setdiff1d(np.arange(len(p)), first)
    key = np.log(np.random.default_rng(seed).random(len(rest))) / np.maximum(p[rest], 1e-300)
    return np.sort(np.concatenate((first, rest[np.argsort(-key, kind="stable")[: n - len(first)]])))


def coordinate_nystrom(system, q: int, n: int, low: float = 0.5, lift: bool = True, refine: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Approximate top eigenpairs from the block of the system on sampled modes, gathered from the lags."""
    at = sample_modes(system.w, min(n, system.size), low, seed)
    j = system.grid.modes()[at]
    lag = (j[:, None] - j[None, :]) + 2 * np.array(system.grid.ms)
    block = system.w[at][:, None] * system.lags[tuple(lag[..., k] for k in range(system.grid.dim))] * system.w[at]
    t, u = np.linalg.eigh(block)
    t, u = t[::-1][: q + 1], u[:, ::-1][:, : q + 1]
    full = np.zeros((system.size, u.shape[1]), complex)
    full[at] = u
    if lift:
        full = system(full) - system.reg * full
    v = np.linalg.qr(full)[0]
    if refine:
        t, v, _ = _ritz(system, v)
        return t[: q + 1], v[:, :q]
    return np.maximum(t, 0) + system.reg, v[:, :q]


def split(apply: Op, precond: Deflation) -> Op:
    """P^(1/2) A P^(1/2): Hermitian, with the eigenvalues of P A, so that quadrature sees the preconditioned spectrum."""
    return lambda v: precond.root(apply(precond.root(v)))


def lanczos_quadrature(apply: Op, size: int, probe: int, steps: int, complex_: bool = True, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, weights) of one probe: Gauss quadrature of the spectral measure of a random vector, or of a given one."""
    v = _start(size, 1, 1000 + probe, complex_)[:, 0] if start is None else start / np.linalg.norm(start)
    basis, alpha, beta = [v], [], []
    for k in range(min(steps, size)):
        w = apply(basis[k])
        alpha.append(np.vdot(basis[k], w).real)
        for _ in range(2):
            for b in basis:
                w = w - b * np.vdot(b, w)
        n = np.linalg.norm(w)
        if n <= 1e-10 * max(1.0, abs(alpha[0])) or k + 1 == min(steps, size):
            break
        beta.append(n)
        basis.append(w / n)
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    nodes, u = np.linalg.eigh(t)
    return nodes, u[0] ** 2


def subspace_error(u: np.ndarray, v: np.ndarray) -> dict[str, float]:
    """Distance of two orthonormal bases: Frobenius norm of the projectors' difference and the sine of the largest angle."""
    s = np.clip(np.linalg.svd(u.conj().T @ v, compute_uv=False), 0, 1)
    return {"projector": float(np.sqrt(max(0.0, u.shape[1] + v.shape[1] - 2 * (s**2).sum()))), "sin_max": float(np.sqrt(max(0.0, 1 - s.min() ** 2)))}
