"""Plain full-table versions of the dynamic programs, and closed forms, that tests hold the library against."""

from __future__ import annotations

import numpy as np

SUBSTITUTE, DELETE, INSERT = 0, 1, 2


def edit_path(substitution: np.ndarray, deletion: np.ndarray, insertion: np.ndarray, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> tuple[float, list[int]]:
    """Least cost of turning m symbols into n, and the moves; equal costs prefer substitution, then deletion.

    ``substitution`` is m x n, or a table of kinds with the kind of each symbol in ``rows`` and ``columns``.
    Cells of one anti-diagonal do not depend on each other and are filled together; of the costs two
    diagonals are held, of the moves one byte a cell.
    """
    m, n = len(deletion), len(insertion)
    rows, columns = np.arange(m) if rows is None else rows, np.arange(n) if columns is None else columns
    down, right = np.concatenate([[0.0], np.cumsum(deletion)]), np.concatenate([[0.0], np.cumsum(insertion)])
    move = np.zeros((m + 1, n + 1), np.int8)
    move[1:, 0], move[0, 1:] = DELETE, INSERT
    older, old = np.full(m + 1, np.inf), np.full(m + 1, np.inf)  # costs of the last two diagonals by row
    old[0] = 0.0
    for d in range(1, m + n + 1):
        new = np.full(m + 1, np.inf)
        if d <= n:
            new[0] = right[d]
        if d <= m:
            new[d] = down[d]
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        if len(i):
            j = d - i
            options = np.stack([older[i - 1] + substitution[rows[i - 1], columns[j - 1]], old[i - 1] + deletion[i - 1], old[i] + insertion[j - 1]])
            move[i, j] = options.argmin(0)
            new[i] = options.min(0)
        older, old = old, new
    moves, i, j = [], m, n
    while i or j:
        k = int(move[i, j])
        moves.append(k)
        i, j = i - (k != INSERT), j - (k != DELETE)
    return float(old[m]), moves[::-1]


def dtw_path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Warping path between two series: squared difference of numbers, Euclidean distance of vectors; ties go diagonally, then along the first."""
    if not len(a) or not len(b):
        return []
    a, b = np.asarray(a, float), np.asarray(b, float)
    local = (a[:, None] - b) ** 2 if a.ndim == 1 else np.sqrt(((a[:, None] - b) ** 2).sum(2))
    m, n = local.shape
    cost, move = np.full((m + 1, n + 1), np.inf), np.zeros((m + 1, n + 1), np.int8)
    cost[0, 0] = 0.0
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        options = np.stack([cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]])
        move[i, j] = options.argmin(0)
        cost[i, j] = local[i - 1, j - 1] + options.min(0)
    path, i, j = [], m, n
    while i and j:
        path.append((i - 1, j - 1))
        k = int(move[i, j])
        i, j = i - (k != 2), j - (k != 1)
    return path[::-1]


def ctc_states(labels: np.ndarray, blank: int) -> np.ndarray:
    states = np.full(2 * len(labels) + 1, blank)
    states[1::2] = labels
    return states


def _may_skip(states: np.ndarray, blank: int) -> np.ndarray:
    skip = np.zeros(len(states), bool)
    skip[2:] = (states[2:] != blank) & (states[2:] != states[:-2])
    return skip


def ctc_viterbi(log_probs: np.ndarray, labels: np.ndarray, blank: int = 0) -> tuple[np.ndarray, float]:
    """Best state of each frame over the labels with blanks between; ties stay, then come from the state before; (empty, -inf) if none fits."""
    states = ctc_states(labels, blank)
    skip = _may_skip(states, blank)
    f, s = len(log_probs), len(states)
    score = np.full(s, -np.inf, np.float32)
    if not f:
        return np.zeros(0, int), -np.inf
    emit = log_probs.astype(np.float32)[:, states]
    score[: min(2, s)] = emit[0, : min(2, s)]
    back = np.zeros((f, s), np.int8)
    for t in range(1, f):
        one = np.concatenate([[-np.inf], score[:-1]])
        two = np.where(skip, np.concatenate([[-np.inf, -np.inf], score[:-2]])[:s], -np.inf)
        options = np.stack([score, one, two])
        back[t] = options.argmax(0)
        score = (options.max(0) + emit[t]).astype(np.float32)
    last = s - 1 if s == 1 or score[s - 1] >= score[s - 2] else s - 2
    if not np.isfinite(score[last]):
        return np.zeros(0, int), -np.inf
    path = np.zeros(f, int)
    path[-1] = last
    for t in range(f - 1, 0, -1):
        path[t - 1] = path[t] - back[t, path[t]]
    return path, float(score[last])


def ctc_posteriors(log_probs: np.ndarray, labels: np.ndarray, blank: int = 0) -> np.ndarray | None:
    """Posterior of each state in each frame (forward-backward); None if no path fits."""
    states = ctc_states(labels, blank)
    skip = _may_skip(states, blank)
    f, s = len(log_probs), len(states)
    if not f:
        return None
    emit = log_probs[:, states]

    def sweep(emit, skip):
        out = np.full((f, s), -np.inf)
        out[0, : min(2, s)] = emit[0, : min(2, s)]
        for t in range(1, f):
            p = out[t - 1]
            one = np.concatenate([[-np.inf], p[:-1]])
            two = np.where(skip, np.concatenate([[-np.inf, -np.inf], p[:-2]])[:s], -np.inf)
            out[t] = np.logaddexp(np.logaddexp(p, one), two) + emit[t]
        return out

    with np.errstate(invalid="ignore"):
        forward = sweep(emit, skip)
        backward_skip = np.zeros(s, bool)
        backward_skip[2:] = skip[::-1][:-2] if s > 2 else False
        backward = sweep(emit[::-1, ::-1], backward_skip)[::-1, ::-1]
        total = np.logaddexp.reduce(forward[-1, -2:])
        if not np.isfinite(total):
            return None
        return np.exp(forward + backward - emit - total)


def savgol_delta(values: np.ndarray, window: int = 11, order: int = 2) -> np.ndarray:
    """First derivative of a moving polynomial fit; the outer half windows use the first and last fit; under 3 values: zeros."""
    values = np.asarray(values, float)
    n = len(values)
    if n < 3:
        return np.zeros(n)
    window = max(3, min(window, n if n % 2 else n - 1))
    order, half = min(order, window - 1), window // 2
    x = np.arange(window) - half
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True).astype(float))
    out = np.empty(n)
    out[half : n - half] = np.convolve(values, fit[1][::-1], "valid")
    slope = lambda part, at: sum(k * c * at ** (k - 1) for k, c in enumerate(fit @ part) if k)
    out[:half] = [slope(values[:window], float(p - half)) for p in range(half)]
    out[n - half :] = [slope(values[-window:], float(p - half)) for p in range(window - half, window)]
    return out


def shrunk_inverse(rows: np.ndarray) -> np.ndarray | None:
    """Inverse of the Ledoit-Wolf shrunk covariance (towards a scaled identity); None if singular."""
    x = rows - rows.mean(0)
    n, p = x.shape
    sample = x.T @ x / n
    mu = np.trace(sample) / p
    spread = ((sample - mu * np.eye(p)) ** 2).sum() / p
    noise = (((x**2).T @ (x**2)) / n - sample**2).sum() / (n * p)
    weight = 0.0 if spread == 0 else min(noise, spread) / spread
    try:
        return np.linalg.inv((1 - weight) * sample + weight * mu * np.eye(p))
    except np.linalg.LinAlgError:
        return None
