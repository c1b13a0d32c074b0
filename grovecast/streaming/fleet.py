"""Detectors and casters of many series in step: the i-th rows of all series at once. No Spark in here.

Draws, sample keys and which trees take a row follow from a series' row count alone, so where every row has its number
one set of them serves all series. Their trees lie in one grove, and statistics are arrays over series; results are
those of online.Detector and online.Caster. Only rows that are graded are explained one by one.
"""

from __future__ import annotations

import math

import numpy as np

from ..operators.forest_kernel import Nodes, completed
from .grove import Grove, LiveForest
from .online import Caster, Decayed, Detector, OnlineForest, Result, Settings, Threshold

#: bytes of trees and rows that are in step together
TREE_BYTES, ROWS = 64 << 20, 1 << 19


def fits(s: Settings, calibration: dict) -> bool:
    """Are series of these settings served in step? All others go row by row."""
    plain = s.inputs == 1 and s.mode == "STANDARD" and s.transform in ("NONE", "SUBTRACT_MA", "NORMALIZE") and s.weights is None
    return plain and s.scoring != "DISTANCE" and s.impute_fraction > 0 and not calibration.get("estimator")


def most(s: Settings) -> int:
    """Series in step, by the memory of their trees."""
    return max(1, TREE_BYTES // (s.trees * 2 * s.size * (16 * s.shingle + 80)))


class Means:
    """Decayed of many series."""

    def __init__(self, decay: float, count: int) -> None:
        self.decay, self.w, self.s, self.q = decay, np.zeros(count), np.zeros(count), np.zeros(count)

    def add(self, x: np.ndarray, at=None) -> None:
        at = slice(len(x)) if at is None else at
        keep = 1.0 - self.decay
        self.w[at], self.s[at], self.q[at] = self.w[at] * keep + 1.0, self.s[at] * keep + x, self.q[at] * keep + x * x

    def mean(self, n: int) -> np.ndarray:
        return np.where(self.w[:n] > 0, self.s[:n] / np.where(self.w[:n] > 0, self.w[:n], 1.0), 0.0)

    def dev(self, n: int) -> np.ndarray:
        m = self.mean(n)
        return np.where(self.w[:n] > 0, np.sqrt(np.maximum(0.0, self.q[:n] / np.where(self.w[:n] > 0, self.w[:n], 1.0) - m * m)), 0.0)

    def one(self, k: int) -> Decayed:
        out = Decayed(self.decay)
        out.w, out.s, out.q, out.n = float(self.w[k]), float(self.s[k]), float(self.q[k]), int(self.w[k] > 0)
        return out


class Upper:
    """Upper ends of a grove's boxes, taken where they are asked for."""

    def __init__(self, grove: Grove) -> None:
        self.box, self.dims = grove.box, grove.dims

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return -self.box.take(at, 0)[..., self.dims :]


class Own(LiveForest):
    """The trees of one series among those of all, with what was found for the row at hand: its attribution, the value
    expected in its place, and its score where an earlier anomaly in the window is replaced."""

    def __init__(self, grove: Grove, live: np.ndarray, found: tuple[np.ndarray, np.ndarray], want: float, again: float) -> None:
        super().__init__(grove, live, [], [])
        self.found, self.want, self.again = found, want, again

    def attribution(self, q: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
        return self.found

    def impute(self, x: np.ndarray, missing) -> np.ndarray:
        out = np.array(x, float)
        out[missing] = self.want
        return out

    def score(self, x: np.ndarray) -> float:
        return self.again


def _nodes(g: Grove, live) -> Nodes:
    return Nodes(g.kids, g.dim, g.cut, g.mass, g.box[:, : g.dims], Upper(g), g.roots[live])


class Fleet:
    """`count` series, the longest first; step() takes the next row of the first n of them."""

    def __init__(self, settings: Settings, horizon: int | None, count: int, **calibration) -> None:
        s = self.s = settings
        self.trees, self.horizon = np.arange(count * s.trees).reshape(count, s.trees), horizon
        #: samples as any one series has them: keys and counts, no points
        self.forest = OnlineForest(s.shingle, s.trees, s.size, s.decay, s.seed)
        self.grove = Grove(count * s.trees, s.size, s.shingle)
        self.value, self.spread, self.noise = Means(s.stats_decay, count), Means(0.1 * s.stats_decay, count), Means(s.stats_decay, count)
        self.primary, self.rise, self.fall = Means(s.stats_decay, count), Means(s.stats_decay, count), Means(s.stats_decay / 2, count)
        self.far = None if s.scoring == "EXPECTED_INVERSE_DEPTH" else Means(s.stats_decay, count)
        self.last, self.judged, self.quality = np.zeros(count), 0, Decayed(s.stats_decay)
        self.shingle, self.pushed, self.row = np.zeros((count, s.shingle)), 0, 0
        self.early: list[np.ndarray] | None = [] if s.transform in ("NORMALIZE", "SUBTRACT_MA") else None
        self.run = np.zeros(count, np.int64)
        self.anomaly: list[tuple | None] = [None] * count
        self.anomaly_seq, self.anomaly_want = np.full(count, -(10**9)), np.zeros(count)
        if horizon is not None:
            e = self.errors = Caster(settings, horizon, **calibration).errors
            self.past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            self.stats = [{k: Means(1.0 / e.error_horizon, count) for k in ("inside", "error", "up", "down")} for _ in range(horizon)]
            self.seen = [0] * horizon

    # preprocessing ---------------------------------------------------------------------------------------------------

    def _shift_scale(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        t = self.s.transform
        return self.value.mean(n) if t != "NONE" else np.zeros(n), np.abs(self.spread.mean(n)) + 1 if t == "NORMALIZE" else np.ones(n)

    def _transform(self, x: np.ndarray) -> np.ndarray:
        shift, scale = self._shift_scale(len(x))
        y = (x - shift) / scale
        return np.clip(y, -100, 100) if self.s.transform == "NORMALIZE" else y

    def _learn(self, x: np.ndarray) -> None:
        self.value.add(x)
        self.spread.add(self.value.dev(len(x)))

    def _push(self, y: np.ndarray) -> None:
        n, sh = len(y), self.shingle
        sh[:n, :-1] = sh[:n, 1:]
        sh[:n, -1] = y
        self.pushed += 1
        if self.pushed >= self.s.shingle:
            self._update(sh[:n])
            self.noise.add(sh[:n, -1] - sh[:n, -2] if self.s.shingle > 1 else y)

    def _update(self, x: np.ndarray) -> None:
        """OnlineForest.update() of each series; the choice of trees and places is the same for all."""
        f, n = self.forest, len(x)
        into, place, out, worst, draws = f.turn()
        if not len(into):
            return
        lanes = lambda trees: self.trees[:n, trees].ravel()
        if len(out):
            self.grove.remove_each(lanes(out), np.tile(worst, n))
        x = np.asarray(x, np.float32).astype(float)
        self.grove.insert_each(np.repeat(x, len(into), axis=0), lanes(into), np.tile(place, n), np.tile(draws[1, into], n), np.tile(draws[2, into], n))

    # the row --------------------------------------------------------------------------------------------------------

    def step(self, x: np.ndarray) -> dict:
        """Columns of the next row of the first len(x) series; `explained` has what few rows have."""
        n, s = len(x), self.s
        self.row += 1
        self.quality.add(1.0)
        out = {"score": np.zeros(n), "threshold": np.zeros(n), "grade": np.zeros(n), "confidence": 0.0, "explained": {}}
        if self.early is not None:
            self.early.append(x)
            self._learn(x)
            if len(self.early) >= s.start:
                rows, self.early = self.early, None
                for early in rows:
                    self._push(self._transform(early[:n]))
        else:
            y = self._transform(x)
            if self.pushed >= s.shingle - 1 and self.forest.ready:
                self._judge(np.concatenate([self.shingle[:n, 1:], y[:, None]], axis=1), y, x, out)
            self._push(y)
            self._learn(x)
        if self.horizon is not None:
            self._forecast(x, out)
        return out

    def _judge(self, full: np.ndarray, y: np.ndarray, x: np.ndarray, out: dict) -> None:
        n = len(x)
        full = full.astype(np.float32).astype(float)
        if self.far is None:
            score = self.grove.scores(full, self.trees[:n])
        else:
            score, distance = self.grove.scores_distances(full, self.trees[:n])
        out["score"], out["confidence"] = score, Detector._confidence(self)
        out["threshold"], out["grade"] = self._grade(score)
        learn, modes = score.copy(), np.zeros(n, bool)
        if self.far is not None:
            self._second(distance, out, modes)
        graded = np.flatnonzero(out["grade"] > 0)
        high, low = self.grove.attributions(full[graded], self.trees[graded])
        want, again = self._expected(full[graded], graded), self._replaced(full[graded], graded)
        for j, k in enumerate(graded):
            r = Result(self.row, 0, float(score[k]), float(out["threshold"][k]), float(out["grade"][k]))
            learn[k] = self._explain(k, full[k], y[k : k + 1], x[k : k + 1], Own(self.grove, self.trees[k], (high[j : j + 1], low[j : j + 1]), want[j], again[j]), r)
            out["grade"][k], modes[k] = r.grade, r.mode != "NONE"
            out["explained"][int(k)] = r
        self.run[:n] = np.where((out["grade"] > 0) | (modes & (self.run[:n] > 0)), self.run[:n] + 1, np.where(modes, self.run[:n], 0))
        c = np.minimum(np.minimum(learn, score), 2.0)
        m = self.primary.mean(n)
        falls = np.flatnonzero(m > c)
        self.fall.add((m - c)[falls], falls)
        self.rise.add(c - self.last[:n])
        self.primary.add(c)
        self.last[:n] = c
        if self.far is not None:
            self.far.add(np.minimum(distance, 2.0))
        self.judged += 1

    def _second(self, distance: np.ndarray, out: dict, modes: np.ndarray) -> None:
        """What distances say of grades, by the rule of Threshold.primary_grade()."""
        s, n = self.s, len(distance)
        if self.judged < 10:
            th, g = np.zeros(n), np.zeros(n)
        else:
            m, d = self.far.mean(n), self.far.dev(n)
            th = np.where(distance > 0, m + s.z * d, 0.0)
            rise = np.maximum(0.0, (np.minimum(2 * s.z, (distance - m) / np.where(d > 0, d, 1.0)) - s.z) / s.z)
            g = np.where((th > 0) & (distance > th), np.where(d > 0, rise, distance > m + 1e-10), 0.0)
        if s.scoring == "MULTI_MODE":
            modes |= (out["grade"] > 0) & (th > 0) & (g == 0)
            out["grade"][modes] = 0.0
            for k in np.flatnonzero(modes):
                out["explained"][int(k)] = Result(self.row, 0, mode="MULTI_MODE")
        else:
            more = (out["grade"] == 0) & (g > 0) & (self.row - self.anomaly_seq[:n] >= s.shingle)
            out["grade"] = np.where(more, g, out["grade"])

    def _grade(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Threshold.grade()."""
        s, n, of = self.s, self.judged, len(score)
        m, d = self.primary.mean(of), self.primary.dev(of)
        f = 0.0 if n < 10 else 1.0 if n > 20 else (n - 10) / 10
        z = np.maximum(np.where(m < 0.9, m * s.z / 0.9, s.z) if s.transform != "NONE" else np.full(of, s.z), 2.0)
        falls, rise = math.sqrt(2) * self.fall.dev(of), self.rise.dev(of)
        long = np.minimum(falls, d) if s.shingle == 1 else 0.5 * np.minimum(d, np.maximum(rise, falls)) + 0.5 * rise
        spread = (z - 1) * long + d
        absolute = np.where(m < 0.9, m * 0.8 / 0.9, 0.8) if f >= 1 else np.full(of, 0.8)
        th = np.maximum(1.5, absolute) if n < 10 else np.maximum(absolute, f * (m + spread) + (1 - f) * 1.5)
        if n >= 10:
            some = spread > 0
            t = np.maximum(0.0, np.where(some, np.minimum(z, (score - th) / (np.where(some, spread, 1.0) / z)) / z, 2.0))
        else:
            t = np.minimum(1.0, np.maximum(0.0, (score - 0.8) / 0.8))
        g = np.minimum(1.0, np.floor(t * 20 + 1e-9) / 16)
        low = (score < th) | (th <= 0)
        return np.where(low | (g != 0), th, score), np.where(low, 0.0, g)

    def _expected(self, full: np.ndarray, at: np.ndarray) -> list[float]:
        """The newest value of each of these rows as Forest.impute() gives it."""
        nodes, gone = _nodes(self.grove, self.trees[at]), np.zeros(full.shape, bool)
        gone[:, -1] = True
        leaf, dist = nodes.complete(np.where(gone, 0.0, full), gone, roots=self.grove.roots[self.trees[at]])
        return completed(nodes.low[leaf, -1:], dist)["value"][:, 0].tolist() if len(at) else []

    def _replaced(self, full: np.ndarray, at: np.ndarray) -> list[float]:
        """Scores of windows in which the last anomaly is as it was expected; 0 where there is none."""
        k, gap, out = self.s.shingle, self.row - self.anomaly_seq[at], np.zeros(len(at))
        odd = np.flatnonzero(gap < k)
        if len(odd):
            full = full[odd]
            full[np.arange(len(odd)), k - 1 - gap[odd]] = self.anomaly_want[at[odd]]
            out[odd] = self.grove.scores(full.astype(np.float32).astype(float), self.trees[at[odd]])
        return out.tolist()

    def _explain(self, k: int, full: np.ndarray, y: np.ndarray, x: np.ndarray, own: Own, out: Result) -> float:
        """Detector._explain() on a detector that has the statistics and the trees of series k."""
        s = self.s
        m = Detector.__new__(Detector)
        m.s, m.block, m.seq, m.run, m.last_anomaly, m.last_x, m.diff = s, 1, self.row, int(self.run[k]), self.anomaly[k], None, []
        m.value, m.spread, m.noise = [self.value.one(k)], [self.spread.one(k)], [self.noise.one(k)]
        m.threshold = Threshold(s.stats_decay, s.z, s.shingle, s.transform)
        m.threshold.primary, m.threshold.step, m.threshold.fall, m.threshold.n = self.primary.one(k), self.rise.one(k), self.fall.one(k), self.judged
        m.forest = own
        learn = m._explain(own, full, y, x, out)
        if m.last_anomaly is not self.anomaly[k]:
            self.anomaly[k] = m.last_anomaly
            self.anomaly_seq[k], self.anomaly_want[k] = m.last_anomaly[0], m.last_anomaly[3][0]
        return learn

    # forecasts ------------------------------------------------------------------------------------------------------

    def _forecast(self, x: np.ndarray, out: dict) -> None:
        n, s, e = len(x), self.s, self.errors
        for h, (value, upper, lower) in enumerate(reversed(self.past)):
            st, miss = self.stats[h], x - value[:n, h]
            above, below = np.maximum(miss, 0.0), np.minimum(miss, 0.0)
            st["inside"].add(((lower[:n, h] <= x) & (x <= upper[:n, h])).astype(float))
            st["error"].add(miss)
            st["up"].add(above * above)
            st["down"].add(below * below)
            self.seen[h] += 1
        e.n += 1
        if not self.forest.ready or self.pushed < s.shingle:
            return
        window, gap = self.shingle[:n].copy(), self.row - self.anomaly_seq[:n]
        odd = np.flatnonzero(gap < s.shingle)
        window[odd, s.shingle - 1 - gap[odd]] = self.anomaly_want[odd]
        raw = _nodes(self.grove, self.trees[:n]).extrapolate(window, self.grove.roots[self.trees[:n]], 1, self.horizon)
        shift, scale = (v[:, None] for v in self._shift_scale(n))
        value, upper, lower = (raw[k][:, :, 0] * scale + shift for k in ("value", "upper", "lower"))
        spread, share = self.value.dev(n), min(1.0, max(0.0, e.n / (10 * e.error_horizon) - 1))
        for h, st in enumerate(self.stats):
            if e.calibration == "NONE":
                break
            up = share * np.sqrt(st["up"].mean(n)) + (1 - share) * spread
            down = share * -np.sqrt(st["down"].mean(n)) - (1 - share) * spread
            mean, p = share * st["error"].mean(n), st["inside"].mean(n)
            widen = np.where(p < 1 - e.percentile, np.maximum(1.0, 1 / (p + 0.1)), 1.0) if self.seen[h] else 1.0
            if e.calibration == "SIMPLE":
                value[:, h] += mean
            upper[:, h] = np.maximum(upper[:, h], value[:, h] + mean + 1.3 * up * widen)
            lower[:, h] = np.minimum(lower[:, h], value[:, h] + mean + 1.3 * down * widen)
        least, top = e.limits
        value, upper, lower = (np.clip(v, -math.inf if least is None else least, math.inf if top is None else top) for v in (value, upper, lower))
        self.past = [*self.past, (value, upper, lower)][-self.horizon :]
        inside = [st["inside"].mean(n) for st, seen in zip(self.stats, self.seen, strict=True) if seen]
        out |= {"forecast": value, "upper": upper, "lower": lower, "precision": np.stack(inside, axis=1).mean(1) if inside else np.zeros(n)}


def process(settings: Settings, horizon: int | None, series: list[np.ndarray], **calibration) -> dict:
    """Columns of all rows of the series (numbers in order), one series after the other.

    forecast, upper, lower: (rows, horizon), meant where `has`; explained: the results of graded rows by place.
    """
    length = np.array([len(v) for v in series])
    first, total = np.cumsum(length) - length, int(length.sum())
    out = {k: np.zeros(total) for k in ("score", "threshold", "grade", "confidence")} | {"explained": {}, "has": np.zeros(total, bool)}
    wide = horizon or 0
    out |= {k: np.zeros((total, wide)) for k in ("forecast", "upper", "lower")} | {"precision": np.zeros(total)}
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), at_once := most(settings)):
        some = order[a : a + at_once]
        fleet, left = Fleet(settings, horizon, len(some), **calibration), length[some]
        for i in range(int(left[0])):
            n = int(np.searchsorted(-left, -i, "left"))  # series with more than i rows
            at = first[some[:n]] + i
            got = fleet.step(np.array([series[k][i] for k in some[:n]], float))
            for k in ("score", "threshold", "grade", "confidence"):
                out[k][at] = got[k]
            for k, r in got["explained"].items():
                out["explained"][int(at[k])] = r
            if "forecast" in got:
                out["has"][at] = True
                for k in ("forecast", "upper", "lower", "precision"):
                    out[k][at] = got[k]
    return out
