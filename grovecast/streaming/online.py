"""Sequential models of one series, in plain numpy: forest, thresholds, detector, caster. No Spark in here.

The same classes serve batch (grouped maps) and streams (state); all randomness is counter-based, so replaying rows
gives the same output. Trees follow their samples by single insertions and deletions (streaming.grove).
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np

from ..functions.rng import uniform_np
from ..operators.forest_kernel import Forest
from .grove import Grove, LiveForest


class Decayed:
    """Discounted mean and deviation."""

    __slots__ = ("decay", "w", "s", "q", "n")

    def __init__(self, decay: float) -> None:
        self.decay, self.w, self.s, self.q, self.n = decay, 0.0, 0.0, 0.0, 0

    def add(self, x: float) -> None:
        keep = 1.0 - self.decay
        self.w, self.s, self.q, self.n = self.w * keep + 1.0, self.s * keep + x, self.q * keep + x * x, self.n + 1

    @property
    def mean(self) -> float:
        return self.s / self.w if self.w > 0 else 0.0

    @property
    def dev(self) -> float:
        m = self.mean
        return math.sqrt(max(0.0, self.q / self.w - m * m)) if self.w > 0 else 0.0


class OnlineForest:
    """Samples of decayed keys for each tree, and trees that follow them point by point."""

    def __init__(self, dims: int, trees: int = 30, size: int = 64, decay: float | None = None, seed: int = 42, output_after: int | None = None, initial_accept: float = 1.0) -> None:
        if dims < 1 or trees < 1 or size < 1:
            raise ValueError("dims, trees and size must be positive")
        self.dims, self.size, self.seed, self.initial = dims, size, seed, initial_accept
        self.decay = 1.0 / (10 * size) if decay is None else decay
        self.after = max(1, size // 4) if output_after is None else output_after
        self._points, self._seqs = np.zeros((trees, size, dims)), np.zeros((trees, size), np.int64)
        self._keys, self._have = np.full((trees, size), -np.inf), np.zeros(trees, np.int64)
        self.grove = Grove(trees, size, dims)
        self.drawn = (0, None)
        self.updates, self.sampling, self.elapsed = 0, True, 0.0

    def set_decay(self, decay: float) -> None:
        """A new rate from here on; keys stay on one clock because the past is summed."""
        self.decay = decay

    @property
    def ready(self) -> bool:
        return self.updates >= self.after

    @property
    def keys(self) -> list[np.ndarray]:
        return [k[:n] for k, n in zip(self._keys, self._have, strict=True)]

    @property
    def points(self) -> list[np.ndarray]:
        return [p[:n] for p, n in zip(self._points, self._have, strict=True)]

    @property
    def seqs(self) -> list[np.ndarray]:
        return [s[:n] for s, n in zip(self._seqs, self._have, strict=True)]

    def _draws(self, seq: int) -> np.ndarray:
        """A row's draws (key, depth, cut; trees), made for a block of rows at once."""
        start, block = self.drawn
        if block is None or not start <= seq < start + 32:
            start = seq - seq % 32
            rows, kind = np.arange(start, start + 32)[:, None, None], np.array([1, 7, 8])[:, None]
            self.drawn = start, (block := uniform_np(rows, np.arange(len(self._have)), kind, self.seed))
        return block[seq - start]

    def turn(self, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Moves on by a row: (trees that take it, its places there, trees that give up a point, the places of these, draws)."""
        seq, none = self.updates, np.zeros(0, np.int64)
        self.updates += 1
        self.elapsed += self.decay
        if not self.sampling or weight <= 0:
            return none, none, none, none, none
        ids = np.arange(len(self._have))
        draws = self._draws(seq)
        key = -self.elapsed + np.log(-np.log(draws[0]) / weight)
        full = self._have >= self.size
        worst = self._keys.argmax(1)
        take = np.where(full, key < self._keys[ids, worst], True)
        if self.initial < 1:
            coin, share = uniform_np(seq, ids, 6, self.seed), self._have / self.size
            take &= full | (share < self.initial) | (coin < 1 - (share - self.initial) / (1 - self.initial))
        into = np.flatnonzero(take)
        out, place = into[full[into]], np.where(full, worst, self._have)[into]
        self._keys[into, place], self._seqs[into, place] = key[into], seq
        self._have[into[~full[into]]] += 1
        return into, place, out, worst[out], draws

    def update(self, x: np.ndarray, weight: float = 1.0) -> None:
        into, place, out, worst, draws = self.turn(weight)
        if not len(into):
            return
        x = np.asarray(x, np.float32).astype(float)
        if len(out):
            self.grove.remove(out, worst)
        self._points[into, place] = x
        self.grove.insert(x, into, place, draws[1, into], draws[2, into])

    def forest(self) -> LiveForest | None:
        """Queries of the forest as it is until the next update."""
        live = np.flatnonzero(self._have)
        if not len(live):
            return None
        return LiveForest(self.grove, live, [self._points[t, : self._have[t]] for t in live], [self._seqs[t, : self._have[t]] for t in live])

    def score(self, x: np.ndarray) -> float:
        """0 until ready."""
        return self.grove.score(np.asarray(x, np.float32).astype(float)) if self.ready else 0.0

    def hold(self, keys: list[np.ndarray], points: list[np.ndarray], seqs: list[np.ndarray]) -> None:
        """Samples given as a whole, one for each tree; trees are grown from them point by point."""
        if len(keys) != len(self._have) or max(map(len, keys)) > self.size:
            raise ValueError("one sample for each tree, none beyond the size")
        self.grove = Grove(len(keys), self.size, self.dims)
        for t, (k, p, s) in enumerate(zip(keys, points, seqs, strict=True)):
            n = self._have[t] = len(k)
            self._keys[t], self._seqs[t], self._points[t] = -np.inf, 0, 0.0
            if n:
                self._keys[t, :n], self._seqs[t, :n], self._points[t, :n] = k, s, np.asarray(p, np.float32)
        for place in range(int(self._have.max())):
            into = np.flatnonzero(self._have > place)
            depth, cut = (uniform_np(place, into, kind, self.seed) for kind in (9, 10))
            for t, d, c in zip(into, depth, cut, strict=True):  # each tree has a point of its own here
                self.grove.insert(self._points[t, place], np.array([t]), np.array([place]), np.array([d]), np.array([c]))

    def merge(self, other: OnlineForest) -> None:
        """The union's least keys; both clocks are brought to the later one. Trees are grown anew from what stays."""
        gap = other.elapsed - self.elapsed
        held = []
        for t, (mine, theirs) in enumerate(zip(self.keys, other.keys, strict=True)):
            keys = np.concatenate([mine - max(0.0, gap), theirs - max(0.0, -gap)])
            by = np.argsort(keys, kind="stable")[: self.size]
            held.append((keys[by], np.concatenate([self.points[t], other.points[t]])[by], np.concatenate([self.seqs[t], other.seqs[t]])[by]))
        self.hold(*(list(v) for v in zip(*held, strict=True)))
        self.updates += other.updates
        self.elapsed = max(self.elapsed, other.elapsed)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_points": self._points.astype(np.float32), "drawn": (0, None)}  # points are of single precision

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._points = state["_points"].astype(float)
        self.grove.refill(self._points)


class Threshold:
    """Adaptive threshold over scores; the fixed numbers are those of operators.thresholds."""

    def __init__(self, decay: float = 0.01, z: float = 3.0, shingle: int = 1, transform: str = "NORMALIZE", auto: bool = True) -> None:
        self.z, self.shingle, self.transform, self.auto = z, shingle, transform, auto
        self.primary, self.step, self.fall = Decayed(decay), Decayed(decay), Decayed(decay / 2)
        self.last, self.n = 0.0, 0

    def grade(self, score: float) -> tuple[float, float]:
        """(threshold, grade) of a score, before it is added."""
        n, m, d = self.n, self.primary.mean, self.primary.dev
        f = 0.0 if n < 10 else 1.0 if n > 20 else (n - 10) / 10
        z = max(m * self.z / 0.9 if m < 0.9 and self.transform != "NONE" else self.z, 2.0)
        falls = math.sqrt(2) * self.fall.dev
        if self.shingle == 1 and self.transform not in ("DIFFERENCE", "NORMALIZE_DIFFERENCE"):
            long = min(falls, d)
        else:
            long = 0.5 * min(d, max(self.step.dev, falls)) + 0.5 * self.step.dev
        spread = (z - 1) * long + d
        absolute = m * 0.8 / 0.9 if self.auto and f >= 1 and m < 0.9 else 0.8
        th = max(1.5, absolute) if n < 10 else max(absolute, f * (m + spread) + (1 - f) * 1.5)
        if score < th or th <= 0:
            return th, 0.0
        if n >= 10:
            t = max(0.0, min(z, (score - th) / (spread / z)) / z if spread > 0 else 2.0)
        else:
            t = min(1.0, max(0.0, (score - 0.8) / 0.8))
        g = min(1.0, math.floor(t * 20 + 1e-9) / 16)
        return (score, 0.0) if g == 0 else (th, g)

    def add(self, score: float) -> None:
        s = min(score, 2.0)
        if self.primary.mean > s:
            self.fall.add(self.primary.mean - s)
        self.step.add(s - self.last)
        self.primary.add(s)
        self.last, self.n = s, self.n + 1

    def primary_grade(self, score: float) -> tuple[float, float]:
        if self.n < 10 or score <= 0:
            return 0.0, 0.0
        m, d = self.primary.mean, self.primary.dev
        th = m + self.z * d
        if not (th > 0 and score > th):
            return th, 0.0
        return th, max(0.0, (min(2 * self.z, (score - m) / d) - self.z) / self.z) if d > 0 else float(score > m + 1e-10)


@dataclass
class Settings:
    """Detector options with their checks."""

    inputs: int = 1
    shingle: int = 4
    trees: int = 20
    size: int = 64
    decay: float | None = None
    stats_decay: float = 0.01
    z: float = 3.0
    transform: str = "NORMALIZE"
    mode: str = "STANDARD"
    imputation: str = "PREVIOUS"
    fixed: float = 0.0
    scoring: str = "EXPECTED_INVERSE_DEPTH"
    alert_once: bool = False
    auto_adjust: bool = False
    ignore_above: float = 0.0
    ignore_below: float = 0.0
    ignore_ratio: float = 0.0
    noise_factor: float = 1.0
    start: int = 10
    impute_fraction: float = 0.5
    weight_time: float = 1.0
    seed: int = 42
    weights: list[float] | None = None

    def __post_init__(self) -> None:
        if self.inputs < 1 or self.shingle < 1:
            raise ValueError("inputs and shingle must be positive")
        for name, allowed in (
            ("transform", ("NONE", "WEIGHTED", "SUBTRACT_MA", "NORMALIZE", "DIFFERENCE", "NORMALIZE_DIFFERENCE")),
            ("mode", ("STANDARD", "TIME_AUGMENTED", "STREAMING_IMPUTE")),
            ("imputation", ("ZERO", "FIXED_VALUES", "PREVIOUS", "NEXT", "LINEAR", "FOREST")),
            ("scoring", ("EXPECTED_INVERSE_DEPTH", "DISTANCE", "MULTI_MODE", "MULTI_MODE_RECALL")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if self.weights is not None and (len(self.weights) != self.inputs or min(self.weights) < 0):
            raise ValueError("one weight for each input, none negative")
        if self.transform == "NONE" and self.weights is not None and any(w != 1 for w in self.weights):
            raise ValueError("NONE takes weights of 1 only")
        if self.mode == "STREAMING_IMPUTE" and self.shingle < 2:
            raise ValueError("imputing needs a shingle of 2 at least")


@dataclass
class Result:
    seq: int
    t: int
    score: float = 0.0
    threshold: float = 0.0
    grade: float = 0.0
    confidence: float = 0.0
    relative_index: int = 0
    mode: str = "NONE"
    expected: list[float] | None = None
    attribution_high: list[float] | None = None
    attribution_low: list[float] | None = None
    late: bool = False
    forecast: list[float] | None = None
    upper: list[float] | None = None
    lower: list[float] | None = None
    precision: float | None = None
    imputed: int = 0


class Detector:
    """One series: preprocess, score, grade, explain, then learn from each row."""

    def __init__(self, settings: Settings) -> None:
        s = self.s = settings
        self.block = s.inputs + (s.mode == "TIME_AUGMENTED")
        self.forest = OnlineForest(self.block * s.shingle, s.trees, s.size, s.decay, s.seed)
        self.value = [Decayed(s.stats_decay) for _ in range(s.inputs)]
        self.diff = [Decayed(s.stats_decay) for _ in range(s.inputs)]
        self.spread = [Decayed(0.1 * s.stats_decay) for _ in range(s.inputs)]
        self.gap, self.quality = Decayed(s.stats_decay), Decayed(s.stats_decay)
        self.threshold = Threshold(s.stats_decay, s.z, s.shingle, s.transform)
        self.far = Threshold(s.stats_decay, s.z, s.shingle, s.transform)
        self.noise = [Decayed(s.stats_decay) for _ in range(self.block)]
        self.shingle = np.zeros(0)
        self.fake = np.zeros(0, bool)
        self.last_t: int | None = None
        self.last_x: np.ndarray | None = None
        self.early: list[tuple[float, np.ndarray]] = []
        self.seq = self.run = 0
        self.last_anomaly: tuple[int, float, float, np.ndarray, np.ndarray] | None = None
        self.last_score = 0.0

    # preprocessing ---------------------------------------------------------------------------------------------------

    def _shift_scale(self) -> tuple[np.ndarray, np.ndarray]:
        s, n = self.s, self.s.inputs
        shift, scale = np.zeros(n), np.ones(n)
        if s.transform in ("SUBTRACT_MA", "NORMALIZE"):
            shift = np.array([v.mean for v in self.value])
        if s.transform == "NORMALIZE":
            scale = np.array([abs(v.mean) + 1 for v in self.spread])
        if s.transform == "NORMALIZE_DIFFERENCE":
            shift, scale = np.array([v.mean for v in self.diff]), np.array([v.dev + 1 for v in self.diff])
        return shift, scale

    def _transform(self, x: np.ndarray, gap: float) -> np.ndarray:
        s = self.s
        value = x
        if s.transform in ("DIFFERENCE", "NORMALIZE_DIFFERENCE"):
            value = x - self.last_x if self.last_x is not None else np.zeros_like(x)
        shift, scale = self._shift_scale()
        y = (value - shift) / scale
        if s.transform in ("NORMALIZE", "NORMALIZE_DIFFERENCE"):
            y = np.clip(y, -100, 100)
        y = y * (np.array(s.weights) if s.weights else 1.0)
        if s.mode == "TIME_AUGMENTED":
            y = np.append(y, s.weight_time * (min(100.0, max(-100.0, (gap - self.gap.mean) / (2 * (self.gap.dev + 1e-3)))) if self.gap.n else 0.0))
        return y

    def _invert(self, y: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """One block back to the units of the input."""
        s = self.s
        shift, scale = self._shift_scale()
        w = np.array(s.weights) if s.weights else np.ones(s.inputs)
        out = y[: s.inputs] / np.where(w > 0, w, 1.0) * scale + shift
        if s.transform in ("DIFFERENCE", "NORMALIZE_DIFFERENCE"):
            out = out + (base if base is not None else self.last_x if self.last_x is not None else 0.0)
        return out

    def _learn_statistics(self, x: np.ndarray, missing: np.ndarray) -> None:
        for i in range(self.s.inputs):
            if not missing[i]:
                self.value[i].add(float(x[i]))
                self.spread[i].add(self.value[i].dev)
            self.diff[i].add(0.0 if self.last_x is None else float(x[i] - self.last_x[i]))

    def _fill(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        if not missing.any():
            return x
        s = self.s
        if s.imputation == "FIXED_VALUES":
            fill = np.full(s.inputs, s.fixed)
        elif s.imputation == "ZERO":
            fill = np.zeros(s.inputs)
        else:
            fill = self.last_x if self.last_x is not None else np.zeros(s.inputs)
        if s.imputation == "FOREST" and self.forest.ready and len(self.shingle) == self.forest.dims:
            y = np.concatenate([self.shingle[self.block :], self._transform(np.where(missing, fill, x), 0.0)])
            idx = len(y) - self.block + np.flatnonzero(missing)
            done = self.forest.forest().impute(y, idx)
            fill = self._invert(done[-self.block :])
        return np.where(missing, fill, x)

    def _push(self, y: np.ndarray, fake: bool) -> None:
        most = self.block * self.s.shingle
        self.shingle = np.concatenate([self.shingle, y])[-most:]
        self.fake = np.append(self.fake, fake)[-self.s.shingle :]
        if len(self.shingle) == most and self.fake.mean() < self.s.impute_fraction:
            self.forest.update(self.shingle)
            for i, d in enumerate(self.noise):
                d.add(float(self.shingle[-self.block + i] - self.shingle[-2 * self.block + i]) if self.s.shingle > 1 else float(y[i]))

    # the row --------------------------------------------------------------------------------------------------------

    def process(self, t: int, x, seq: int | None = None) -> Result:
        x = np.atleast_1d(np.asarray(x, float))
        if len(x) != self.s.inputs:
            raise ValueError(f"expected {self.s.inputs} inputs")
        self.seq = self.seq + 1 if seq is None else seq
        if self.last_t is not None and t < self.last_t:
            return Result(self.seq, t, late=True)  # a side output; the model is left alone
        missing = np.isnan(x)
        gap = (t - self.last_t) / 1e6 if self.last_t is not None else 0.0
        out = Result(self.seq, t)
        self.quality.add(1 - missing.mean())
        if self.s.mode == "STREAMING_IMPUTE" and self.last_x is not None and self.gap.n > 1:
            out.imputed = self._impute_gap(gap, np.where(missing, self.last_x, x))
        x = self._fill(x, missing)
        needs_start = self.s.transform in ("NORMALIZE", "SUBTRACT_MA") or self.s.mode != "STANDARD"
        if needs_start and self.early is not None:
            # the first rows only teach the statistics; then they are replayed with what they taught
            self.early.append((gap, x))
            self._learn_statistics(x, missing)
            self._move(t, x, gap)
            if len(self.early) >= self.s.start:
                rows, self.early = self.early, None
                before = None
                for early_gap, xx in rows:
                    self.last_x, keep = before, self.last_x
                    y = self._transform(xx, early_gap)
                    self.last_x = keep
                    self._push(y, False)
                    before = xx
            return out
        y = self._transform(x, gap)
        full = np.concatenate([self.shingle, y])[-self.block * self.s.shingle :]
        if len(full) == self.forest.dims and self.forest.ready:
            self._judge(full, y, x, out)
        self._push(y, bool(missing.any()))
        self._learn_statistics(x, missing)
        self._move(t, x, gap)
        return out

    def _move(self, t: int, x: np.ndarray, gap: float) -> None:
        if self.last_t is not None:
            self.gap.add(gap)
        self.last_t, self.last_x = t, x

    def _impute_gap(self, gap: float, x: np.ndarray) -> int:
        mean, dev = self.gap.mean, self.gap.dev
        usual = mean - dev * dev / (2 * mean) if 0 < dev < mean / 2 else mean
        if usual <= 0 or gap / usual < 1.5 or self.early is not None:
            return 0
        n = min(math.ceil(gap / usual) - 1, 3 * self.s.shingle)
        if n >= 3 * self.s.shingle:  # nothing of the old window is left: move on with typical values
            n = self.s.shingle - 1
        a = self.last_x
        for k in range(1, n + 1):
            s = self.s
            v = {"ZERO": 0 * x, "FIXED_VALUES": 0 * x + s.fixed, "NEXT": x, "LINEAR": a + (x - a) * k / (n + 1)}.get(s.imputation, a)
            if s.imputation == "FOREST" and self.forest.ready and len(self.shingle) == self.forest.dims:
                y = np.concatenate([self.shingle[self.block :], np.zeros(self.block)])
                y = self.forest.forest().impute(y, np.arange(len(y) - self.block, len(y)))[-self.block :]
            else:
                y = self._transform(v, usual)
            self._push(y, True)
        return n

    def _confidence(self) -> float:
        total = self.forest.decay * self.forest.updates
        q = self.quality.mean
        if total == 0:
            return 0.0
        if total >= 20:
            return min(1.0, q)
        return q * (math.exp(total) - math.exp(self.forest.decay * min(self.forest.updates, self.forest.after))) / (math.exp(total) - 1)

    def _judge(self, full: np.ndarray, y: np.ndarray, x: np.ndarray, out: Result) -> None:
        s = self.s
        full = full.astype(np.float32).astype(float)  # as the sample keeps points
        out.score = self.forest.score(full)
        out.confidence = self._confidence()
        out.threshold, out.grade = self.threshold.grade(out.score)
        distance = 0.0
        if s.scoring != "EXPECTED_INVERSE_DEPTH":
            d = self.forest.forest().density(full)["distance"]
            distance = float(d.sum())
            th, g = self.far.primary_grade(distance)
            if s.scoring == "DISTANCE":
                out.score, out.threshold, out.grade = distance, th, g
            elif s.scoring == "MULTI_MODE" and out.grade > 0 and th > 0 and g == 0:
                out.grade, out.mode = 0.0, "MULTI_MODE"
            elif s.scoring == "MULTI_MODE_RECALL" and out.grade == 0 and g > 0 and (self.last_anomaly is None or self.seq - self.last_anomaly[0] >= s.shingle):
                out.grade = g
        learn = out.score
        if out.grade > 0:
            learn = self._explain(self.forest.forest(), full, y, x, out)
        if out.grade > 0:
            self.run += 1
        elif out.mode == "NONE":
            self.run = 0
        elif self.run:
            self.run += 1
        self.threshold.add(min(learn, out.score) if s.scoring != "DISTANCE" else learn)
        if s.scoring != "EXPECTED_INVERSE_DEPTH":
            self.far.add(distance)
        self.last_score = out.score if s.shingle > 1 else 0.0

    def _explain(self, f: LiveForest, full: np.ndarray, y: np.ndarray, x: np.ndarray, out: Result) -> float:
        """Rules that may take the grade back; the first that does names the mode. Returns the score to learn from."""
        s, b, k = self.s, self.block, self.s.shingle
        learn = out.score
        high, low = (v[0] for v in f.attribution(full))
        gap = self.seq - self.last_anomaly[0] if self.last_anomaly else 10**9
        if gap < k and out.grade > 0:
            # an earlier anomaly is still in the window: score the window with its block as it was expected
            fixed = full.copy()
            at = len(full) - (gap + 1) * b
            if at >= 0:
                fixed[at : at + b] = self.last_anomaly[3]
                again = self.forest.score(fixed)
                learn = again
                _, g = self.threshold.grade(again)
                if g == 0:
                    out.grade, out.mode = 0.0, "ANOMALY_IN_SHINGLE"
                    return learn
                residual = float((high + low)[-b * gap :].sum()) if gap else out.score
                if not (residual > 0.3 * self.last_anomaly[1] and residual * k / max(gap, 1) > 1.2 * out.threshold):
                    out.grade, out.mode = 0.0, "ANOMALY_IN_SHINGLE"
                    return learn
        blocks = (high + low).reshape(k, b).sum(1)
        out.relative_index = int(blocks.argmax()) - (k - 1)
        newest = slice(len(full) - b, len(full))
        share = (high + low)[newest]
        picks = [i for i in np.argsort(-share) if share[i] >= 0.1 * share.sum()][: min(5, max(1, b if b == 1 else b // 2))]
        want = f.impute(full, [newest.start + int(i) for i in picks])[newest]
        expected = self._invert(want)
        out.expected = [float(v) for v in expected]
        move = y - want
        noise = np.array([s.noise_factor * d.dev for d in self.noise])
        if out.relative_index == 0 and (np.abs(move[: s.inputs]) <= 0.5 * noise[: s.inputs]).all():
            out.grade, out.mode = 0.0, "NOISE"
            return learn
        if s.auto_adjust:
            if f.near(full, 1.1 * float(np.sqrt((move**2).sum()))) >= 0.1 * len(f.live) * k:
                out.grade, out.mode = 0.0, "CONDITIONAL_FORECAST"
                return learn
        rise = x - expected
        band = np.maximum(np.where(rise > 0, s.ignore_above, s.ignore_below), s.ignore_ratio * np.abs(expected))
        if (band > 0).any() and (np.abs(rise) <= band).all():
            out.grade, out.mode = 0.0, "FORECAST"
            return learn
        if s.auto_adjust and self.run > 2 and self.last_anomaly is not None and np.allclose(y, self.last_anomaly[4], atol=float(noise.max()) + 1e-9):
            out.grade, out.mode = 0.0, "DATA_DRIFT"
            return learn
        if s.alert_once and self.run > 0 and gap < k:
            out.grade, out.mode = 0.0, "ALERT_ONCE"
            return learn
        fix = out.score / max(float((high + low).sum()), 1e-12)
        out.attribution_high, out.attribution_low = [float(v) for v in high * fix], [float(v) for v in low * fix]
        self.last_anomaly = (self.seq, out.score, out.threshold, want, y)
        return learn

    # forecasts ------------------------------------------------------------------------------------------------------

    def extrapolate(self, horizon: int, correct: bool = True, centrality: float = 1.0) -> dict[str, np.ndarray] | None:
        """value, lower, upper (horizon, inputs) and t, in units of the input; None until the model is ready."""
        if not self.forest.ready or len(self.shingle) != self.forest.dims:
            return None
        b, window = self.block, self.shingle.copy()
        if correct and self.last_anomaly and (gap := self.seq - self.last_anomaly[0]) < self.s.shingle:
            at = len(window) - (gap + 1) * b
            window[at : at + b] = self.last_anomaly[3]
        raw = self.forest.forest().extrapolate(window, b, horizon, centrality=centrality)
        out = {k: np.zeros((horizon, self.s.inputs)) for k in raw}
        bases = {k: self.last_x for k in raw}
        for h in range(horizon):
            for k in raw:
                out[k][h] = self._invert(raw[k][h], bases[k] if k == "value" else bases["value"])
            bases["value"] = out["value"][h]
        step = self.gap.mean * 1e6
        out["t"] = np.array([int(self.last_t + step * (h + 1)) for h in range(horizon)])
        return out


class ErrorHandler:
    """Accuracy of past forecasts, and intervals calibrated by it."""

    def __init__(self, horizon: int, error_horizon: int = 50, percentile: float = 0.1, calibration: str = "SIMPLE", low: float | None = None, high: float | None = None, estimator: bool = False) -> None:
        if calibration not in ("NONE", "MINIMAL", "SIMPLE"):
            raise ValueError(f"unknown calibration {calibration}")
        self.percentile, self.calibration, self.limits = percentile, calibration, (low, high)
        #: for each step ahead and each input, made when the first row shows how many inputs there are
        self.stats: list[list[dict[str, Decayed]]] = []
        self.past: list[dict[str, np.ndarray]] = []
        self.horizon, self.error_horizon, self.n = horizon, error_horizon, 0
        #: optionally a forest over (last two inputs, h, horizon - h, error above, error below) says what to expect here
        self.forest = OnlineForest(6, 20, 128) if estimator else None
        self.recent = (np.zeros(1), np.zeros(1))

    def observe(self, x: np.ndarray) -> None:
        x = np.atleast_1d(np.asarray(x, float))
        if not self.stats:
            self.stats = [[{k: Decayed(1.0 / self.error_horizon) for k in ("inside", "error", "up", "down")} for _ in x] for _ in range(self.horizon)]
            self.recent = (np.zeros(len(x)), np.zeros(len(x)))
        for h, f in enumerate(reversed(self.past[-self.horizon :])):
            for i, st in enumerate(self.stats[h]):
                e = float(x[i] - f["value"][h][i])
                st["inside"].add(float(f["lower"][h][i] <= x[i] <= f["upper"][h][i]))
                st["error"].add(e)
                st["up"].add(max(e, 0.0) * max(e, 0.0))
                st["down"].add(min(e, 0.0) * min(e, 0.0))
                if self.forest is not None:
                    self.forest.update([f["recent"][0][i], f["recent"][1][i], h, self.horizon - h, max(e, 0.0), min(e, 0.0)])
        self.recent = (self.recent[1], x)
        self.n += 1

    def precision(self) -> float:
        seen = [s["inside"].mean for step in self.stats for s in step if s["inside"].n]
        return float(np.mean(seen)) if seen else 0.0

    def calibrate(self, f: dict[str, np.ndarray], spread: np.ndarray) -> dict[str, np.ndarray]:
        """Early on an input's own deviation stands for its errors; then both are blended; later the errors count."""
        f = {k: np.array(v, copy=True) for k, v in f.items()}
        a = self.n / (10 * self.error_horizon)
        for h, i, st in ((h, i, st) for h, step in enumerate(self.stats) for i, st in enumerate(step)):
            if self.calibration == "NONE":
                break
            up, down, mean = math.sqrt(st["up"].mean), -math.sqrt(st["down"].mean), st["error"].mean
            share = min(1.0, max(0.0, a - 1))
            if self.forest is not None and self.forest.ready:
                share = 1.0
                up, down = (float(v) for v in self.forest.forest().impute([self.recent[0][i], self.recent[1][i], h, self.horizon - h, 0.0, 0.0], [4, 5])[4:])
            up, down, mean = share * up + (1 - share) * spread[i], share * down - (1 - share) * spread[i], share * mean
            p = st["inside"].mean
            widen = max(1.0, 1 / (p + 0.1)) if st["inside"].n and p < 1 - self.percentile else 1.0
            if self.calibration == "SIMPLE":
                f["value"][h][i] += mean
            f["upper"][h][i] = max(f["upper"][h][i], f["value"][h][i] + mean + 1.3 * up * widen)
            f["lower"][h][i] = min(f["lower"][h][i], f["value"][h][i] + mean + 1.3 * down * widen)
        low, high = self.limits
        for k in ("value", "upper", "lower"):
            f[k] = np.clip(f[k], -math.inf if low is None else low, math.inf if high is None else high)
        self.past = (self.past + [f | {"recent": self.recent}])[-self.horizon :]
        return f


class Caster(Detector):
    """A detector that also forecasts, with intervals calibrated by its past errors."""

    def __init__(self, settings: Settings, horizon: int = 5, error_horizon: int = 50, percentile: float = 0.1, calibration: str = "SIMPLE", low: float | None = None, high: float | None = None, estimator: bool = False) -> None:
        super().__init__(settings)
        self.horizon = horizon
        self.errors = ErrorHandler(horizon, error_horizon, percentile, calibration, low, high, estimator)

    def process(self, t: int, x, seq: int | None = None) -> Result:
        out = super().process(t, x, seq)
        if out.late:
            return out
        self.errors.observe(self.last_x)
        f = self.extrapolate(self.horizon)
        if f is not None:
            spread = np.array([v.dev for v in self.value])
            t_next = f.pop("t")
            del t_next
            f = self.errors.calibrate(f, spread)
            out.forecast, out.upper, out.lower = ([float(v) for v in f[k].ravel()] for k in ("value", "upper", "lower"))
            out.precision = self.errors.precision()
        return out


class Predictive:
    """Preprocessing, forest and the way back behind one object."""

    def __init__(self, settings: Settings) -> None:
        self.model = Detector(settings)

    def update(self, t: int, x) -> None:
        self.model.process(t, x)

    def _query(self, x) -> tuple[Forest | None, np.ndarray]:
        m = self.model
        y = m._transform(np.nan_to_num(np.atleast_1d(np.asarray(x, float))), 0.0)
        q = np.concatenate([m.shingle, y])[-m.forest.dims :]
        return (m.forest.forest() if m.forest.ready and len(q) == m.forest.dims else None), q

    def score(self, x) -> float:
        f, q = self._query(x)
        return float(f.score(q)[0]) if f else 0.0

    def attribution(self, x):
        f, q = self._query(x)
        return f.attribution(q) if f else None

    def density(self, x) -> float:
        f, q = self._query(x)
        return float(f.density_value(f.density(q))[0]) if f else 0.0

    def distance_attribution(self, x):
        f, q = self._query(x)
        return f.density(q)["distance"][0] if f else None

    def neighbours(self, x, missing=()):
        f, q = self._query(x)
        return f.summary(q, [len(q) - self.model.block + i for i in missing]) if f and len(missing) else None

    def predict(self, x, missing) -> np.ndarray:
        """x with its missing coordinates filled from the model."""
        x = np.atleast_1d(np.asarray(x, float)).copy()
        f, q = self._query(x)
        if f is None or not len(missing):
            return x
        done = f.impute(q, [len(q) - self.model.block + i for i in missing])
        back = self.model._invert(done[-self.model.block :])
        x[list(missing)] = back[list(missing)]
        return x


@dataclass
class Bandit:
    """Which of a few shared models serves a series: the one with the least mean score in the last interval."""

    arms: int
    interval: int = 50
    chosen: int = 0
    sums: list[float] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    seen: int = 0
    switches: int = 0
    affirmations: int = 0

    def __post_init__(self) -> None:
        self.sums, self.counts = [0.0] * self.arms, [0] * self.arms

    def add(self, scores) -> int:
        for k, s in enumerate(scores):
            self.sums[k] += float(s)
            self.counts[k] += 1
        self.seen += 1
        if self.seen % self.interval == 0:
            means = [s / max(c, 1) for s, c in zip(self.sums, self.counts, strict=True)]
            best = int(np.argmin(means))
            self.switches += best != self.chosen
            self.affirmations += best == self.chosen
            self.chosen = best
            self.sums, self.counts = [0.0] * self.arms, [0] * self.arms
        return self.chosen


FORMAT = 2  # of dumped state; raised whenever older state can no longer be read


def dump(model) -> bytes:
    """A model's state with the number of its format; boxes of trees are left out and follow from the points."""
    return pickle.dumps((FORMAT, model))


def restore(raw: bytes):
    """The model of a dump; ValueError where its format is another one."""
    state = pickle.loads(raw)
    if not isinstance(state, tuple) or state[0] != FORMAT:
        raise ValueError(f"state of another format: {state[0] if isinstance(state, tuple) else 1}, not {FORMAT}")
    return state[1]
