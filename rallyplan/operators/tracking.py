"""Online tracking: people from frame to frame, and ball candidates into tracklets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from rallyplan.operators.identity import look_distance
from rallyplan.operators.sequence import assignment

#: Reach of a person in metres, and how long one may be lost.
REACH_M_S, SLACK_M, LOST_S = 9.0, 1.2, 1.0
NO_WAY = 1e6


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of boxes."""
    w, h = np.maximum(0.0, np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]))
    union = np.prod(a[2:] - a[:2]) + np.prod(b[2:] - b[:2]) - w * h
    return float(w * h / union) if union > 0 else 0.0


@dataclass
class _Seen:
    id: int
    t: float
    foot: np.ndarray
    box: np.ndarray
    look: np.ndarray
    pace: np.ndarray = field(default_factory=lambda: np.zeros(2))


@dataclass
class PeopleTracker:
    """Frames in order of time; ``frame`` gives the track id of each detection (foot, box, look)."""

    reach: float = REACH_M_S
    slack: float = SLACK_M
    live: list[_Seen] = field(default_factory=list)
    used: int = 0

    def frame(self, t: float, people: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[int]:
        self.live = [k for k in self.live if t - k.t <= LOST_S]
        cost = np.full((len(self.live), len(people)), NO_WAY)
        for i, k in enumerate(self.live):
            dt = max(t - k.t, 1e-3)
            limit = self.reach * dt + self.slack
            for j, (foot, box, look) in enumerate(people):
                way = float(np.linalg.norm(foot - (k.foot + k.pace * min(dt, 0.3))))
                if way <= limit:
                    cost[i, j] = way / limit + 0.7 * look_distance(k.look, look) + 0.5 * (1 - overlap(k.box, box))
        ids = [-1] * len(people)
        for i, j in assignment(cost):
            if cost[i, j] < NO_WAY:
                k, (foot, box, look) = self.live[i], people[j]
                pace = (foot - k.foot) / max(t - k.t, 1e-3)
                self.live[i] = _Seen(k.id, t, foot, box, 0.9 * k.look + 0.1 * look, 0.6 * k.pace + 0.4 * pace)
                ids[j] = k.id
        for j, (foot, box, look) in enumerate(people):
            if ids[j] < 0:
                ids[j] = self.used
                self.live.append(_Seen(self.used, t, foot, box, look))
                self.used += 1
        return ids


@dataclass
class Tracklet:
    id: int
    frames: list[int] = field(default_factory=list)
    xy: list[tuple[float, float]] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    missed: int = 0

    def guess(self, frame: int) -> tuple[np.ndarray, float]:
        """Where it should be, and how far around to look."""
        here = np.array(self.xy[-1])
        if len(self.frames) == 1:
            return here, 60.0
        pace = (here - self.xy[-2]) / (self.frames[-1] - self.frames[-2])
        ahead = frame - self.frames[-1]
        return here + pace * ahead, 8.0 + 0.6 * float(np.hypot(*pace)) * ahead

    @property
    def strength(self) -> float:
        return float(sum(self.scores))

    @property
    def usable(self) -> bool:
        """Long enough, moving, mostly not on a person, bright enough."""
        if len(self.frames) < 4:
            return False
        pace = np.hypot(*np.diff(np.array(self.xy), axis=0).T) / np.diff(self.frames)
        return bool(np.median(pace) >= 1.0 and np.mean(self.inside) < 0.7 and np.mean(self.scores) > 0.15)


class BallLinker:
    """Tracklets out of candidates (x, y, score, on a person), frame by frame; longer tracklets choose first, eight new ones a frame."""

    def __init__(self, patience: int):
        self.patience, self.live, self.used = patience, [], 0

    def frame(self, f: int, candidates: list[tuple[float, float, float, bool]]) -> list[Tracklet]:
        """Take a frame; the tracklets that end with it."""
        free = dict(enumerate(candidates))
        for k in sorted(self.live, key=lambda k: -len(k.frames)):
            here, radius = k.guess(f)
            ways = {j: float(np.hypot(c[0] - here[0], c[1] - here[1])) for j, c in free.items()}
            near = min(ways, key=ways.__getitem__, default=None)
            if near is None or ways[near] >= radius:
                k.missed += 1
                continue
            _extend(k, f, free.pop(near))
        done = [k for k in self.live if k.missed > self.patience]
        self.live = [k for k in self.live if k.missed <= self.patience]
        for c in list(free.values())[:8]:
            self.live.append(_extend(Tracklet(self.used), f, c))
            self.used += 1
        return done

    def close(self) -> list[Tracklet]:
        """The tracklets that are still open."""
        done, self.live = self.live, []
        return done

    def saved(self) -> str:
        return json.dumps([self.patience, self.used, [vars(k) for k in self.live]])

    @classmethod
    def restored(cls, text: str) -> BallLinker:
        patience, used, live = json.loads(text)
        out = cls(patience)
        out.used, out.live = used, [Tracklet(**k | {"xy": [(x, y) for x, y in k["xy"]]}) for k in live]
        return out


def link_ball(frames: dict[int, list[tuple[float, float, float, bool]]], patience: int) -> list[Tracklet]:
    """The usable tracklets of all frames."""
    linker = BallLinker(patience)
    done = [k for f in sorted(frames) for k in linker.frame(f, frames[f])]
    return [k for k in done + linker.close() if k.usable]


def _extend(k: Tracklet, frame: int, c: tuple[float, float, float, bool]) -> Tracklet:
    k.frames.append(frame)
    k.xy.append((c[0], c[1]))
    k.scores.append(c[2])
    k.inside.append(c[3])
    k.missed = 0
    return k


def strongest(tracklets: list[Tracklet]) -> dict[int, tuple[float, float, int]]:
    """One position for each frame: of the strongest tracklet there, the first of equals."""
    out: dict[int, tuple[float, float, float, int]] = {}
    for k in tracklets:
        for f, (x, y) in zip(k.frames, k.xy, strict=True):
            if f not in out or k.strength > out[f][2]:
                out[f] = (x, y, k.strength, k.id)
    return {f: (x, y, i) for f, (x, y, _, i) in out.items()}
