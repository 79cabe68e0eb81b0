"""Running the stages: what a run includes, how far it is, in which order."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stages in order, with their share of a full run.
WEIGHTS = {"etl": 10, "features": 12, "regime": 4, "train": 58, "predict": 6, "history": 6, "portfolio": 2, "paper": 2}
HORIZONS = (5, 10, 20, 63, 126)

#: Named runs.
PRESETS: dict[str, dict] = {
    "refresh_prices": {"stages": ("etl", "features", "regime")},
    "rescore_signals": {"stages": ("predict", "portfolio")},
    "train_short": {"stages": ("train", "predict"), "horizons": (5, 10, 20), "walk_forward": False, "liquid_only": True},
    "rebuild_paper": {"stages": ("history", "paper"), "horizons": (5, 10, 20)},
    "full": {"stages": tuple(WEIGHTS)},
}


@dataclass(frozen=True)
class Run:
    stages: tuple[str, ...] = tuple(WEIGHTS)
    horizons: tuple[int, ...] = HORIZONS
    entities: tuple[str, ...] | None = None
    walk_forward: bool = True
    liquid_only: bool = False

    def names(self, scored: Sequence[str], liquid: Sequence[str]) -> list[str]:
        """The entities of the run, in the order of ``scored``."""
        chosen = set(self.entities) if self.entities is not None else set(scored)
        return [e for e in scored if e in chosen and (not self.liquid_only or e in set(liquid))]


def resolve(preset: str | None = None, **override) -> Run:
    """A run from a preset and overrides; values that are unknown, or leave nothing, fall back to the preset's."""
    base = Run(**PRESETS.get(preset or "full", PRESETS["full"]))
    stages = tuple(s for s in WEIGHTS if s in (override.get("stages") or ())) or base.stages
    horizons = tuple(h for h in HORIZONS if h in (override.get("horizons") or ())) or base.horizons
    entities = override.get("entities")
    flag = lambda k: override[k] if isinstance(override.get(k), bool) else getattr(base, k)
    return Run(stages, horizons, tuple(entities) if entities else base.entities, flag("walk_forward"), flag("liquid_only"))


def resolve_rows(requests: DataFrame) -> DataFrame:
    """:func:`resolve` for a table of requests: ``preset``, ``stages`` and ``horizons``, each of which may be null."""
    bases = {name: Run(**options) for name, options in PRESETS.items()}

    def chosen(part: str, known: Sequence):
        values = lambda xs: F.array(*map(F.lit, xs))
        base = F.coalesce(*[F.when(F.col("preset") == name, values(getattr(run, part))) for name, run in bases.items()], values(getattr(bases["full"], part)))
        own = F.filter(values(known), lambda x: F.coalesce(F.array_contains(part, x), F.lit(False)))
        return F.when(F.size(own) > 0, own).otherwise(base)

    return requests.withColumns({"stages": chosen("stages", tuple(WEIGHTS)), "horizons": chosen("horizons", HORIZONS)})


@dataclass
class Tracker:
    """The state of the one run that may be on; safe to read from other threads."""

    lines: int = 80
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        self._log: deque[str] = deque(maxlen=self.lines)
        self._reset("idle", ())

    def _reset(self, status: str, stages: Sequence[str]) -> None:
        self.status, self.stages, self.done, self.stage = status, tuple(stages), [], None
        self.current = self.total = 0
        self.error: str | None = None
        self.started = self.ended = None

    def begin(self, run: Run) -> bool:
        """False, and nothing changes, while another run is on."""
        with self._lock:
            if self.status == "running":
                return False
            self._log.clear()
            self._reset("running", run.stages)
            self.started = datetime.now(UTC)
            return True

    def report(self, stage: str, current: int = 0, total: int = 0, message: str = "") -> None:
        with self._lock:
            if self.stage not in (None, stage) and self.stage not in self.done:
                self.done.append(self.stage)
            self.stage, self.current, self.total = stage, current, total
            if message:
                self._log.append(f"{stage}: {message}")

    def finish(self, error: BaseException | None = None) -> None:
        with self._lock:
            self.status, self.error, self.ended = ("failed", str(error), datetime.now(UTC)) if error else ("finished", None, datetime.now(UTC))
            if not error:
                self.done, self.stage = list(self.stages), None

    def percent(self) -> float:
        """Weight done over the weight of the chosen stages; a stage without a total counts 15 %."""
        whole = sum(WEIGHTS[s] for s in self.stages)
        if self.status == "finished" or not whole:
            return 100.0 if self.status == "finished" else 0.0
        share = sum(WEIGHTS[s] for s in self.done)
        if self.stage in WEIGHTS:
            share += WEIGHTS[self.stage] * (min(1.0, self.current / self.total) if self.total else 0.15)
        return round(100.0 * share / whole, 1)

    def snapshot(self) -> dict:
        with self._lock:
            end = self.ended or datetime.now(UTC)
            return {
                "status": self.status, "stage": self.stage, "percent": self.percent(), "done": list(self.done), "log": list(self._log), "error": self.error,
                "elapsed_s": round((end - self.started).total_seconds(), 1) if self.started else 0.0,
            }


def execute(run: Run, stages: Mapping[str, Callable[[Run, Callable[..., None]], object]], tracker: Tracker) -> dict[str, object]:
    """Runs the chosen stages in order; each gets the run and a function to report with.

    A failed stage ends the run and is raised again.  Retries within a stage
    are Spark's.
    """
    if not tracker.begin(run):
        raise RuntimeError("a run is on already")
    results: dict[str, object] = {}
    try:
        for name in run.stages:
            tracker.report(name, message="begins")
            results[name] = stages[name](run, lambda current=0, total=0, message="", _n=name: tracker.report(_n, current, total, message))
    except BaseException as e:
        tracker.finish(e)
        raise
    tracker.finish()
    return results
