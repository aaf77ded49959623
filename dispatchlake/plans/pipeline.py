"""Runs of named stages with a state file: resumed after the last finished stage, repeated runs of a day do nothing."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from dispatchlake.operators.selection import PermanentError


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[dict], dict]
    #: A failure of an optional stage is noted and the run goes on.
    optional: bool = False


@dataclass
class RunState:
    run_id: str
    status: str = "running"
    stage: str | None = None
    metrics: dict = field(default_factory=dict)


class StateFile:
    """One JSON file for each run, replaced as a whole."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def read(self, run_id: str) -> RunState | None:
        try:
            with open(f"{self.folder}/{run_id}.json", encoding="utf8") as f:
                return RunState(**json.load(f))
        except FileNotFoundError:
            return None

    def write(self, state: RunState) -> None:
        with open(tmp := f"{self.folder}/{state.run_id}.json.new", "w", encoding="utf8") as f:
            json.dump(state.__dict__, f)
        os.replace(tmp, f"{self.folder}/{state.run_id}.json")


def run_id(trigger: str, date: str) -> str:
    return f"{trigger}_{date.replace('-', '')}"


def run_stages(stages: Sequence[Stage], states: StateFile, run: str, context: dict, force: bool = False, deadline_s: float | None = None, alert: Callable[[str], None] = print) -> RunState:
    """Runs what is left of ``run``. A failing stage alerts first, then marks the run and raises; the deadline holds between stages."""
    state = states.read(run)
    if state and state.status == "succeeded" and not force:
        return state
    names = [s.name for s in stages]
    done = names.index(state.stage) + 1 if state and not force and state.stage in names else 0
    state = RunState(run, stage=names[done - 1] if done else None, metrics=state.metrics if state and not force else {})
    states.write(state)
    began, partial = time.monotonic(), False
    for s in stages[done:]:
        try:
            if deadline_s is not None and time.monotonic() - began > deadline_s:
                raise TimeoutError(f"no time left for {s.name}")
            state.metrics[s.name] = s.run(context)
        except Exception as e:
            alert(f"{run}: {s.name}: {e}")
            # An outside service that will not answer again ends the run, whichever stage meets it.
            if not s.optional or isinstance(e, TimeoutError) or PermanentError.__name__ in f"{type(e).__name__} {e}":
                state.status = "failed"
                states.write(state)
                raise
            partial = True
            state.metrics[s.name] = {"error": str(e)}
        state.stage = s.name
        states.write(state)
    state.status = "partial" if partial else "succeeded"
    states.write(state)
    return state
