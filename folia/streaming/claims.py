"""A queue of tasks as files in state folders of a shared file system, for workers outside Spark: claims by rename, an append-only log, exit rules (Q1-Q9, T5)."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path

STATES = ("pending", "in_progress", "done", "failed")


class Queue:
    """Tasks are ``<state>/<id>.json``. A rename within one file system is atomic, so of several workers exactly one gets a task and a task is in exactly one state."""

    def __init__(self, root: str | os.PathLike):
        self.root = Path(root)
        for s in STATES:
            (self.root / s).mkdir(parents=True, exist_ok=True)

    def path(self, state: str, task: str) -> Path:
        return self.root / state / f"{task}.json"

    def enqueue(self, task: str, payload: dict) -> bool:
        """Adds a task unless it is in any state already (Q1). The file appears whole: it is written beside its place and linked there, which fails if another was faster."""
        if any(self.path(s, task).exists() for s in STATES):
            return False
        part = self.root / f".{task}.{os.getpid()}.{random.random()}"
        part.write_text(json.dumps(payload))
        try:
            os.link(part, self.path("pending", task))
        except FileExistsError:
            return False
        finally:
            part.unlink()
        return True

    def claim(self, worker: str, tries: int = 50, listing: int = 5000, seed: int | None = None) -> tuple[str, dict] | None:
        """Takes a pending task by renaming it (Q2). Names are probed in random order, at most ``tries`` of at most ``listing`` names, so that workers seldom meet (T5)."""
        names = []
        with os.scandir(self.root / "pending") as entries:
            for e in entries:
                if e.name.endswith(".json"):
                    names.append(e.name[:-5])
                if len(names) >= listing:
                    break
        random.Random(seed).shuffle(names)
        for task in names[:tries]:
            try:
                os.rename(self.path("pending", task), self.path("in_progress", task))
            except FileNotFoundError:
                continue
            payload = json.loads(self.path("in_progress", task).read_text()) | {"worker": worker, "claimed_at": time.time()}
            self._write("in_progress", task, payload)
            return task, payload
        return None

    def finish(self, task: str, result: dict, ok: bool = True) -> None:
        """Moves a task to done or failed with its result merged in (Q3)."""
        payload = json.loads(self.path("in_progress", task).read_text()) | result | {"finished_at": time.time()}
        self._write("in_progress", task, payload)
        os.rename(self.path("in_progress", task), self.path("done" if ok else "failed", task))

    def recover(self, after: float, now: float | None = None) -> list[str]:
        """Tasks in progress for more than ``after`` seconds go back to pending without the fields of their claim (Q4)."""
        back, now = [], now or time.time()
        for p in sorted((self.root / "in_progress").glob("*.json")):
            payload = json.loads(p.read_text())
            if now - payload.get("claimed_at", p.stat().st_mtime) > after:
                self._write("in_progress", p.stem, {k: v for k, v in payload.items() if k not in ("worker", "claimed_at")})
                os.rename(p, self.path("pending", p.stem))
                back.append(p.stem)
        return back

    def counts(self) -> dict[str, int]:
        return {s: sum(1 for e in os.scandir(self.root / s) if e.name.endswith(".json")) for s in STATES}

    def _write(self, state: str, task: str, payload: dict) -> None:
        part = self.root / f".{task}.{os.getpid()}.part"
        part.write_text(json.dumps(payload))
        os.replace(part, self.path(state, task))


def work(queue: Queue, do: Callable[[str, dict], dict], worker: str = "worker", empty_polls: int = 5, most_errors: int = 30, pause: float = 1.0) -> dict[str, int]:
    """Claims and does tasks until ``empty_polls`` polls in a row find none or ``most_errors`` tasks have failed (Q5). A failing task is moved to failed with its message."""
    done = errors = idle = 0
    while idle < empty_polls and errors < most_errors:
        got = queue.claim(worker)
        if got is None:
            idle += 1
            if idle < empty_polls:
                time.sleep(pause)
            continue
        idle = 0
        task, payload = got
        try:
            queue.finish(task, do(task, payload))
            done += 1
        except Exception as e:  # noqa: BLE001 - whatever a task raises is its result
            queue.finish(task, {"error": str(e)[:500]}, ok=False)
            errors += 1
    return {"done": done, "errors": errors, "idle": idle}


class Log:
    """An append-only log of finished ids: one line each, forced to disk; a last line that was cut off by a crash doesn't count (Q8)."""

    def __init__(self, path: str | os.PathLike):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def add(self, ident: str) -> None:
        with self.path.open("ab+") as f:
            if f.tell() and (f.seek(-1, 2), f.read(1))[1] != b"\n":
                f.write(b"\n")
            f.write(json.dumps(ident).encode() + b"\n")
            f.flush()
            os.fsync(f.fileno())

    def __iter__(self) -> Iterator[str]:
        if self.path.exists():
            for line in self.path.read_bytes().split(b"\n")[:-1]:
                try:
                    yield json.loads(line)
                except ValueError:
                    continue


class Memo:
    """An expensive value that is computed at most once every ``seconds`` (Q9)."""

    def __init__(self, make: Callable[[], object], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock, self.at, self.value = make, seconds, clock, None, None

    def __call__(self) -> object:
        now = self.clock()
        if self.at is None or now - self.at >= self.seconds:
            self.value, self.at = self.make(), now
        return self.value
