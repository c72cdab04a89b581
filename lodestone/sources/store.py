"""A store of finished results addressed by what they were made from, and a ledger of runs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import socket
import time
from collections.abc import Callable
from contextlib import contextmanager


class StoreLocked(RuntimeError):
    """Another live process is building the entry."""


def canonical_hash(fields: dict) -> str:
    """SHA-256 of the fields as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class ResultStore:
    """Entries are directories of a shared folder; an entry counts once its manifest is there, which is renamed into
    place last. A lock file names its holder; one whose process has gone is taken over, and what it left is moved aside."""

    def __init__(self, root: str):
        self.root = root

    def entry(self, name: str, made_from: dict) -> str:
        slug = re.sub(r"[^A-Za-z0-9._-]+", "--", name)[-60:]
        return os.path.join(self.root, f"{slug}-{canonical_hash(made_from)[:12]}")

    @contextmanager
    def _locked(self, entry: str):
        lock = entry + ".lock"
        os.makedirs(self.root, exist_ok=True)
        while True:
            try:
                fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                if self._alive(lock):
                    raise StoreLocked(f"{entry} is being built by {open(lock).read()}") from None
                os.replace(lock, f"{lock}.stale-{time.time_ns()}")
        try:
            os.write(fd, f"{socket.gethostname()}:{os.getpid()}".encode())
            os.close(fd)
            yield
        finally:
            if os.path.exists(lock):
                os.unlink(lock)

    @staticmethod
    def _alive(lock: str) -> bool:
        try:
            host, _, pid = open(lock).read().partition(":")
        except FileNotFoundError:
            return False
        if host != socket.gethostname():
            return True  # can't be told from here
        try:
            os.kill(int(pid), 0)
            return True
        except (ProcessLookupError, ValueError):
            return False
        except PermissionError:
            return True

    def manifest(self, entry: str) -> dict | None:
        try:
            with open(os.path.join(entry, "manifest.json")) as f:
                return json.load(f)
        except (FileNotFoundError, ValueError):
            return None

    def obtain(self, name: str, made_from: dict, build: Callable[[str], dict]) -> tuple[str, bool]:
        """``(directory, reused)``: the entry made from these fields, built by ``build(directory)`` if there is none. What
        ``build`` returns is kept in the manifest. A build that fails leaves no entry."""
        entry = self.entry(name, made_from)
        if (m := self.manifest(entry)) and m["made_from"] == made_from:
            return entry, True
        with self._locked(entry):
            if (m := self.manifest(entry)) and m["made_from"] == made_from:
                return entry, True
            if os.path.exists(entry):
                os.replace(entry, f"{entry}.aside-{time.time_ns()}")
            os.makedirs(entry)
            try:
                info = build(entry)
                with open(os.path.join(entry, ".manifest"), "w") as f:
                    json.dump({"made_from": made_from, "info": info, "at": time.time()}, f, sort_keys=True)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(os.path.join(entry, ".manifest"), os.path.join(entry, "manifest.json"))
            except BaseException:
                shutil.rmtree(entry, ignore_errors=True)
                raise
        return entry, False

    def entries(self) -> list[dict]:
        """Every entry with its state: complete, building, partial."""
        out = []
        for n in sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []:
            path = os.path.join(self.root, n)
            if os.path.isdir(path):
                state = "complete" if self.manifest(path) else "building" if os.path.exists(path + ".lock") else "partial"
                out.append({"entry": n, "state": state})
        return out


class Ledger:
    """Runs of stages, appended one JSON line each under a lock, so that two writers neither share a name nor tear a line."""

    #: Seconds after which another writer's lock is taken for a dead one's.
    STALE = 60

    def __init__(self, path: str):
        self.path = path

    def runs(self) -> list[dict]:
        try:
            with open(self.path) as f:
                return [json.loads(line) for line in f if line.strip()]
        except FileNotFoundError:
            return []

    @contextmanager
    def _locked(self):
        lock = self.path + ".lock"
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                try:
                    if time.time() - os.path.getmtime(lock) > self.STALE:
                        os.replace(lock, f"{lock}.stale-{time.time_ns()}")
                except FileNotFoundError:
                    pass
                time.sleep(0.02)
        try:
            yield
        finally:
            os.unlink(lock)

    def append(self, stage: str, info: dict, options: dict | None = None) -> dict:
        """Adds a run under the stage's next free name (``stage``, ``stage_2``, …)."""
        with self._locked():
            n = sum(r["stage"] == stage for r in self.runs())
            run = {"stage": stage, "run": stage if not n else f"{stage}_{n + 1}", "at": time.time(), **info}
            if options is not None:
                run["options_hash"] = canonical_hash(options)
            with open(self.path, "a") as f:
                f.write(json.dumps(run, sort_keys=True) + "\n")
                f.flush()
                os.fsync(f.fileno())
        return run


class ResumeRefused(ValueError):
    """A ledger whose finished stages aren't the specification's."""


def run_chain(steps: list[dict], known: dict[str, Callable[..., dict]], ledger: Ledger, resume: bool = False) -> list[dict]:
    """Runs the stages of a specification in order, after all of it has been checked: known stages, no unknown keys.

    With ``resume`` the stages that the ledger has already are passed over, if they are the specification's first ones with
    the same options; else nothing runs."""
    for i, step in enumerate(steps):
        if step.get("stage") not in known:
            raise ValueError(f"step {i}: unknown stage {step.get('stage')!r}; known are {sorted(known)}")
        if extra := set(step) - {"stage", "options"}:
            raise ValueError(f"step {i}: unknown keys {sorted(extra)}")
    done = ledger.runs() if resume else []
    for i, (run, step) in enumerate(zip(done, steps)):
        if run["stage"] != step["stage"] or run.get("options_hash") not in (None, canonical_hash(step.get("options", {}))):
            raise ResumeRefused(f"step {i}: the ledger has {run['run']} here, run with other options or another stage")
    if len(done) > len(steps):
        raise ResumeRefused(f"the ledger has {len(done)} runs, the specification {len(steps)}")
    rest = [ledger.append(s["stage"], known[s["stage"]](**s.get("options", {})), s.get("options", {})) for s in steps[len(done) :]]
    return [*done, *rest]
