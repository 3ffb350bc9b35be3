"""Engines as functions of pages, registered by name and run once a Python worker, in it or in a process of its own.

An engine is a class whose recognize(page: dict) returns dict(text, confidence, lines), a layout detector one whose
detect(page: dict) returns blocks (interfaces.py). Either gets its configuration and may have a name and version. A
failed page becomes an error in its row, not a failed job. A module-level shutdown() is called when a runner closes.
"""

from __future__ import annotations

import atexit
import importlib
import json
import multiprocessing
import time
import traceback

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import BLOCK, REGION
from .layout import LABELS

OUT = f"book_id string, page bigint, engine string, version string, lines array<{REGION}>, text string, confidence double, runtime_s double, error string"
_running: dict = {}


class Registry:
    """Engines by name: `module:Class` paths or classes."""

    def __init__(self):
        self._engines: dict[str, object] = {}

    def register(self, name: str, engine) -> None:
        if name in self._engines:
            raise ValueError(f"engine {name} is registered already")
        self._engines[name] = engine

    def get(self, name: str):
        if name not in self._engines:
            raise KeyError(f"no engine {name}; there are {sorted(self._engines)}")
        return self._engines[name]


def resolve(engine):
    if not isinstance(engine, str):
        return engine
    module, _, cls = engine.partition(":")
    return getattr(importlib.import_module(module), cls)


def _shut_down(engine) -> None:
    module = engine.partition(":")[0] if isinstance(engine, str) else engine.__module__
    if stop := getattr(importlib.import_module(module), "shutdown", None):
        stop()


class InProcess:
    """Calls the engine in this process; time limits don't hold here."""

    def __init__(self, engine, config: dict, **_):
        self._engine, self._of = resolve(engine)(config), engine
        self.version = str(getattr(self._engine, "version", ""))

    def call(self, method: str, page: dict):
        return getattr(self._engine, method)(page)

    def close(self) -> None:
        _shut_down(self._of)


class OwnProcess:
    """Calls the engine in a child process, which is ended when it takes longer than timeout_s to start or to answer."""

    def __init__(self, engine, config: dict, timeout_s: float = 900.0, start_method: str = "spawn", **_):
        context = multiprocessing.get_context(start_method)
        self._pipe, theirs = context.Pipe()
        self._timeout = timeout_s
        self._child = context.Process(target=_serve, args=(theirs, engine, config))
        # Spark's Python workers are daemons, which may not have children as far as multiprocessing is concerned
        flag, multiprocessing.process.current_process()._config["daemon"] = multiprocessing.process.current_process()._config.get("daemon"), False
        try:
            self._child.start()
        finally:
            multiprocessing.process.current_process()._config["daemon"] = flag
        theirs.close()
        self.version = self._answer("start")

    def _answer(self, what: str):
        if not self._pipe.poll(self._timeout):
            self._end()
            raise TimeoutError(f"{what} took over {self._timeout:g} s")
        try:
            ok, value = self._pipe.recv()
        except EOFError:
            self._end()
            raise RuntimeError(f"{what}: the engine's process ended") from None
        if not ok:
            raise RuntimeError(value)
        return value

    def call(self, method: str, page: dict):
        if not self._child.is_alive():
            raise RuntimeError("the engine's process has ended")
        self._pipe.send((method, page))
        return self._answer(method)

    def _end(self) -> None:
        self._child.kill()
        self._child.join(5)

    def close(self) -> None:
        if self._child.is_alive():
            try:
                self._pipe.send(("close", None))
                self._pipe.poll(10)
            except OSError:
                pass
            self._child.join(1)
            self._end()


def _serve(pipe, engine, config: dict) -> None:
    try:
        runner = InProcess(engine, config)
        pipe.send((True, runner.version))
    except BaseException:  # whatever it is, the parent is told
        pipe.send((False, traceback.format_exc()))
        return
    while True:
        try:
            method, page = pipe.recv()
        except EOFError:
            return
        if method == "close":
            runner.close()
            pipe.send((True, None))
            return
        try:
            pipe.send((True, runner.call(method, page)))
        except BaseException as e:  # the page's error is its result
            pipe.send((False, f"{type(e).__name__}: {e}"))


RUNNERS = {"in_process": InProcess, "process": OwnProcess}


def _run(method: str, page: dict, engine, config: str, mode: str, options: dict):
    """(version, result, error) of a page. A runner that timed out is started again for the next page."""
    key = (engine if isinstance(engine, str) else engine.__qualname__, config, mode, json.dumps(options, sort_keys=True))
    try:
        if key not in _running:
            if not _running:
                atexit.register(close_all)
            _running[key] = RUNNERS[mode](engine, json.loads(config), **options)
        return _running[key].version, _running[key].call(method, page), None
    except Exception as e:  # the page's error is its result
        if isinstance(e, TimeoutError):
            _running.pop(key, None)
        text = str(e)
        return None, None, text if mode == "process" and not isinstance(e, TimeoutError) else f"{type(e).__name__}: {text}"


def close_all() -> None:
    while _running:
        _running.popitem()[1].close()


def _region(line: dict) -> dict:
    score = line.get("score")
    return {"kind": "body", **{k: float(line.get(k) or 0) for k in ("x0", "y0", "x1", "y1")}, "text": line["text"], "confidence": None if score is None else score * 100, "reading_order": None}


def recognize(pages: DataFrame, name: str, engine, config: dict | None = None, mode: str = "in_process", timeout_s: float = 900.0, start_method: str = "spawn") -> DataFrame:
    """pages(book_id, page, ...) -> OUT. Each worker starts the engine at its first page, so empty partitions start none."""
    settings, options = json.dumps(config or {}, sort_keys=True), {"timeout_s": timeout_s, "start_method": start_method}
    if mode not in RUNNERS:
        raise ValueError(f"no mode {mode}; there are {sorted(RUNNERS)}")

    def run(batches):
        for b in batches:
            rows = []
            for page in b.to_dict("records"):
                began = time.monotonic()
                version, got, error = _run("recognize", page, engine, settings, mode, options)
                got = got or {}
                rows.append((page["book_id"], page["page"], name, version, [_region(x) for x in got.get("lines") or ()], got.get("text"), got.get("confidence"), got.get("runtime_s") or time.monotonic() - began, error))
            yield pd.DataFrame(rows, columns=["book_id", "page", "engine", "version", "lines", "text", "confidence", "runtime_s", "error"])

    return pages.mapInPandas(run, OUT)


def detect(pages: DataFrame, detector, config: dict | None = None, mode: str = "in_process", timeout_s: float = 900.0, start_method: str = "spawn") -> DataFrame:
    """pages(book_id, page, ...) -> book_id, page, blocks in the order of their positions, layout_error (the type's name)."""
    settings, options = json.dumps(config or {}, sort_keys=True), {"timeout_s": timeout_s, "start_method": start_method}

    def run(batches):
        for b in batches:
            rows = []
            for page in b.to_dict("records"):
                _, got, error = _run("detect", page, detector, settings, mode, options)
                blocks = None if error else [{"kind": LABELS.get(x["label"], "body"), **{k: float(x[k]) for k in ("x0", "y0", "x1", "y1")}, "reading_order": x.get("position")} for x in got]
                rows.append((page["book_id"], page["page"], blocks, error and error.partition(":")[0]))
            yield pd.DataFrame(rows, columns=["book_id", "page", "blocks", "layout_error"])

    return pages.mapInPandas(run, f"book_id string, page bigint, blocks array<{BLOCK}>, layout_error string")


class EchoEngine:
    """A stand-in that returns the page's own lines: from the bottom up if configured, upper-cased or cut, slow or failing on some pages."""

    version = "echo-1"

    def __init__(self, config: dict):
        if config.get("fail_start"):
            raise RuntimeError("can't start")
        time.sleep(config.get("start_s", 0))
        self.config = config

    def recognize(self, page: dict) -> dict:
        c, text = self.config, page.get("text") or ""
        if c.get("fail_every") and page["page"] % c["fail_every"] == 0:
            raise RuntimeError("page can't be read")
        if c.get("slow_every") and page["page"] % c["slow_every"] == 0:
            time.sleep(60)
        text = text[: c.get("cut")]
        text = text.upper() if c.get("upper") else text
        score = c.get("score")
        lines = [{"text": x, "score": score, "x0": 0, "y0": 20 * i, "x1": len(x), "y1": 20 * i + 9} for i, x in enumerate(text.split("\n"))]
        lines = lines[::-1] if c.get("reverse") else lines
        return {"text": "\n".join(x["text"] for x in lines), "confidence": None if score is None else mean_line_confidence(lines), "lines": lines}


class BandDetector:
    """A stand-in that sees a header in the first 10 units of a page, a body below and a caption below 1000; fails on some pages if configured."""

    def __init__(self, config: dict):
        self.config = config

    def detect(self, page: dict) -> list[dict]:
        if self.config.get("fail_every") and page["page"] % self.config["fail_every"] == 0:
            raise LookupError("no layout")
        bands = [("Caption", 1000, 1e9), ("PageHeader", 0, 10), ("Text", 10, 1000)]
        return [{"label": label, "x0": 0, "y0": lo, "x1": 1e9, "y1": hi, "position": i} for i, (label, lo, hi) in enumerate(bands)]


def mean_line_confidence(lines: list[dict]) -> float:
    return float(np.mean([x["score"] for x in lines])) * 100 if lines else 0.0


def mean_token_probability(scores: np.ndarray, chosen: np.ndarray) -> float:
    """Mean softmax probability of the chosen tokens, in percent with two places; kept beside the confidence, never as it."""
    z = scores - scores.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    return round(float(p[np.arange(len(chosen)), chosen].mean()) * 100, 2) if len(chosen) else 0.0


def token_probability(scores: str, chosen: str) -> str:
    """The same as an expression over array<array<double>> and array<int> (from 0)."""
    top = "array_max(s)"
    p = f"exp(s[{chosen}[i]] - {top}) / aggregate(s, 0D, (a, v) -> a + exp(v - {top}))"
    return f"round(aggregate(transform({scores}, (s, i) -> {p}), 0D, (a, v) -> a + v) / greatest(size({chosen}), 1) * 100, 2)"


def line_confidence(lines: str) -> str:
    """Mean score of lines in percent as an expression over array<struct<score, ...>>; 0 without lines."""
    return f"coalesce(aggregate({lines}, 0D, (a, l) -> a + l.score) / nullif(size({lines}), 0) * 100, 0D)"
