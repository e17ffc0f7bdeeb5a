"""Editing with undo and redo over a store, in named transactions that can be logged and replayed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators import statistics
from quadrel.store import ROW, Store

ACTIONS = ("assert", "retractall", "update", "load", "unload", "register_prefix", "unregister_prefix")


class Editor:
    """Changes are grouped by outermost transaction; each group keeps the states before and after. Undo gives the group's inverse as a new
    step, so redo is the undo of an undo. A transaction that fails leaves no trace. States share their unchanged data with the
    store, so keeping them costs what the changes cost."""

    def __init__(self, store: Store, prefixes=None) -> None:
        self.store, self.prefixes = store, prefixes
        self.done: list[dict] = []
        self.undone: list[dict] = []
        self.path: list[int] = []
        self.counter, self.calls = 0, []
        self.names: dict[tuple[int, ...], str] = {}
        self.files: dict[str, dict] = {}
        self.marks: dict[str, int] = {}
        self.journal: str | None = None

    @contextmanager
    def transaction(self, name: str | None = None) -> Iterator[tuple[int, ...]]:
        """Nested ids are tuples of numbers."""
        outer, before, noted = not self.path, self.store.state, len(self.calls)
        if outer:
            self.counter += 1
            self.path = [self.counter]
        else:
            self.path = [*self.path, len([n for n in self.names if len(n) == len(self.path) + 1 and list(n[:-1]) == self.path]) + 1]
        me = tuple(self.path)
        self.names[me] = name or ""
        try:
            with self.store.transaction(me):
                yield me
        except BaseException:
            del self.calls[noted:]
            for n in [n for n in self.names if n[: len(me)] == me]:
                del self.names[n]
            raise
        finally:
            self.path = self.path[:-1] if len(self.path) > 1 else []
        if outer and self.calls:
            step = {"id": me, "before": before, "after": self.store.state, "calls": self.calls.copy()}
            self.done.append(step)
            self.undone.clear()
            self.calls.clear()
            self._log(step)

    def _do(self, action: str, *args, call) -> None:
        with self.transaction(action):
            self.calls.append([action, *args])
            call()

    def _allowed(self, g: str | None) -> None:
        if g is not None and self.files.get(g, {}).get("access") == "read-only":
            raise PermissionError(f"{g} is read-only")

    def insert(self, rows: list[tuple], g: str | None = None) -> None:
        self._allowed(g)
        rows = [(*r[:3], g or (r[3] if len(r) > 3 else None), r[4] if len(r) > 4 else None) for r in rows]
        self._do("assert", rows, call=lambda: self.store.insert(rows))

    def retract(self, s=None, p=None, o=None, g=None) -> None:
        self._allowed(g)
        self._do("retractall", s, p, o, g, call=lambda: self.store.retract(s, p, o, g))

    def update(self, place: str, value: str, s=None, p=None, o=None, g=None) -> None:
        self._allowed(g)
        self._do("update", place, value, s, p, o, g, call=lambda: self.store.update(place, value, s, p, o, g))

    def delete(self, s: str) -> None:
        """Everything a subject is in."""
        with self.transaction("delete"):
            self.retract(s=s)
            self.retract(p=s)
            self.retract(o=s)

    def load(self, rows, g: str, **options) -> None:
        """A load can't be replayed from its rows if they come as a frame; its source is logged then."""
        self._do("load", options.get("source", g), g, call=lambda: self.store.load(rows, g, **options))

    def unload(self, g: str) -> None:
        self._do("unload", g, call=lambda: self.store.unload_graph(g))

    def register_prefix(self, prefix: str, iri: str) -> None:
        self._do("register_prefix", prefix, iri, call=lambda: self.prefixes.register(prefix, iri, force=True))

    def unregister_prefix(self, prefix: str) -> None:
        self._do("unregister_prefix", prefix, call=lambda: self.prefixes.unregister(prefix))

    # Undo and redo.

    def _restore(self, step: dict, which: str, name: str) -> None:
        gone, come = self._difference(step, which)
        with self.store.transaction((name, step["id"])):
            self.store.retract_rows(gone)
            self.store.insert(come)
        for action, *args in step["calls"] if which == "before" else []:
            if action == "register_prefix":
                self.prefixes.unregister(args[0])

    def _difference(self, step: dict, which: str) -> tuple[DataFrame, DataFrame]:
        """The rows to take away and to add to get from the step's one state to the other: those of the deltas between them, or, if the store was
        compacted meanwhile, those in which what is there differs from the state wanted."""
        a, b = step["before"], step["after"]
        if a.base is b.base and b.born[: len(a.born)] == a.born and b.dead[: len(a.dead)] == a.dead and len(b.born) > len(a.born):
            came = reduce(DataFrame.unionByName, [f.select(*ROW) for f in b.born[len(a.born):]])
            went = [f.select(*ROW) for f in b.dead[len(a.dead):]]
            went = reduce(DataFrame.unionByName, went) if went else came.limit(0)
            gone, come = _minus(came, went), _minus(went, came)
            return (gone, come) if which == "before" else (come, gone)
        here, target = visible_rows(self.store.state), visible_rows(step[which])
        return _minus(here, target), _minus(target, here)

    def undo(self) -> None:
        step = self.done.pop()
        self._restore(step, "before", "undo")
        self.undone.append(step)
        self._log({"calls": [["undo", list(step["id"])]]})

    def redo(self) -> None:
        step = self.undone.pop()
        self._restore(step, "after", "redo")
        for action, *args in step["calls"]:
            if action == "register_prefix":
                self.prefixes.register(*args, force=True)
        self.done.append(step)
        self._log({"calls": [["redo", list(step["id"])]]})

    def can_undo(self) -> tuple[int, ...] | None:
        return self.done[-1]["id"] if self.done else None

    def can_redo(self) -> tuple[int, ...] | None:
        return self.undone[-1]["id"] if self.undone else None

    def set_watermark(self, name: str) -> None:
        self.marks[name] = len(self.done)

    def transaction_name(self, id_: tuple[int, ...]) -> str:
        return self.names[id_]

    def set_transaction_name(self, name: str) -> None:
        self.names[tuple(self.path)] = name

    def members(self, id_: tuple[int, ...]) -> list:
        return next(s["calls"] for s in [*self.done, *self.undone] if s["id"] == id_)

    # Files.

    def set_file_property(self, g: str, **properties) -> None:
        """``access`` (read-write, read-only, ro-fallback), ``default`` (all, fallback)."""
        self.files.setdefault(g, {}).update(properties)

    def get_file_property(self, g: str) -> dict:
        return {"access": "read-write", **self.files.get(g, {})}

    def is_modified(self, g: str) -> bool:
        return self.files.get(g, {}).get("md5", "0" * 32) != self.store.graph_md5(g)

    def clear_modified(self, g: str) -> None:
        self.files.setdefault(g, {})["md5"] = self.store.graph_md5(g)

    # The log of calls.

    def open_journal(self, path: str, mode: str = "append") -> None:
        self.journal = path
        if mode == "write":
            open(path, "w").close()

    def close_journal(self) -> None:
        self.journal = None

    def current_journal(self) -> str | None:
        return self.journal

    def _log(self, step: dict) -> None:
        if self.journal:
            with open(self.journal, "a") as f:
                f.write(json.dumps(step["calls"], default=str) + "\n")

    def replay_journal(self, path: str, load=None) -> None:
        """Applies the calls of a log, a line a transaction; ``load(source, graph)`` gives the rows of a logged load."""
        for line in open(path):
            calls = json.loads(line)
            if calls and calls[0][0] in ("undo", "redo"):
                getattr(self, calls[0][0])()
                continue
            with self.transaction("replay"):
                for action, *args in calls:
                    if action == "assert":
                        self.insert([tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in args[0]])
                    elif action == "load":
                        self.load(load(*args), args[1])
                    else:
                        {"retractall": self.retract, "update": self.update, "unload": self.unload, "register_prefix": self.register_prefix, "unregister_prefix": self.unregister_prefix}[action](*args)

    def changed_graphs(self) -> list[str]:
        """Graphs whose digest isn't that of when they were last cleared; one job for all. As many names are given as graphs changed."""
        known = self.store.spark.createDataFrame([(g, d["md5"]) for g, d in self.files.items() if "md5" in d], "g string, known string")
        now = statistics.graph_md5(self.store.quads).join(known, "g", "left")
        return [r["g"] for r in now.where(~F.col("md5").eqNullSafe(F.col("known"))).select("g").orderBy("g").toLocalIterator()]


def visible_rows(state):
    return state.quads.where("died is null").select(*ROW)


def _minus(a, b, keep: str = "left_anti"):
    x, y = a.alias("x"), b.select(*ROW).alias("y")
    return x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ROW], keep)
