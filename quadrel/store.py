"""A versioned store of quads: writes, transactions, snapshots, graphs and predicates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators import closure, patterns, statistics
from quadrel.schema import DEFAULT_GRAPH, LITERAL, QUADS, TRIPLE, quads_frame, visible
from quadrel.storage import materialize

ROW = [*TRIPLE, "g", "line"]
COLUMNS = [c.strip().split()[0] for c in QUADS.split(",")]
LOG = "generation bigint, event string, " + ", ".join(f"{c.strip()}" for c in QUADS.split(",")[:8]) + ", field string, new_value string"


KEY = [*ROW, "born"]
#: So many commits' delta files are kept apart; then they are written together, without the base.
MANY_DELTAS = 16
NET = ("retract", "assert", "update")


@dataclass(frozen=True)
class State:
    """``quads`` is what is seen, the open transaction's writes included: the base, the rows born after it, and the ends of rows that died after it."""

    quads: DataFrame
    generation: int = 0
    graphs: dict = field(default_factory=dict)
    predicates: dict = field(default_factory=dict)
    base: DataFrame | None = None
    born: tuple = ()
    dead: tuple = ()


def merged(base: DataFrame, born: tuple, dead: tuple) -> DataFrame:
    """The rows of a base and its deltas. Ends of rows are small tables of (row, born, died), joined when they are read; filters on the
    row's columns go through the join to the scan."""
    rows = reduce(DataFrame.unionByName, born, base)
    if not dead:
        return rows
    ends = reduce(DataFrame.unionByName, dead).select(*[F.col(c).alias(f"_k_{c}") for c in KEY], F.col("died").alias("_died")).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in KEY]
    return rows.join(ends, on, "left").select(*[F.coalesce("died", "_died").alias("died") if c == "died" else F.col(c) for c in COLUMNS])


@dataclass(frozen=True)
class Snapshot:
    """The store as it was; within the transaction it was taken in only if ``owner`` is set."""

    state: State
    owner: object = None


class Store:
    """Quads with the generations they are born and die in. Every write makes a new state from the old; a transaction's writes become visible
    together, under one generation, or not at all. Frames read before a write keep showing what they showed.

    A write is an anti join or a conditional column over the quads. When the outermost transaction commits, only the rows born and the ends of the
    rows that died are written to the shared folder; ``compact`` writes a new base. So a commit costs what it changes, and states share the rest."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None) -> None:
        self.spark = spark
        rows = spark.createDataFrame([], QUADS) if quads is None else quads.select(*COLUMNS)
        top = 0 if quads is None else rows.agg(F.greatest(F.coalesce(F.max("born"), F.lit(0)), F.coalesce(F.max("died"), F.lit(0)))).collect()[0][0]
        self.state = State(rows, top or 0, base=rows)
        self.deltas: dict[int, DataFrame] = {}
        self.killed = False
        self.lookups: Counter = Counter()
        self.stack: list[tuple[object, State]] = []
        self.updates: list[DataFrame] = []
        self.monitors: list[tuple[Callable[[DataFrame], None], set[str] | None]] = []
        self.snapshots: list[Snapshot] = []
        #: Further properties of graphs: name -> function of (store, graph).
        self.graph_hooks: dict[str, Callable[[Store, str], object]] = {}

    # Reading.

    @property
    def quads(self) -> DataFrame:
        """The quads visible now, the open transaction's writes included."""
        return visible(self.state.quads)

    @property
    def generation(self) -> int | tuple[int, int]:
        """The generation; within transactions (outer generation, depth)."""
        return (self.stack[0][1].generation, len(self.stack)) if self.stack else self.state.generation

    def inverses(self) -> dict[str, str]:
        return {p: d["inverse_of"] for p, d in self.state.predicates.items() if d.get("inverse_of")}

    def _looked(self, **bound) -> None:
        self.lookups["".join(k for k, v in bound.items() if v is not None) or "-"] += 1

    def lookup_counts(self) -> DataFrame:
        """How many patterns were asked for by the places that were bound: index (as ``sp``; ``-`` for none), n."""
        return self.spark.createDataFrame(sorted(self.lookups.items()), "index string, n int")

    def triples(self, s=None, p=None, o=None, **more) -> DataFrame:
        self._looked(s=s, p=p, o=o)
        return patterns.triples(self.quads, s, p, o, **more)

    def statements(self, s=None, p=None, o=None, g=None, **more) -> DataFrame:
        self._looked(s=s, p=p, o=o, g=g)
        return patterns.statements(self.quads, s, p, o, g, **more)

    def has(self, s=None, p=None, o=None, real: bool = False) -> DataFrame:
        return closure.has(self.quads, s, p, o, self.inverses(), real)

    def reachable(self, start=None, p=None, target=None, max_depth=None) -> DataFrame:
        return closure.reachable(self.quads, start, p, target, max_depth, self.inverses())

    # Writing.

    def _frame(self, rows) -> DataFrame:
        if isinstance(rows, list):
            rows = quads_frame(self.spark, rows)
        g = F.coalesce("g", F.lit(DEFAULT_GRAPH)) if "g" in rows.columns else F.lit(DEFAULT_GRAPH)
        line = F.col("line") if "line" in rows.columns else F.lit(None)
        return rows.select(*TRIPLE, g.alias("g"), line.cast("int").alias("line")).distinct()

    def _new(self) -> int:
        return (self.stack[0][1].generation if self.stack else self.state.generation) + 1

    def _set(self, quads: DataFrame) -> None:
        self.state = replace(self.state, quads=quads)

    def insert(self, rows) -> None:
        """Adds statements (a frame or a list as for ``quads_frame``); one that is there, graph and line included, changes nothing."""
        with self.transaction():
            fresh, live = self._frame(rows), self.quads.select(*ROW)
            if isinstance(rows, list):  # few: of the store only the same subjects' statements are joined
                live = live.join(F.broadcast(fresh.select("s").distinct()), "s", "left_semi").select(*ROW)
            fresh, live = fresh.alias("n"), live.alias("h")
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ROW]
            added = fresh.join(live, same, "left_anti").withColumn("born", F.lit(self._new()).cast("bigint")).withColumn("died", F.lit(None).cast("bigint"))
            self._set(self.state.quads.unionByName(added.select(*COLUMNS)))

    def _hit(self, s, p, o, g):
        hit = F.col("died").isNull()
        for c, v in (("s", s), ("p", p), ("g", g)):
            if v is not None:
                hit = hit & (F.col(c) == v)
        return F.coalesce(hit & (patterns.object_is(o) if o is not None else F.lit(True)), F.lit(False))

    def retract(self, s=None, p=None, o=None, g=None) -> None:
        """Takes away all statements that match; a ``Match`` as object takes away what it finds."""
        with self.transaction():
            self.killed = True
            self._set(self.state.quads.withColumn("died", F.when(self._hit(s, p, o, g), F.lit(self._new())).otherwise(F.col("died"))))

    def retract_rows(self, rows: DataFrame) -> None:
        """Takes away the statements given, graph and line included."""
        with self.transaction():
            self.killed = True
            ends = rows.select(*[F.col(c).alias(f"_k_{c}") for c in ROW]).distinct().withColumn("_hit", F.lit(True))
            marked = self.state.quads.join(ends, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ROW], "left")
            died = F.when(F.col("died").isNull() & F.col("_hit"), F.lit(self._new())).otherwise(F.col("died"))
            self._set(marked.select(*[died.alias("died") if c == "died" else F.col(c) for c in COLUMNS]))

    def update(self, place: str, value: str, s=None, p=None, o=None, g=None, **qualifiers) -> None:
        """Replaces one place (subject, predicate, object, graph) of all statements that match; an object may come with o_kind, o_dt and
        o_lang. The same value is no change."""
        column = {"subject": "s", "predicate": "p", "object": "o", "graph": "g"}[place]
        with self.transaction():
            self.killed = True
            same = F.col(column) == value
            for k, v in qualifiers.items():
                same = same & F.col(k).eqNullSafe(F.lit(v))
            hit = self._hit(s, p, o, g) & ~F.coalesce(same, F.lit(False))
            old = self.state.quads.where(hit)
            new = old.withColumn(column, F.lit(value)).withColumns({k: F.lit(v).cast(dict(old.dtypes)[k]) for k, v in qualifiers.items()})
            self.updates.append(old.select(*ROW, F.lit(place).alias("field"), F.lit(value).alias("new_value")))
            self._set(self.state.quads.withColumn("died", F.when(hit, F.lit(self._new())).otherwise(F.col("died"))))
            self.insert(new.select(*ROW))

    # Transactions and snapshots.

    @contextmanager
    def transaction(self, name: object = None, snapshot: Snapshot | bool | None = None) -> Iterator[Store]:
        """All or nothing; nested ones join the outer one's generation. On a snapshot (True: one of now) reads are of then and writes are
        discarded at the end. An error discards the writes and goes on to the caller."""
        before, noted = self.state, len(self.updates)
        owner = object()
        self._notify("transaction_begin", str(name), len(self.stack))
        if snapshot is True:
            snapshot = Snapshot(before)
        if isinstance(snapshot, Snapshot) and snapshot.owner is not None and snapshot.owner not in [o for o, _, *_ in self._owners()]:
            raise ValueError("this snapshot belongs to a transaction that is over")
        self.stack.append((name, before))
        self._owner_list = [*self._owners(), (owner,)]
        if snapshot:
            self.state = snapshot.state
        done = False
        try:
            yield self
            done = not snapshot
        finally:
            self.stack.pop()
            self._owner_list = self._owners()[:-1]
            if not done:
                self.state = before
                del self.updates[noted:]
            elif not self.stack:
                self._commit(before)
            if not self.stack:
                self.killed = False
            self._notify("transaction_end", str(name), len(self.stack))

    _owner_list: list = []

    def _owners(self) -> list:
        return list(self._owner_list)

    def _commit(self, before: State) -> None:
        if self.state.quads is before.quads:
            self.updates.clear()
            return
        generation = before.generation + 1
        changed = F.col("born") == generation
        if self.killed:
            changed = changed | (F.col("died") == generation)
        # Rows born and gone within the transaction were never visible.
        delta = materialize(self.state.quads.where(changed & (F.col("died").isNull() | (F.col("born") < F.col("died")))))
        born, dead = (*before.born, delta.where(F.col("born") == generation)), before.dead
        if self.killed:
            dead = (*dead, delta.where(F.col("born") < generation).select(*KEY, "died"))
        if len(born) > MANY_DELTAS:
            born = (materialize(reduce(DataFrame.unionByName, born)),)
            dead = (materialize(reduce(DataFrame.unionByName, dead)),) if dead else ()
        self.deltas[generation] = delta
        self.state = replace(self.state, quads=merged(before.base, born, dead), generation=generation, base=before.base, born=born, dead=dead)
        if self.monitors:
            events = self.changes(generation)
            for call, mask in self.monitors:
                wanted = sorted(mask & set(NET))
                parts = [events.where(F.col("event").isin(wanted))] if wanted else []
                parts += [self._literals(generation, kind) for kind in ("new_literal", "old_literal") if kind in mask]
                if parts:
                    call(reduce(DataFrame.unionByName, parts))
        self.updates.clear()

    def _literals(self, generation: int, event: str) -> DataFrame:
        """Literals that come with a generation, or that no statement holds any more after it: their places for subject, predicate and graph are null."""
        term = ["o", "o_kind", "o_dt", "o_lang"]
        changed = self.deltas[generation].where(F.col("o_kind") == LITERAL)
        if event == "new_literal":
            there = visible(self.state.quads, generation - 1)
            found = changed.where((F.col("born") == generation) & F.col("died").isNull()).select(*term).distinct()
        else:
            there = visible(self.state.quads, generation)
            found = changed.where(F.col("died") == generation).select(*term).distinct()
        held = there.where(F.col("o_kind") == LITERAL).select(*[F.col(c).alias(f"_h_{c}") for c in term])
        found = found.join(held, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in term], "left_anti")
        return self._events(found, generation, event)

    @staticmethod
    def _events(rows: DataFrame, generation: int, event: str) -> DataFrame:
        kinds = {"o_kind": "tinyint", "line": "int"}
        place = [F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ROW]
        none = F.lit(None).cast("string")
        return rows.select(F.lit(generation).cast("bigint").alias("generation"), F.lit(event).alias("event"), *place, none.alias("field"), none.alias("new_value"), F.lit(3).alias("step"))

    def _notify(self, event: str, name: str, depth: int = 0) -> None:
        """Tells monitors that ask for it by name of something that changes no statement: its name as subject, the depth of nesting as line."""
        for call, mask in self.monitors:
            if event in mask:
                call(self._events(self.spark.createDataFrame([(name, depth)], "s string, line int"), self.state.generation, event))

    def changes(self, generation: int) -> DataFrame:
        """The net changes of a generation, in the order retract, assert, update (column ``step``): what came and went within it doesn't show.
        Of an update the old statement is given with the field and its new value."""
        now = self.deltas.get(generation, self.state.quads)
        gone, come = now.where(F.col("died") == generation).select(*ROW), now.where((F.col("born") == generation) & F.col("died").isNull()).select(*ROW)
        none = F.lit(None).cast("string")
        plain = lambda rows, event, step: rows.select(F.lit(generation).cast("bigint").alias("generation"), F.lit(event).alias("event"), *ROW, none.alias("field"), none.alias("new_value"), F.lit(step).alias("step"))
        out = None
        for u in self.updates:
            column = F.create_map(*[F.lit(x) for x in ("subject", "s", "predicate", "p", "object", "o", "graph", "g")])[F.col("field")]
            netted = _null_safe(u, gone, "left_semi")
            new = netted.select(*[F.when(column == c, F.col("new_value")).otherwise(F.col(c)).alias(c) if c in ("s", "p", "o", "g") else F.col(c) for c in ROW])
            gone, come = _null_safe(gone, netted.select(*ROW), "left_anti"), _null_safe(come, new, "left_anti")
            part = netted.select(F.lit(generation).cast("bigint").alias("generation"), F.lit("update").alias("event"), *ROW, "field", "new_value", F.lit(2).alias("step"))
            out = part if out is None else out.unionByName(part)
        rows = plain(gone, "retract", 0).unionByName(plain(come, "assert", 1))
        return rows if out is None else rows.unionByName(out)

    def monitor(self, call: Callable[[DataFrame], None], *mask: str) -> None:
        """``call`` gets the net changes of every outermost commit, and what else it asks for. ``mask``: names of events, each may have + or -; ``all``, or
        no mask, stands for the net changes (assert, retract, update). By name only: new_literal and old_literal (literals that come into use or fall
        out of it, which needs a look at the whole store), transaction_begin, transaction_end, load_begin, load_end, create_graph, reset."""
        wanted = set(NET) if not mask or any(m.lstrip("+") == "all" or m.startswith("-") for m in mask) else set()
        for m in mask:
            if m.startswith("-"):
                wanted.discard(m[1:])
            elif m.lstrip("+") != "all":
                wanted.add(m.lstrip("+"))
        self.monitors.append((call, wanted))

    def active_transactions(self) -> list:
        """Names, innermost first."""
        return [name for name, _ in reversed(self.stack)]

    def snapshot(self) -> Snapshot:
        s = Snapshot(self.state, self._owners()[-1][0] if self.stack else None)
        self.snapshots.append(s)
        return s

    def delete_snapshot(self, s: Snapshot) -> None:
        self.snapshots.remove(s)

    # Graphs and predicates.

    def create_graph(self, g: str) -> None:
        if g not in self.state.graphs:
            self._notify("create_graph", g)
        self.state = replace(self.state, graphs={g: {}, **self.state.graphs})

    def set_graph(self, g: str, **properties) -> None:
        self.state = replace(self.state, graphs={**self.state.graphs, g: {**self.state.graphs.get(g, {}), **properties}})

    def unload_graph(self, g: str) -> None:
        self.retract(g=g)
        self.state = replace(self.state, graphs={k: v for k, v in self.state.graphs.items() if k != g})

    def graphs(self) -> DataFrame:
        """All graphs with their triples, created empty ones too: g, triples."""
        named = self.spark.createDataFrame([(g,) for g in self.state.graphs], "g string")
        return named.join(statistics.by_graph(self.quads), "g", "full").select("g", F.coalesce("triples", F.lit(0)).alias("triples"))

    def load(self, rows, g: str, source: str | None = None, modified: str | None = None, multifile: bool = False) -> None:
        """Puts the statements of a source into graph ``g``, in place of what was there unless ``multifile``."""
        frame = self._frame(rows)
        self._notify("load_begin", g)
        with self.transaction(("load", g)):
            if not multifile:
                self.retract(g=g)
            self.insert(frame.withColumn("g", F.lit(g)))
        digest = self.graph_md5(g)
        self.set_graph(g, source=source, source_last_modified=modified, loaded_md5=digest)
        self._notify("load_end", g)

    def graph_md5(self, g: str) -> str:
        row = statistics.graph_md5(self.quads.where(F.col("g") == g)).collect()
        return row[0]["md5"] if row else "0" * 32

    def graph_properties(self, g: str) -> dict:
        known = self.state.graphs.get(g, {})
        digest = self.graph_md5(g)
        return {"triples": self.quads.where(F.col("g") == g).count(), "hash": digest, "modified": digest != known.get("loaded_md5", "0" * 32), "source": known.get("source"), "source_last_modified": known.get("source_last_modified")} | {n: f(self, g) for n, f in self.graph_hooks.items()}

    def sources(self) -> dict[str, str]:
        return {g: d["source"] for g, d in self.state.graphs.items() if d.get("source")}

    def set_predicate(self, p: str, inverse_of: str | None = None, symmetric: bool | None = None, transitive: bool | None = None) -> None:
        """``symmetric`` is being one's own inverse; an inverse is set on both ends, ``inverse_of=""`` removes it."""
        known = {k: dict(v) for k, v in self.state.predicates.items()}
        mine = known.setdefault(p, {})
        if symmetric is not None:
            inverse_of = p if symmetric else ""
        if inverse_of is not None:
            if mine.get("inverse_of"):
                known.setdefault(mine["inverse_of"], {}).pop("inverse_of", None)
            mine.pop("inverse_of", None)
            if inverse_of:
                mine["inverse_of"] = inverse_of
                known.setdefault(inverse_of, {})["inverse_of"] = p
        if transitive is not None:
            mine["transitive"] = transitive
        self.state = replace(self.state, predicates=known)

    def predicate_properties(self, p: str) -> dict:
        known = self.state.predicates.get(p, {})
        own = statistics.branch_factors(self.quads.where(F.col("p") == p)).collect()
        sub = statistics.branch_factor_with_sub(self.quads, p).collect()[0]
        return {
            "symmetric": known.get("inverse_of") == p, "inverse_of": known.get("inverse_of"), "transitive": known.get("transitive", False), "triples": self.quads.where(F.col("p") == p).count(),
            "rdf_subject_branch_factor": own[0]["subject_branch_factor"] if own else 0.0, "rdf_object_branch_factor": own[0]["object_branch_factor"] if own else 0.0,
            "rdfs_subject_branch_factor": sub["subject_branch_factor"], "rdfs_object_branch_factor": sub["object_branch_factor"],
        }

    def predicates(self) -> DataFrame:
        """Predicates in use and those only registered."""
        named = self.spark.createDataFrame([(p,) for p in self.state.predicates], "p string")
        return self.quads.select("p").unionByName(named).distinct()

    # Administration.

    def reset(self) -> None:
        if self.stack:
            raise ValueError("not within a transaction")
        empty = self.spark.createDataFrame([], QUADS)
        self.state = State(empty, self.state.generation + 1, base=empty)
        self.deltas.clear()
        self._notify("reset", "")

    def compact(self) -> None:
        """Writes a new base of the rows that some snapshot can see, and drops the deltas."""
        oldest = min([s.state.generation for s in self.snapshots], default=self.state.generation)
        base = materialize(self.state.quads.where(F.col("died").isNull() | (F.col("died") > oldest)))
        self.state = replace(self.state, quads=base, base=base, born=(), dead=())
        self.deltas.clear()

    def partition_by_predicate(self, path: str, buckets: int = 64) -> None:
        """Writes the quads sorted by (p, s) within hash buckets of both, so that filters on them skip files and row groups, and a hot
        predicate is spread over all buckets."""
        rows = self.state.quads.repartition(buckets, "p", F.pmod(F.xxhash64("s"), F.lit(buckets))).sortWithinPartitions("p", "s")
        rows.write.mode("overwrite").parquet(path)


def _null_safe(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    x, y = a.alias("x"), b.select(*ROW).alias("y")
    return x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ROW], how)
