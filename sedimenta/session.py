"""Sessions: isolated views and settings, expiry, prepared statements, tickets, catalog.

An ``Engine`` holds one storage root.  Every session is a new Spark session of
the same context, so temporary views are its own.  Names that are no view are
looked up as datasets below the root when a statement first names them.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sedimenta.cache import FilterCache
from sedimenta.config import Settings
from sedimenta.errors import BudgetExceeded, EngineError, QueryError, SessionLost
from sedimenta.functions.rewrite import prepare, rewrite
from sedimenta.metrics import Metrics
from sedimenta.sources.dataset import Dataset, datasets

_VIEW = re.compile(r"\s*create\s+(or\s+replace\s+)?(temp(orary)?\s+)?view\b", re.I)


@dataclass
class _Held:
    spark: SparkSession
    opened: float
    used: float
    registered: set = field(default_factory=set)
    prepared: dict = field(default_factory=dict)
    tickets: dict = field(default_factory=dict)


class Engine:
    """Sessions over the datasets of one storage root."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, clock=time.time):
        self.spark, self.root, self.settings, self.clock = spark, root.rstrip("/"), settings or Settings(), clock
        self.metrics = Metrics()
        self._held: dict[str, _Held] = {}
        self._lock = threading.RLock()
        self._draining = False
        self._filters: dict[str, FilterCache] = {}
        self.metrics.gauges = {
            "memory_bytes": lambda: self.settings.memory,
            "session_share_bytes": lambda: self.settings.memory * self.settings.session_share // 100,
            "filter_cache_limit_bytes": lambda: self._cache_limit,
            "filter_cache_bytes": lambda: sum(c.bytes for c in list(self._filters.values())),
            "filter_cache_entries": lambda: sum(len(c.kept) for c in list(self._filters.values())),
            "filter_cache_hits": lambda: sum(c.hits + c.narrowed for c in list(self._filters.values())),
            "filter_cache_misses": lambda: sum(c.misses for c in list(self._filters.values())),
        }
        self.metrics.ready = True

    # filters

    @property
    def _cache_limit(self) -> int:
        return self.settings.memory * self.settings.cache_share // 100

    def filtered(self, name: str, *predicates: str) -> DataFrame:
        """A dataset's rows by SQL predicates, from kept rows of fewer predicates where there are any.

        All datasets together keep no more than the cache's share of memory;
        ``forget`` frees what is kept of one, as after an ingest.
        """
        with self._lock:
            if name not in self._filters:
                if name not in datasets(self.spark, self.root):
                    raise QueryError(f"no dataset {name!r}")
                self._filters[name] = FilterCache(Dataset.open(self.spark, f"{self.root}/{name}").frame())
            cache = self._filters[name]
            cache.limit = self._cache_limit - sum(c.bytes for c in self._filters.values() if c is not cache)
            return cache.where(*predicates)

    def forget(self, name: str) -> None:
        with self._lock:
            if cache := self._filters.pop(name, None):
                cache.clear()

    # sessions

    def open(self) -> str:
        if self._draining:
            raise EngineError("the engine is shutting down")
        now, token = self.clock(), uuid.uuid4().hex
        with self._lock:
            self._held[token] = _Held(prepare(self.spark.newSession()), now, now)
        return token

    def resolve(self, token: str) -> _Held:
        self.sweep()
        with self._lock:
            held = self._held.get(token)
            if held is None:
                raise SessionLost("session not found or expired")
            held.used = self.clock()
            return held

    def sweep(self) -> int:
        """Drop sessions idle or open for too long, and tickets never fetched; returns how many sessions went."""
        now, s = self.clock(), self.settings
        with self._lock:
            gone = [t for t, h in self._held.items() if now - h.used > s.idle_seconds or now - h.opened > s.age_seconds]
            for t in gone:
                self._release(self._held.pop(t))
            for h in self._held.values():
                h.tickets = {k: v for k, v in h.tickets.items() if now - v[1] <= s.ticket_seconds}
            return len(gone)

    def close(self, token: str) -> None:
        """Free a session; closing one that is gone is no error."""
        with self._lock:
            held = self._held.pop(token, None)
        if held:
            self._release(held)

    @staticmethod
    def _release(held: _Held) -> None:
        for t in held.spark.catalog.listTables():
            if t.isTemporary:
                held.spark.catalog.dropTempView(t.name)

    @property
    def sessions(self) -> int:
        return len(self._held)

    def drain(self, seconds: float = 30) -> None:
        """Refuse new sessions, wait for running statements, drop all sessions."""
        self._draining, self.metrics.ready = True, False
        until = time.time() + seconds
        tracker = self.spark.sparkContext.statusTracker()
        while tracker.getActiveJobsIds() and time.time() < until:
            time.sleep(0.1)
        for t in list(self._held):
            self.close(t)
        for name in list(self._filters):
            self.forget(name)

    def lease(self) -> Lease:
        return Lease(self)

    # statements

    def plan(self, sql: str, token: str | None = None, args: dict | None = None) -> DataFrame:
        """The statement as a lazy DataFrame of the session, or of one made for it alone; ``args`` are its named parameters."""
        if token is None and _VIEW.match(sql):
            raise QueryError("a view needs a session")
        held = self.resolve(token) if token else _Held(prepare(self.spark.newSession()), 0, 0)
        text = rewrite(sql)
        for name in datasets(self.spark, self.root):
            if re.search(rf"\b{re.escape(name)}\b", text, re.I) and name not in held.registered and not held.spark.catalog.tableExists(name):
                self._bind(held, name)
        for _ in range(64):  # each round resolves one name
            try:
                df = held.spark.sql(text, args) if args else held.spark.sql(text)
                self._admit(df)
                return df
            except AnalysisException as e:
                name = _missing(e)
                if not name or name in held.registered or name not in datasets(self.spark, self.root):
                    raise QueryError(str(e).split("\n")[0]) from e
                self._bind(held, name)
        raise QueryError("too many names")

    def _bind(self, held: _Held, name: str) -> None:
        Dataset.open(held.spark, f"{self.root}/{name}").register(name)
        held.registered.add(name)

    def _admit(self, df: DataFrame) -> None:
        """Refuse to hand out whole stored rows of more bytes than the session's share.

        That is known before running only of plans that read and project
        without choosing rows; others may be small whatever they read, and spill.
        """
        share = self.settings.memory * self.settings.session_share // 100
        plan = df._jdf.queryExecution().optimizedPlan()
        size = int(str(plan.stats().sizeInBytes()))
        if size > share and _kinds(plan) <= {"Project", "LogicalRelation", "Union"}:
            raise BudgetExceeded(f"about {size} bytes; the session's share is {share}")

    def run(self, sql: str, token: str | None = None, args: dict | None = None):
        """The statement's result as a pyarrow Table."""
        began = time.perf_counter()
        try:
            out = self.plan(sql, token, args).toArrow()
        except Exception as e:
            self.metrics.record(sql, time.perf_counter() - began, None, type(e).__name__)
            raise
        self.metrics.record(sql, time.perf_counter() - began, out.num_rows)
        return out

    def ticket(self, sql: str, token: str) -> str:
        """Plan now, fetch once later."""
        df, name = self.plan(sql, token), uuid.uuid4().hex
        self.resolve(token).tickets[name] = (df, self.clock())
        return name

    def fetch(self, ticket: str, token: str):
        found = self.resolve(token).tickets.pop(ticket, None)
        if found is None:
            raise QueryError("unknown or used ticket")
        return found[0].toArrow()

    def prepare(self, sql: str, token: str) -> str:
        """Keep a statement that parses, and, if it has no parameters, can be planned."""
        name = uuid.uuid4().hex
        try:
            self.plan(sql, token)
        except QueryError as e:
            if getattr(e.__cause__, "getCondition", str)() != "UNBOUND_SQL_PARAMETER":
                raise
        self.resolve(token).prepared[name] = sql
        return name

    def execute(self, statement: str, token: str, args: dict | None = None):
        sql = self.resolve(token).prepared.get(statement)
        if sql is None:
            raise QueryError("unknown statement")
        return self.run(sql, token, args)

    def close_statement(self, statement: str, token: str) -> None:
        self.resolve(token).prepared.pop(statement, None)

    # catalog

    def tables(self, token: str | None = None) -> DataFrame:
        """(catalog, schema, name, kind): datasets, and the session's views, which hide datasets of their name."""
        held = self.resolve(token) if token else None
        views = [t.name for t in held.spark.catalog.listTables() if t.isTemporary and t.name not in held.registered] if held else []
        rows = [("sedimenta", "public", n, "TABLE") for n in datasets(self.spark, self.root) if n not in views]
        rows += [("sedimenta", "public", v, "VIEW") for v in views]
        return self.spark.createDataFrame(rows, "catalog string, schema string, name string, kind string")

    def columns(self, name: str) -> DataFrame:
        """(name, type, kind, scale, nullable) of a dataset's fields."""
        d = Dataset.open(self.spark, f"{self.root}/{name}")
        kinds = dict(d.frame().dtypes)
        return self.spark.createDataFrame([(f.name, kinds[f.name], f.kind, f.scale, f.nullable) for f in d.schema.fields], "name string, type string, kind string, scale int, nullable boolean")

    def catalogs(self) -> DataFrame:
        return self.spark.createDataFrame([("sedimenta",)], "catalog string")

    def schemas(self) -> DataFrame:
        return self.spark.createDataFrame([("sedimenta", "public")], "catalog string, schema string")

    def table_types(self) -> DataFrame:
        return self.spark.createDataFrame([("TABLE",), ("VIEW",)], "kind string")

    def info(self) -> DataFrame:
        """(name, value): what the dialect is."""
        from sedimenta import __version__

        rows = {"server": "sedimenta", "version": __version__, "identifier_quote": '"', "identifier_case": "insensitive", "read_only": "true", "transactions": "false", "spark": self.spark.version}
        return self.spark.createDataFrame(list(rows.items()), "name string, value string")


class Lease:
    """A session that is opened anew, once a statement, if it has expired meanwhile; closed for good by its holder only."""

    def __init__(self, engine: Engine):
        self.engine, self.token, self.ended = engine, engine.open(), False

    def held(self) -> str:
        """The token of a session that is alive."""
        if self.ended:
            raise SessionLost("the session is closed")
        try:
            self.engine.resolve(self.token)
        except SessionLost:
            self.token = self.engine.open()
        return self.token

    def end(self) -> None:
        if not self.ended:
            self.engine.close(self.token)
        self.ended = True


def _kinds(plan) -> set[str]:
    """Class names of a logical plan's nodes."""
    found = {str(plan.getClass().getSimpleName())}
    children = plan.children()
    for i in range(children.size()):
        found |= _kinds(children.apply(i))
    return found


def _missing(e: AnalysisException) -> str | None:
    """Name of the relation that a statement could not be planned for want of."""
    if e.getCondition() not in ("TABLE_OR_VIEW_NOT_FOUND",):
        return None
    name = (e.getMessageParameters() or {}).get("relationName", "")
    return name.replace("`", "").split(".")[-1] or None
