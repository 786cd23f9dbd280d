"""A whole refresh: the layer with its checks, then every result table, as a graph of jobs.

``refresh_layer`` writes the canonical inputs into a new folder. While they are written, metrics
are observed; a broken expectation stops the refresh before the commit, so the old layer stays.
Two of the data-quality statements (A8, A40) are among the metrics and need no scan of their own.

``refresh_results`` finds out which shared tables each table reads, by planning it once, and runs
whatever has its inputs, several jobs at a time in pools of their own. A failed table stops only
those that read it.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.model import CART, PRODUCT_VIEW, PURCHASE, SHARED, Model
from tillroll.plans.versions import VersionLog, read_table
from tillroll.sources.canonical import load_layer

#: Statements whose result the layer's metrics give.
OBSERVED = frozenset({"dq_product_event_identity", "dq_null_event_users"})


@dataclass(frozen=True)
class Expectation:
    """What must hold for a table of the layer: an aggregate within bounds (NULL, as over no rows,
    passes)."""

    table: str
    name: str
    measure: Column
    at_least: float | None = None
    at_most: float | None = None

    def holds(self, value) -> bool:
        return value is None or ((self.at_least is None or value >= self.at_least)
                                 and (self.at_most is None or value <= self.at_most))


class BrokenExpectation(ValueError):
    """The layer that was written doesn't become the current one."""


def share(cond: Column) -> Column:
    """The share of rows for which ``cond`` holds."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("int"))


def standard_expectations(max_unknown: float = 0.9) -> list[Expectation]:
    """Keys are there, prices aren't negative, and not nearly all users, times or types are unknown."""
    return [
        Expectation("order_items", "items without an order", share(F.col("order_id").isNull()), at_most=0),
        Expectation("order_items", "items with a negative price", share(F.col("sale_price") < 0), at_most=0),
        Expectation("order_items", "items without a time", share(F.col("created_at").isNull()), at_most=max_unknown),
        Expectation("order_items", "items without a user", share(F.col("user_id").isNull()), at_most=max_unknown),
        Expectation("products", "products without a key", share(F.col("id").isNull()), at_most=0),
        Expectation("users", "users without a key", share(F.col("id").isNull()), at_most=0),
        Expectation("events", "events without a type", share(F.col("event_type").isNull()), at_most=max_unknown),
        Expectation("events", "events without a time", share(F.col("created_at").isNull()), at_most=max_unknown)]


def _statement_metrics() -> dict[str, dict[str, Column]]:
    """A8 and A40 as aggregates over the events."""
    kind, user = F.col("event_type"), F.col("user_id")
    return {"dq_product_event_identity": {
                "total_users": F.count_if(kind == PRODUCT_VIEW),
                "non_null_user_events": F.count_if((kind == PRODUCT_VIEW) & user.isNotNull())},
            "dq_null_event_users": {
                "total_events": F.count_if(kind.isin(PRODUCT_VIEW, CART, PURCHASE)),
                "null_user_events": F.count_if(kind.isin(PRODUCT_VIEW, CART, PURCHASE) & user.isNull())}}


@dataclass
class Layer:
    model: Model
    folder: str
    #: table -> metric -> value
    observed: dict[str, dict[str, object]] = field(default_factory=dict)


def refresh_layer(model: Model, root: str, expectations: list[Expectation] | None = None, keep: int = 2) -> Layer:
    """Writes the model's canonical inputs as the next version of the layer at ``root``.

    Metrics are observed behind the last shuffle, in the tasks that write, where each row counts
    once however often tasks run again. The four tables become current together, by one commit,
    and only if every expectation holds."""
    from tillroll.plans.warehouse import PARTITIONED, layer_frames

    spark = model.order_items.sparkSession
    expectations = standard_expectations() if expectations is None else expectations
    log = VersionLog(spark, root)
    folder = log.new_folder()
    observed: dict[str, dict[str, object]] = {}
    for name, df in layer_frames(model).items():
        metrics = {"rows": F.count(F.lit(1))}
        metrics |= {f"expect {i}": e.measure for i, e in enumerate(expectations) if e.table == name}
        if name == "events":
            metrics |= {f"{key}.{c}": m for key, own in _statement_metrics().items() for c, m in own.items()}
        seen = Observation(f"layer {name}")
        df.observe(seen, *[m.alias(n) for n, m in metrics.items()]).write.partitionBy(
            *PARTITIONED.get(name, [])).parquet(f"{folder}/{name}")
        observed[name] = dict(seen.get)
    broken = [f"{e.table}: {e.name} is {value}, not within [{e.at_least}, {e.at_most}]"
              for i, e in enumerate(expectations) if not e.holds(value := observed[e.table][f"expect {i}"])]
    if broken:
        raise BrokenExpectation("; ".join(broken))
    log.commit({"folders": [folder], "observed": {t: {k: _plain(v) for k, v in own.items()} for t, own in observed.items()}})
    log.expire(keep)
    return current_layer(spark, root, model)


def _plain(value):
    return value if isinstance(value, (int, float, str, type(None))) else float(value)


def current_layer(spark: SparkSession, root: str, like: Model | None = None) -> Layer:
    """The newest version of the layer at ``root``; A8 and A40 come from its metrics."""
    commit = VersionLog(spark, root).latest()
    if commit is None:
        raise FileNotFoundError(f"{root}: no version was committed")
    folder, observed = commit.entry["folders"][0], commit.entry["observed"]
    model = Model(load_layer(spark, folder), **({"status_policy": like.status_policy} if like else {}))
    for key, metrics in _statement_metrics().items():
        values = [observed["events"][f"{key}.{c}"] or 0 for c in metrics]
        model.use(key, spark.createDataFrame([tuple(values)], T.StructType([T.StructField(c, T.LongType()) for c in metrics])))
    return Layer(model, folder, observed)


# result tables ------------------------------------------------------------------------

class _Probe(Model):
    """A model that notes which shared tables are asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.sources, model.status_policy, model._layer)
        self.asked: set[str] = set()
        self._depth = 0

    def _get(self, name: str, build):
        if name.startswith("shared:"):
            if not self._depth:
                self.asked.add(name.removeprefix("shared:"))
            self._depth += 1
            try:
                return super()._get(name, build)
            finally:
                self._depth -= 1
        return super()._get(name, build)


def reads(model: Model, operator: Callable[[Model], DataFrame], own: str | None = None) -> set[str]:
    """The shared tables that an operator reads directly."""
    probe = _Probe(model)
    operator(probe)
    if own:  # a shared operator asks for itself first; what its body asks for lies below
        probe = _Probe(model)
        probe._layer.pop(f"shared:{own}", None)
        probe._depth = -1
        operator(probe)
    return probe.asked - {own}


@dataclass
class Outcome:
    written: dict[str, str] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)

    def paths(self) -> dict[str, str]:
        if self.failed:
            raise RuntimeError(f"failed: {self.failed}; not run, as they read those: {self.skipped}")
        return self.written


def _graph(model: Model, keys: list[str], shared: list[str], workers: int) -> dict[str, set[str]]:
    """Which shared tables each job waits for, by planning every table once."""
    from tillroll.registry import MAINTAINED, QUERIES

    def needs_of(node: str) -> tuple[str, set[str]]:
        kind, name = node.split(":", 1)
        try:
            if kind == "shared":
                return node, reads(model, SHARED[name], name) - OBSERVED
            return node, set() if name in MAINTAINED else reads(model, QUERIES[name]) - OBSERVED
        except AnalysisException:  # it fails again, by itself, when its job runs
            return node, set()

    needs: dict[str, set[str]] = {}
    todo = [f"key:{k}" for k in keys] + [f"shared:{n}" for n in shared]
    with ThreadPoolExecutor(workers) as pool:
        while todo:
            needs |= dict(pool.map(needs_of, todo))
            todo = sorted({f"shared:{n}" for own in needs.values() for n in own} - set(needs))
    return needs


def _run(needs: dict[str, set[str]], job: Callable[[str], None], workers: int) -> tuple[dict[str, str], dict[str, str]]:
    """Runs every node after those it waits for. Returns (failed nodes and why, nodes that were not run and
    what they would have read)."""
    failed, skipped, done = {}, {}, set()
    readers = {f"shared:{n}": 0 for own in needs.values() for n in own}
    for own in needs.values():
        for n in own:
            readers[f"shared:{n}"] += 1
    # what most others wait for goes first
    waiting = dict(sorted(needs.items(), key=lambda x: -readers.get(x[0], 0)))
    running: dict = {}
    with ThreadPoolExecutor(workers) as pool:
        while waiting or running:
            for node, own in list(waiting.items()):
                lost = next((n for n in own if f"shared:{n}" in failed or f"shared:{n}" in skipped), None)
                if lost:
                    skipped[node] = lost
                    del waiting[node]
                elif all(f"shared:{n}" in done for n in own) and len(running) < workers:
                    running[pool.submit(job, node)] = node
                    del waiting[node]
            if running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    node = running.pop(f)
                    if f.exception() is None:
                        done.add(node)
                    else:
                        failed[node] = str(f.exception())[:500]
    return failed, skipped


def refresh_results(model: Model, root: str, keys: list[str] | None = None, database: str | None = None,
                    workers: int = 8, shared: list[str] | None = None) -> Outcome:
    """Writes the result tables ``keys`` (all by default) and the shared tables that they read (and
    those named in ``shared``), up to ``workers`` jobs at a time. Every table is replaced by itself:
    what failed or was not run keeps its old rows."""
    from tillroll.plans.warehouse import write_catalog_table, write_table
    from tillroll.registry import QUERIES, run_query

    spark = model.order_items.sparkSession
    keys = list(QUERIES) if keys is None else keys
    for name in set(SHARED) - OBSERVED:
        model.use(name, None)
    needs = _graph(model, keys, shared or [], workers)

    def job(node: str) -> None:
        kind, name = node.split(":", 1)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", node)
        if kind == "shared":
            path = f"{root}/_shared/{name.lstrip('_')}"
            write_table(SHARED[name](model), path)
            model.use(name, read_table(spark, path))
        elif database:
            write_catalog_table(run_query(name, model), database, name, f"{root}/{name}")
        else:
            write_table(run_query(name, model), f"{root}/{name}")

    failed, skipped = _run(needs, job, workers)
    written = {k: f"{root}/{k}" for k in keys if f"key:{k}" not in failed and f"key:{k}" not in skipped}
    return Outcome(written, failed, skipped)
