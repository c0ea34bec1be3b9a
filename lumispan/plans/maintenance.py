"""Compaction, retention, integrity and vacuum of a store. Each change is one commit; folders that it leaves behind wait for ``vacuum``."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..functions.errors import Conflict
from ..functions.schema import KEY, LOG_SCHEMA, PUBLIC, SPAN_SCHEMA, day
from ..operators import live, rollups

if TYPE_CHECKING:
    from ..sources.store import SpanStore

#: Rollup parts are merged into one when there are more.
ROLLUP_PARTS = 20
#: Rows of one file of a day.
FILE_ROWS = 2_000_000
#: Commit files that vacuum leaves.
COMMITS = 20


def _leave(store: SpanStore, state: dict, paths: list[str]) -> None:
    now = store.clock()
    state["dropped"] += [[path, now] for path in paths]


def compact(store: SpanStore, batches: int | None = None) -> int:
    """Merge the oldest ``batches`` of the log (default: all) into the base; returns the base's number of rows.

    Only days that those batches touch are written again, the others stay as they are: days of their
    live rows, and days with older rows of their keys (found by keys alone). Superseded and deleted rows
    are gone afterwards. Rollup partials stay as they are, but many small parts become one.
    """
    store._settle()
    state = json.loads(json.dumps(store.state))
    merged = state["log"] if batches is None else state["log"][:batches]
    if not merged:
        return sum(d["rows"] for d in state["base"].values())
    log = store._parquet([b["path"] for b in merged], LOG_SCHEMA)
    fresh = live.latest(log).filter(~F.col("_deleted")).groupBy("day").agg(F.count("*").alias("n"))
    rows = {str(r["day"]): r["n"] for r in fresh.collect()}  # one row a day
    touched = set(rows) & set(state["base"])
    everything = store.base(list(state["base"]))
    if everything is not None:
        small = sum(b["rows"] for b in merged) <= live.BROADCAST_KEYS
        keys = log.select(*KEY).distinct()
        hidden = everything.select(*KEY, day().alias("day")).join(F.broadcast(keys) if small else keys, KEY, "left_semi")
        touched |= {str(r["day"]) for r in hidden.select("day").distinct().collect()}
    old = store.base(sorted(touched))
    laid = live.resolve(old, log, sum(b["rows"] for b in merged)).select(*PUBLIC).withColumn("day", day())
    # a file a day and part of the traces, sorted for lookups; big days have many
    files = {d: -(-(rows.get(d, 0) + state["base"].get(d, {"rows": 0})["rows"]) // FILE_ROWS) or 1 for d in touched | set(rows)}
    parts = F.coalesce(F.create_map(*(F.lit(x) for pair in files.items() for x in pair))[F.col("day").cast("string")], F.lit(1)) if files else F.lit(1)
    laid = laid.repartition(min(sum(files.values()) or 1, 100_000), "day", F.pmod(F.xxhash64("trace_id"), parts)).sortWithinPartitions("day", "trace_id", "start_ns")
    name = f"base/{state['batch']:012d}-{uuid.uuid4().hex[:8]}"
    laid.write.mode("errorifexists").option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("day").parquet(f"{store.path}/{name}")
    days = [n[4:] for n in store.folder.names(name) if n.startswith("day=")]
    dropped = [b["path"] for b in merged] + [state["base"].pop(d)["path"] for d in sorted(touched)]
    if days:
        written = store.spark.read.schema(LOG_SCHEMA).parquet(f"{store.path}/{name}")
        facts = written.groupBy("day").agg(F.count("*").alias("n"), F.min("start_ns").alias("low"), F.max("start_ns").alias("high")).collect()
        state["base"] |= {str(r["day"]): {"path": f"{name}/day={r['day']}", "rows": r["n"], "low": r["low"], "high": r["high"]} for r in facts}
    state["log"] = state["log"][len(merged) :]
    if len(state["rollups"]) > ROLLUP_PARTS:
        part = f"rollups/{name.removeprefix('base/')}"
        rollups.merge(store._parquet([p["path"] for p in state["rollups"]]), "1m").write.mode("errorifexists").parquet(f"{store.path}/{part}")
        dropped += [p["path"] for p in state["rollups"]]
        state["rollups"] = [{"path": part, "max_ns": max(p["max_ns"] for p in state["rollups"])}]
    _leave(store, state, dropped)
    store._commit(state)
    vacuum(store)
    return sum(d["rows"] for d in state["base"].values())


def expirable(store: SpanStore) -> bool:
    """Whether retention has something to drop that needs no compaction; told from the commit alone."""
    cutoff, base, log = store.cutoff_ns(), store.state["base"], store.state["log"]
    return any(d["high"] < cutoff for d in base.values()) or (not base and bool(log) and log[0]["max_ns"] < cutoff)


def expire(store: SpanStore, cutoff_ns: int | None = None) -> int:
    """Drop whole days and log batches whose newest span is before the cutoff; returns the rows dropped.

    A store does so by itself after a write, where that needs no compaction. A log batch may hide older
    rows of its keys: with a base, or an older batch that stays, the log is compacted first, so that an
    overwritten row cannot come back.
    """
    store._settle()
    if cutoff_ns is None and not store.retention_days:
        return 0
    cutoff = store.cutoff_ns() if cutoff_ns is None else cutoff_ns
    old = [b["max_ns"] < cutoff for b in store.state["log"]]
    if any(old) and (store.state["base"] or old != sorted(old, reverse=True)):
        compact(store)
    state, dropped, rows = json.loads(json.dumps(store.state)), [], 0
    for d in [d for d, facts in state["base"].items() if facts["high"] < cutoff]:
        gone = state["base"].pop(d)
        rows += gone["rows"]
        dropped.append(gone["path"])
    while state["log"] and state["log"][0]["max_ns"] < cutoff:
        gone = state["log"].pop(0)
        rows += gone["rows"]
        dropped.append(gone["path"])
    parts = [p for p in state["rollups"] if p["max_ns"] < cutoff - rollups.WINDOWS["1m"]]
    state["rollups"] = [p for p in state["rollups"] if p not in parts]
    dropped += [p["path"] for p in parts]
    if not dropped:
        return 0
    _leave(store, state, dropped)
    store._commit(state)
    vacuum(store)
    return rows


def vacuum(store: SpanStore, grace_seconds: float | None = None) -> int:
    """Delete folders that no commit has listed for the grace period, and old commit files; returns the number of folders."""
    grace = store.grace_seconds if grace_seconds is None else grace_seconds
    before = store.clock() - int(grace * 1_000_000_000)
    gone = [path for path, since in store.state["dropped"] if since <= before]
    if gone:
        state = json.loads(json.dumps(store.state))
        state["dropped"] = [x for x in state["dropped"] if x[0] not in gone]
        try:
            store._commit(state)
        except Conflict:  # the next vacuum finds them again
            return 0
        for path in gone:
            store.folder.remove(path)
    for name in store.folder.names("commits")[:-COMMITS]:
        store.folder.remove(f"commits/{name}")
    return len(gone)


@dataclass
class Report:
    """What an integrity check found."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    superseded: int = 0

    @property
    def ok(self) -> bool:
        return not self.errors


def check(store: SpanStore) -> Report:
    """Compare the commit with the files, and base with log."""
    store._settle()
    out, state = Report(), store.state
    base = state["base"]
    for b in state["log"]:
        if not store.folder.exists(b["path"]):
            out.errors.append(f"{b['path']} is committed but missing")
            continue
        try:
            n = store._parquet([b["path"]], LOG_SCHEMA).agg(F.count("*"), F.count("trace_id"), F.bit_xor("start_ns")).first()[0]
            if n != b["rows"]:
                out.errors.append(f"{b['path']} has {n} rows, the commit says {b['rows']}")
        except PySparkException as e:
            out.errors.append(f"{b['path']} cannot be read: {type(e).__name__}")
    missing = [d for d in base if not store.folder.exists(base[d]["path"])]
    out.errors += [f"{base[d]['path']} is committed but missing" for d in missing]
    present = [d for d in base if d not in missing]
    if present:
        try:
            rows = store._parquet([base[d]["path"] for d in present], SPAN_SCHEMA).select(*PUBLIC)
            facts = rows.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("repeated")).first()
            want = sum(base[d]["rows"] for d in present)
            if facts["n"] != want:
                out.errors.append(f"the base has {facts['n']} rows, the commit says {want}")
            if facts["repeated"]:
                out.errors.append(f"{facts['repeated']} keys of the base are repeated")
            log = store.log() if not out.errors else None
            if log is not None and (hidden := rows.join(log.select(*KEY), KEY, "left_semi").count()):
                out.superseded = hidden
                out.warnings.append(f"{hidden} base rows are superseded or deleted and await compaction")
        except PySparkException as e:
            out.errors.append(f"the base cannot be read: {type(e).__name__}")
    for p in state["rollups"]:
        if not store.folder.exists(p["path"]):
            out.errors.append(f"{p['path']} is committed but missing")
    listed = {b["path"] for b in state["log"]} | {p["path"] for p in state["rollups"]} | {d["path"].rsplit("/", 1)[0] for d in base.values()} | {path.split("/day=")[0] for path, _ in state["dropped"]}
    for kind in ("log", "base", "rollups", "incoming"):
        out.warnings += [f"{kind}/{n} is not in the commit" for n in store.folder.names(kind) if f"{kind}/{n}" not in listed]
    highest = max((int(b["path"].split("/")[1].split("-")[0]) for b in state["log"]), default=0)
    if highest > state["batch"]:
        out.errors.append(f"batch {highest} is beyond the commit's {state['batch']}")
    return out
