"""A store of versioned tables: immutable runs of Parquet, and a changelog of small files that says which are live.

A writer puts its run in place and then creates the next changelog file, which appears whole and only one writer can;
whoever loses tries again with the following number. Readers fold the changelog (from the newest snapshot on, then what
follows the state they hold) and plan one Spark query over the live runs. Every run of a commit has the commit's number,
so a read at the returned number sees all of a batch. Runs have disjoint key ranges within a commit, each key once.

The manifest is a row for each live run, held by the driver; compaction keeps it small. Rows never are.
"""

from __future__ import annotations

import bisect
import dataclasses
import json
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.operators import layout, manifest, merge
from tidelog.sources.files import Files
from tidelog.sources.schema import PUT, RUNS


#: Lists of tables and runs of up to so many rows are broadcast; longer ones are joined as Spark sees fit.
BROADCAST_ROWS = 10_000
#: A job that failed so often has failed; after the first attempt it waits so many seconds, twice as long after each.
ATTEMPTS, BACKOFF = 3, 10.0
#: A worker that has held a job for so many seconds counts as lost.
LEASE = 6 * 3600.0

class NotFound(LookupError):
    """A table, run or job that isn't there."""


class AlreadyExists(ValueError):
    """A live table of that name is there."""


class FailedPrecondition(RuntimeError):
    """A read of a state that isn't reached yet, or a commit whose inputs are gone."""


@dataclasses.dataclass
class State:
    seq_no: int = 0
    tables: dict[str, int] = dataclasses.field(default_factory=dict)
    runs: dict[str, dict] = dataclasses.field(default_factory=dict)
    next_table: int = 1
    #: The last batch of each stream.
    batches: dict[str, int] = dataclasses.field(default_factory=dict)

    def copy(self) -> State:
        return dataclasses.replace(self, tables=dict(self.tables), runs=dict(self.runs), batches=dict(self.batches))

    def has(self, tag: tuple[str, int] | None) -> bool:
        return tag is not None and self.batches.get(tag[0], -1) >= tag[1]

    def apply(self, entry: dict) -> None:
        self.seq_no = entry["id"]
        if entry.get("tag"):
            self.batches[entry["tag"][0]] = entry["tag"][1]
        if entry["kind"] == "table_created":
            self.tables[entry["table_name"]] = entry["table_id"]
            self.next_table = max(self.next_table, entry["table_id"] + 1)
        elif entry["kind"] == "table_dropped":
            self.tables = {k: v for k, v in self.tables.items() if v != entry["table_id"]}
            self.runs = {k: r for k, r in self.runs.items() if r["table_id"] != entry["table_id"]}
        else:
            for run in entry["runs_removed"]:
                self.runs.pop(run, None)
            for run in entry["runs_added"]:
                if run["run_id"] not in entry["runs_removed"] and (run["tier"] == "wal" or run["table_id"] in self.tables.values()):
                    self.runs[run["run_id"]] = run

    def in_order(self, table_id: int | None = None) -> list[dict]:
        """Live runs from the newest to the oldest: log, buffers, then levels."""
        place = {"wal": 0, "buffer": 1, "level": 2}
        runs = [r for r in self.runs.values() if table_id is None or r["table_id"] in (None, table_id)]
        return sorted(runs, key=lambda r: (place[r["tier"]], r["level"] or 0, -(r["seq_no"] or 0), r["run_id"]))


@dataclasses.dataclass
class Settings:
    """What may change while the store is in use."""

    concurrent_uploads: int = 4
    max_run_bytes: int = 128 << 20
    flush_ops: int = 50_000

    @classmethod
    def of(cls, held: dict) -> Settings:
        whole = lambda v: type(v) is int or isinstance(v, str) and v.strip().isdigit()
        return cls(**{f.name: int(held[f.name]) for f in dataclasses.fields(cls) if whole(held.get(f.name)) and int(held[f.name]) > 0})


class Store:
    def __init__(self, spark: SparkSession, root: str, max_run_bytes: int = 128 << 20) -> None:
        self.spark, self.root, self.max_run_bytes = spark, root.rstrip("/"), max_run_bytes
        self.files = Files(spark, self.root)
        self.files.make()
        self._held: State | None = None

    def _list(self, rows: list[tuple], schema: str) -> DataFrame:
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

    # manifest

    def changelog(self, after: int = 0) -> list[dict]:
        """Entries after an id (exclusive), in order."""
        return self._entries(self.files.names("changelog"), after)

    def _entries(self, names: list[str], after: int) -> list[dict]:
        return [json.loads(x) for x in self.files.read_all([f"changelog/{n}" for n in names if int(n.split(".")[0]) > after])]

    def state(self) -> State:
        """The newest state: what this object holds, and the entries that follow."""
        names = self.files.names("changelog")
        held = self._held
        if held is None or (int(names[-1].split(".")[0]) if names else 0) < held.seq_no:  # the first read, or one after a reset
            snapshots = self.files.names("snapshots")
            held = State(**json.loads(self.files.read(f"snapshots/{snapshots[-1]}"))) if snapshots else State()
        for entry in self._entries(names, held.seq_no):
            held.apply(entry)
        self._held = held
        return held.copy()

    def follow(self, poll: float = 1.0, until: int | None = None) -> Iterator[State]:
        """The state now and after every later entry, up to a sequence number if one is given."""
        state = self.state()
        yield state.copy()
        while until is None or state.seq_no < until:
            entries = self.changelog(state.seq_no)
            for entry in entries:
                state.apply(entry)
                yield state.copy()
                if until is not None and state.seq_no >= until:
                    return
            if not entries:
                time.sleep(poll)

    def _commit(self, build) -> tuple[int, dict]:
        """Adds the entry that build(state) returns as the next one; tries again when another writer was first."""
        while True:
            state = self.state()
            entry = build(state)
            if entry is None:
                return state.seq_no, {}
            entry = {"id": state.seq_no + 1, "at": time.time(), "runs_added": [], "runs_removed": [], "table_id": None, **entry}
            if self.files.create(f"changelog/{entry['id']:020d}.json", json.dumps(entry)):
                return entry["id"], entry
            time.sleep(0.01)

    def persist_snapshot(self) -> tuple[str, int]:
        """Writes the folded state, from which readers then start."""
        s = self.state()
        name = f"{s.seq_no:020d}.json"
        self.files.create(f"snapshots/{name}", json.dumps(dataclasses.asdict(s)))
        return name, s.seq_no

    def runs_by_id(self, ids: Iterable[str]) -> dict[str, dict]:
        """Manifest rows of runs, those that are replaced by now included; unknown ones are absent."""
        wanted = set(ids)
        return {r["run_id"]: r for e in self.changelog() for r in e["runs_added"] if r["run_id"] in wanted}

    def hydrated(self, after: int = 0) -> DataFrame:
        """id and the manifest row of every run that an entry after an id added."""
        rows = [(e["id"], *(r.get(c) for c in RUNS.fieldNames())) for e in self.changelog(after) for r in e["runs_added"]]
        return self.spark.createDataFrame(rows, StructType([StructField("id", LongType()), *RUNS.fields]))

    def table_history(self) -> DataFrame:
        """table_id, table_name and the times at which tables were created and dropped."""
        found: dict[int, list] = {}
        for e in self.changelog():
            if e["kind"] == "table_created":
                found[e["table_id"]] = [e["table_id"], e["table_name"], e["at"], None]
            elif e["kind"] == "table_dropped":
                found[e["table_id"]][3] = e["at"]
        rows = self.spark.createDataFrame([tuple(x) for x in found.values()], "table_id long, table_name string, created double, dropped double")
        return rows.select("table_id", "table_name", F.timestamp_millis((F.col("created") * 1000).cast("long")).alias("created_at"), F.timestamp_millis((F.col("dropped") * 1000).cast("long")).alias("deleted_at"))

    def runs_frame(self) -> DataFrame:
        rows = [tuple(r.get(c) for c in RUNS.fieldNames()) for r in self.state().runs.values()]
        return self.spark.createDataFrame(rows, RUNS)

    def changelog_frame(self, after: int = 0) -> DataFrame:
        rows = [(e["id"], e["kind"], [r["run_id"] for r in e["runs_added"]], e["runs_removed"], e["table_id"]) for e in self.changelog(after)]
        return self.spark.createDataFrame(rows, "id long, kind string, runs_added array<string>, runs_removed array<string>, table_id long")

    def tables_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n) for n, i in self.state().tables.items()], "table_id long, table_name string")

    def summary(self) -> DataFrame:
        return manifest.summary(self.runs_frame(), self.tables_frame())

    # tables

    def create_table(self, name: str) -> int:
        if not name:
            raise merge.InvalidArgument("a table needs a name")

        def build(state: State) -> dict:
            if name in state.tables:
                raise AlreadyExists(f"table {name} exists")
            return {"kind": "table_created", "table_id": state.next_table, "table_name": name}

        return self._commit(build)[0]

    def drop_table(self, name: str) -> int:
        return self._commit(lambda s: {"kind": "table_dropped", "table_id": self._id(s, name), "table_name": name})[0]

    def list_tables(self) -> list[tuple[int, str]]:
        return sorted((i, n) for n, i in self.state().tables.items())

    def get_table(self, name: str) -> int:
        return self._id(self.state(), name)

    @staticmethod
    def _id(state: State, name: str) -> int:
        if name not in state.tables:
            raise NotFound(f"no table {name}")
        return state.tables[name]

    # writing

    def write_batch(self, batch: DataFrame | Mapping[str, Iterable[tuple[str, bytes | None]]], tag: tuple[str, int] | None = None) -> int:
        """Commits puts and deletes of any number of tables at once and returns the sequence number.

        A mapping has lists of (key, value), None for a delete, of which the last wins. A frame has table_name, key,
        op and value; with pos, its greatest value tells the last write of a key, without it a key may be there once
        only. A tag names a stream and a batch of it; a batch not after the stream's last one is a no-op, so a repeated
        micro-batch is written once.
        """
        state = self.state()
        if state.has(tag):
            return state.seq_no
        if isinstance(batch, Mapping):
            if not batch:
                raise merge.InvalidArgument("a batch needs tables")
            rows = [(t, k, v, i) for t, items in batch.items() for i, (k, v) in enumerate(items)]
            for t in batch:
                self._id(state, t)
            batch = self.spark.createDataFrame(rows, "table_name string, key string, value binary, pos long").withColumn("op", F.when(F.col("value").isNull(), "delete").otherwise(PUT))
        names = self._list([(n, i) for n, i in state.tables.items()], "table_name string, table_id long")
        if "pos" in batch.columns:
            batch = merge.latest_wins(batch.select("table_name", "key", "op", "value", "pos"), version="pos")
        else:
            batch = merge.only_once(batch.select("table_name", "key", "op", "value"))
        known = batch.join(names, "table_name", "left").withColumn("table_id", F.when(F.col("table_id").isNull(), F.raise_error(F.concat(F.lit("no table "), F.coalesce("table_name", F.lit("null"))))).otherwise(F.col("table_id")))
        try:
            added = self._write(known, "wal", None)
        except Exception as e:
            for said, kind in (("no table ", NotFound), (merge.TWICE, merge.InvalidArgument)):
                if said in str(e):
                    raise kind(str(e).split("\n")[0]) from e
            raise
        if not added:
            return state.seq_no

        def build(now: State) -> dict | None:
            if now.has(tag):
                return None
            return {"kind": "runs", "runs_added": [r | {"seq_no": now.seq_no + 1} for r in added], "tag": tag}

        return self._commit(build)[0]

    def _write(self, ops: DataFrame, tier: str, level: int | None, seq_no: int | None = None, size_hint: int | None = None) -> list[dict]:
        """Writes operations (table_id, key, op, value), each key once, as runs of key ranges, sorted, and returns their
        manifest rows. A run of the log may hold several tables, any other holds one."""
        name = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:12]}"
        ops = ops.select("table_id", "key", "op", F.col("value").cast("binary").alias("value"))
        held = None
        if size_hint is None:
            held = ops = ops.persist()
            size_hint = ops.agg(F.coalesce(F.sum(layout.op_size()), F.lit(0))).first()[0]
        parts = max(1, -(-size_hint // self.max_run_bytes))
        ranged = ops.repartitionByRange(parts, "table_id", "key").sortWithinPartitions("table_id", "key")
        ranged = ranged.withColumn("owner", F.lit(0).cast("long") if tier == "wal" else F.col("table_id")).withColumn("part", F.spark_partition_id())
        path = f"{self.root}/runs/{name}"
        try:
            ranged.write.mode("errorifexists").partitionBy("owner", "part").parquet(path)
        finally:
            if held is not None:
                held.unpersist()
        written = self.spark.read.schema("table_id long, key string, op string, value binary, owner long, part int").parquet(path)
        rows = layout.run_stats(written, ["owner", "part"]).orderBy("owner", "min_key").collect()
        return [
            {"run_id": f"{name}/owner={r['owner']}/part={r['part']}", "tier": tier, "table_id": None if tier == "wal" else r["owner"], "seq_no": seq_no, "level": level, "min_key": r["min_key"], "max_key": r["max_key"], "size_bytes": r["size_bytes"], "put_count": r["put_count"], "delete_count": r["delete_count"]}
            for r in rows
        ]

    # reading

    def read_runs(self, runs: list[dict]) -> DataFrame:
        """Operations of runs with `rank`, their place in the list (0 the most recent).

        One scan over all paths; the rank comes from the file's folder by a join with the list.
        """
        schema = "table_id long, key string, op string, value binary"
        if not runs:
            return self.spark.createDataFrame([], schema + ", rank long")
        ops = self.spark.read.schema(schema).parquet(*[f"{self.root}/runs/{r['run_id']}" for r in runs])
        ranks = self._list([(r["run_id"], i) for i, r in enumerate(runs)], "run_id string, rank long")
        # a path in a listing may have its signs escaped
        named = ops.select("*", F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]+/owner=\d+/part=\d+)/[^/]*$", 1).alias("run_id"))
        return named.join(ranks, "run_id").drop("run_id")

    def get_run(self, run_id: str) -> DataFrame:
        """Operations of one run, also of one that is replaced by now."""
        if not run_id or not self.files.exists(f"runs/{run_id}"):
            raise NotFound(f"no run {run_id}")
        return self.read_runs([{"run_id": run_id}]).drop("rank")

    def _ready(self, min_seq: int) -> State:
        state = self.state()
        if min_seq > state.seq_no:
            raise FailedPrecondition(f"the store is at {state.seq_no}, before {min_seq}")
        return state

    def merged(self, state: State | None = None) -> DataFrame:
        """The newest operation of every key of the live tables: table_id, key, op, value, rank."""
        state = state or self.state()
        ops = self.read_runs(state.in_order()).where(F.col("table_id").isin(list(state.tables.values())))
        return merge.first_wins(ops, ("table_id", "key"))

    def get_batch(self, requests: Mapping[str, Iterable[str]], min_seq: int = 0) -> DataFrame:
        """table_name, key and value of the visible ones among the requested keys, of one state."""
        state = self._ready(min_seq)
        if not requests:
            raise merge.InvalidArgument("a request needs tables")
        wanted = self._list([(self._id(state, t), t, k) for t, keys in requests.items() for k in dict.fromkeys(keys)], "table_id long, table_name string, key string")
        keys = sorted({k for ks in requests.values() for k in ks})
        ids = {self._id(state, t) for t in requests}

        def meets(r: dict) -> bool:
            at = bisect.bisect_left(keys, r["min_key"])
            return (r["table_id"] is None or r["table_id"] in ids) and at < len(keys) and keys[at] <= r["max_key"]

        ops = self.read_runs([r for r in state.in_order() if meets(r)]).where(F.col("table_id").isin(sorted(ids)))
        if len(keys) <= merge.PUSHED_KEYS:  # reaches the files' statistics
            ops = ops.where(F.col("key").isin(keys))
        ops = ops.join(wanted, ["table_id", "key"])
        return merge.visible(merge.first_wins(ops, ("table_id", "key"))).select("table_name", "key", "value")

    def scan(self, table: str, start: str | None = None, limit: int | None = None, min_seq: int = 0) -> DataFrame:
        """key and value in key order after `start`, of one state."""
        if limit is not None:
            merge.check_page(limit)
        state = self._ready(min_seq)
        table_id = self._id(state, table)
        runs = [r for r in state.in_order(table_id) if start is None or r["max_key"] > start]
        ops = self.read_runs(runs).where(F.col("table_id") == table_id)
        if start is not None:
            ops = ops.where(F.col("key") > start)
        rows = merge.visible(merge.first_wins(ops, ("table_id", "key"))).select("key", "value").orderBy("key")
        return rows if limit is None else rows.limit(limit)

    # compaction

    def _replace(self, inputs: list[dict], outputs: list[dict]) -> int:
        gone = [r["run_id"] for r in inputs]

        def build(now: State) -> dict:
            if any(r not in now.runs for r in gone):
                raise FailedPrecondition("a run to be replaced is gone already")
            return {"kind": "runs", "runs_added": [r | {"seq_no": r["seq_no"] or now.seq_no + 1} for r in outputs], "runs_removed": gone}

        return self._commit(build)[0]

    def compact_wal(self, fan_in: int = manifest.FAN_IN, min_seq: int = 0) -> int:
        """The oldest runs of the log become a buffer run for each live table; exactly what was read is removed. With
        min_seq not of a state that is older."""
        state = self._ready(min_seq)
        wal = sorted((r for r in state.runs.values() if r["tier"] == "wal"), key=lambda r: r["seq_no"])[:fan_in]
        if not wal:
            return state.seq_no
        live = sorted(state.tables.values())
        ops = merge.first_wins(self.read_runs(wal[::-1]).where(F.col("table_id").isin(live)), ("table_id", "key"))
        return self._replace(wal, self._write(ops, "buffer", None, max(r["seq_no"] for r in wal), sum(r["size_bytes"] for r in wal)))

    def compact_buffer(self, table: str, fan_in: int = manifest.FAN_IN) -> int:
        """The oldest buffer runs of a table and all of its level 0 become level 0."""
        state = self.state()
        table_id = self._id(state, table)
        own = state.in_order(table_id)
        buffer = sorted((r for r in own if r["tier"] == "buffer"), key=lambda r: r["seq_no"])
        seqs = sorted({r["seq_no"] for r in buffer})[:fan_in]
        buffer = [r for r in buffer if r["seq_no"] in seqs]
        if not buffer:
            return state.seq_no
        below = [r for r in own if r["tier"] == "level" and r["level"] == 0]
        inputs = buffer[::-1] + below
        ops = merge.first_wins(self.read_runs(inputs), ("table_id", "key"))
        return self._replace(inputs, self._write(ops, "level", 0, max(seqs), sum(r["size_bytes"] for r in inputs)))

    def compact_level(self, table: str, level: int) -> int:
        """The largest run of a level moves down into those of the next one that it overlaps; the last level holds no deletes."""
        state = self.state()
        table_id = self._id(state, table)
        own = [r for r in state.in_order(table_id) if r["tier"] == "level"]
        upper = sorted((r for r in own if r["level"] == level), key=lambda r: (-r["size_bytes"], r["run_id"]))[:1]
        if not upper or level >= manifest.LAST_LEVEL:
            return state.seq_no
        below = [r for r in own if r["level"] == level + 1 and r["min_key"] <= upper[0]["max_key"] and r["max_key"] >= upper[0]["min_key"]]
        ops = merge.first_wins(self.read_runs(upper + below), ("table_id", "key"))
        if level + 1 == manifest.LAST_LEVEL:
            ops = merge.visible(ops)
        return self._replace(upper + below, self._write(ops, "level", level + 1, upper[0]["seq_no"], sum(r["size_bytes"] for r in upper + below)))

    # jobs

    def _job(self, job_id: int) -> dict:
        """A job with its status (pending, running, completed or failed), attempts, and when it may be tried next."""
        job = json.loads(self.files.read(f"jobs/{job_id:020d}.json")) | {"attempts": 0, "next_at": 0.0, "output_seq": None}
        files = set(self.files.names(f"jobs/{job_id:020d}"))
        while f"try-{job['attempts']:04d}.json" in files:
            k = job["attempts"]
            begun = json.loads(self.files.read(f"jobs/{job_id:020d}/try-{k:04d}.json"))["at"]
            ended = json.loads(self.files.read(f"jobs/{job_id:020d}/end-{k:04d}.json")) if f"end-{k:04d}.json" in files else None
            job["attempts"] = k + 1
            if ended is None:
                job["status"] = "running" if time.time() < begun + LEASE else "failed" if k + 1 >= ATTEMPTS else "pending"
            elif ended["status"] == "completed":
                return job | {"status": "completed", "output_seq": ended["output_seq"]}
            else:
                job |= {"status": "failed" if k + 1 >= ATTEMPTS else "pending", "next_at": ended["at"] + BACKOFF * 2**k}
        return job

    def jobs(self) -> DataFrame:
        rows = [self._job(int(n.split(".")[0])) for n in self.files.names("jobs") if n.endswith(".json")]
        return self.spark.createDataFrame([(r["job_id"], r["job_type"], r["table_id"], r["level"], r["status"], r["output_seq"], r["attempts"]) for r in rows], "job_id long, job_type string, table_id long, level long, status string, output_seq long, attempts long")

    def kick_off(self, job_type: str, table_id: int | None = None, level: int | None = None) -> int:
        """Schedules a job and returns its id; that of the pending one if there is one like it."""
        while True:
            held = self.jobs().collect()
            for r in held:
                if (r["job_type"], r["table_id"], r["level"], r["status"]) == (job_type, table_id, level, "pending"):
                    return r["job_id"]
            job_id = max([0, *(r["job_id"] for r in held)]) + 1
            if self.files.create(f"jobs/{job_id:020d}.json", json.dumps({"job_id": job_id, "job_type": job_type, "table_id": table_id, "level": level, "status": "pending"})):
                return job_id

    def job_status(self, job_id: int):
        found = self.jobs().where(F.col("job_id") == job_id).collect()
        if not found:
            raise NotFound(f"no job {job_id}")
        return found[0]

    def list_jobs(self, limit: int = 100) -> list:
        return manifest.recent_jobs(self.jobs(), limit).collect()

    def run_job(self, job_id: int, now: float | None = None) -> int:
        """Takes a pending job, runs it and records how the attempt ended. Of several workers one gets it; after
        ATTEMPTS failures the job has failed, before that it is pending again."""
        self.job_status(job_id)
        job, now = self._job(job_id), time.time() if now is None else now
        if job["status"] != "pending":
            raise FailedPrecondition(f"job {job_id} is {job['status']}")
        if now < job["next_at"]:
            raise FailedPrecondition(f"job {job_id} waits for {job['next_at'] - now:.0f} seconds more")
        k = job["attempts"]
        if not self.files.create(f"jobs/{job_id:020d}/try-{k:04d}.json", json.dumps({"at": now})):
            raise FailedPrecondition(f"job {job_id} is taken")
        names = {i: n for n, i in self.state().tables.items()}
        end = f"jobs/{job_id:020d}/end-{k:04d}.json"
        try:
            if job["job_type"] == "wal_compaction":
                seq = self.compact_wal()
            elif job["job_type"] == "table_buffer_compaction":
                seq = self.compact_buffer(names[job["table_id"]])
            elif job["job_type"] == "table_tree_compaction":
                seq = self.compact_level(names[job["table_id"]], job["level"])
            else:
                raise merge.InvalidArgument(f"job type {job['job_type']} is not known")
        except Exception:
            self.files.create(end, json.dumps({"status": "failed", "at": now}))
            raise
        self.files.create(end, json.dumps({"status": "completed", "at": now, "output_seq": seq}))
        return seq

    def compact_wal_when_due(self, stop, every: float = 1.0, wal_bytes: int = manifest.WAL_BYTES, wal_runs: int = manifest.WAL_RUNS) -> int:
        """Compacts the log whenever it is long or large enough, until stop(state) says so; never from a state that is
        older than the last commit of its own. Returns that commit, 0 if there was none."""
        last = 0
        while True:
            state = self.state()
            wal = [r for r in state.runs.values() if r["tier"] == "wal"]
            if state.seq_no > last and wal and (sum(r["size_bytes"] for r in wal) >= wal_bytes or len(wal) >= wal_runs):
                last = self.compact_wal(min_seq=last)
            elif stop(state):
                return last
            else:
                time.sleep(every)

    # settings

    def settings(self) -> Settings:
        """The newest settings; an invalid or missing one is the default."""
        names = self.files.names("settings")
        try:
            held = json.loads(self.files.read(f"settings/{names[-1]}")) if names else {}
        except ValueError:
            held = {}
        return Settings.of(held if isinstance(held, dict) else {})

    def set_settings(self, **values) -> None:
        while not self.files.create(f"settings/{len(self.files.names('settings')):020d}.json", json.dumps(values)):
            pass

    def maintain(self, snapshot_lag: int = manifest.SNAPSHOT_LAG, **thresholds: int) -> list[int]:
        """Schedules and runs every compaction that is due, and a snapshot if the last lies far behind."""
        due = manifest.plan_jobs(self.runs_frame(), **thresholds).collect()
        ids = [self.kick_off(r["job_type"], r["table_id"], r["level"]) for r in due]
        for i in ids:
            self.run_job(i)
        held = self.files.names("snapshots")
        if self.state().seq_no - (int(held[-1].split(".")[0]) if held else 0) > snapshot_lag:
            self.persist_snapshot()
        return ids

    def reset(self, dry_run: bool = True) -> list[str]:
        """Names what a reset deletes, and deletes it unless it is a dry run."""
        found = [n for n in ("runs", "changelog", "snapshots", "jobs", "settings") if self.files.exists(n)]
        if not dry_run:
            for n in found:
                self.files.delete(n)
            self._held = None
        return found
