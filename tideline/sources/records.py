"""Record logs: from an event table, and as a Python data source over JSON-lines shard files.

``spark.read.format("shardlog")`` reads one partition per shard; ``readStream`` keeps one
position per shard in its offset log: the last sequence number, the byte after it, and
whether the shard has ended or its tip was reached.  A shard's file is
``<path>/<shard_id>.jsonl`` with one record per line in sequence order, of which only whole
lines count.  Its ``.closed`` companion says that no more will come; ``_shards.jsonl``
names shards' parents (shard_id, parent_shard_id, adjacent_parent_shard_id).  Paths are
whatever Arrow's file systems open.  A trigger reads on from the bytes where the last one
stopped, and of shards without a limit only the last lines.

A shard is read once all its known parents have ended, as of the batches before: a parent
ends with the batch that reads the last record of its closed file.  A shard that is found
later starts at its beginning if it has a known parent, and at ``start`` otherwise.

Options: path; start (TRIM_HORIZON, LATEST, or AT_TIMESTAMP with startTimestamp, ISO 8601 in
UTC); shards (comma-joined); after (JSON of checkpoints by shard, to resume after);
maxRecordsPerShardPerBatch; progress (a folder of the query's own, where the source notes
what it planned last, needed to restart with a limit or with parents); marks (true: after a
shard's records a row with sequence_number ``SHARD_END:<seq>`` when it ends, or ``TIP`` when
all that was there is read).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from ..model import AT_TIMESTAMP, LATEST, RECORDS, SHARD_END, TRIM_HORIZON

SHARD_COUNT = 4


def shard_of(user_id):
    """The shard of a key; stands for the hash that a stream service applies."""
    return F.concat(F.lit("shardId-"), F.lpad((user_id % SHARD_COUNT).cast("string"), 12, "0"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a record log, with ``poison`` for records that no handler can take."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        shard_of(F.col("user_id")).alias("shard_id"), (F.col("event_id") + 1).cast("string").alias("sequence_number"), F.col("user_id").cast("string").alias("partition_key"),
        F.col("props").cast("binary").alias("data"), F.col("ts").cast("timestamp").alias("approximate_arrival_timestamp"), F.lit(None).cast("string").alias("encryption_type"),
        (F.col("event_type") == "error").alias("poison"),
    )


def sequence_key(s: str) -> tuple[int, str]:
    return len(s), s


def _parse(shard: str, line: bytes) -> tuple:
    r = json.loads(line)
    return shard, r["sequence_number"], r.get("partition_key"), base64.b64decode(r.get("data", "")), _time(r.get("approximate_arrival_timestamp")), r.get("encryption_type")


def _time(text: str | None) -> datetime | None:
    if not text:
        return None
    at = datetime.fromisoformat(text)
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


class Folder:
    """The shard files of a log."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def names(self) -> set[str]:
        return {f.base_name for f in self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if f.type == fs.FileType.File}

    def size(self, shard: str) -> int:
        return self.files.get_file_info(f"{self.root}/{shard}.jsonl").size or 0

    def parents(self, names: set[str]) -> dict[str, list[str]]:
        """The parents of each shard of the listing."""
        if "_shards.jsonl" not in names:
            return {}
        with self.files.open_input_stream(f"{self.root}/_shards.jsonl") as f:
            rows = [json.loads(x) for x in f.read().splitlines() if x.strip()]
        return {r["shard_id"]: [p for p in (r.get("parent_shard_id"), r.get("adjacent_parent_shard_id")) if p] for r in rows if r.get("shard_id")}

    def lines(self, shard: str, byte: int = 0, upto: int | None = None) -> Iterator[tuple[bytes, int]]:
        """Whole lines from ``byte`` on, each with the byte after it."""
        with self.files.open_input_file(f"{self.root}/{shard}.jsonl") as f:
            end = f.size() if upto is None else min(upto, f.size())
            f.seek(byte)
            rest = b""
            while byte < end:
                chunk = f.read(min(1 << 20, end - f.tell()))
                if not chunk:
                    return
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    byte += len(line) + 1
                    if line.strip():
                        yield line, byte

    def tip(self, shard: str, byte: int) -> tuple[str, int] | None:
        """The sequence number of the last whole line past ``byte``, and the byte after it; reads from the file's end."""
        with self.files.open_input_file(f"{self.root}/{shard}.jsonl") as f:
            end, width = f.size(), 1 << 16
            while True:
                lo = max(byte, end - width)
                f.seek(lo)
                data = f.read(end - lo)
                stop = data.rfind(b"\n")
                begin = data.rfind(b"\n", 0, max(stop, 0))
                if stop >= 0 and (begin >= 0 or lo == byte):
                    line = data[begin + 1 : stop]
                    if line.strip():
                        return json.loads(line)["sequence_number"], lo + stop + 1
                    end = lo + begin + 1
                elif lo == byte:
                    return None
                width *= 2


class ShardSlice(InputPartition):
    """The lines of a shard from ``byte`` to ``upto`` (to the end, if None) that come after ``seq``, and a mark after them."""

    def __init__(self, shard: str, seq: str, byte: int, upto: int | None, since: str = "", mark: str = ""):
        self.shard, self.seq, self.byte, self.upto, self.since, self.mark = shard, seq, byte, upto, since, mark


# ``begin`` is the byte where the shard was begun, ``since`` whether its records are read by time of arrival
NEW = {"seq": "", "byte": 0, "end": False, "tip": False, "begin": 0, "since": False}


def resumed(checkpoint: str) -> dict:
    """The position after a stored checkpoint."""
    ended = checkpoint.startswith(SHARD_END)
    return NEW | {"seq": checkpoint.removeprefix(SHARD_END).removeprefix(":") if ended else checkpoint, "end": ended}


class _Reading:
    def __init__(self, options: dict):
        self.folder, self.start, self.since = Folder(options["path"]), options.get("start", TRIM_HORIZON), options.get("startTimestamp", "")
        if self.start not in (TRIM_HORIZON, LATEST, AT_TIMESTAMP):
            raise ValueError(f"start {self.start!r}")
        if self.start == AT_TIMESTAMP and not self.since:
            raise ValueError("AT_TIMESTAMP needs startTimestamp")
        self.most = int(options.get("maxRecordsPerShardPerBatch", "0"))
        self.only = {s for s in options.get("shards", "").split(",") if s}
        self.after = {s: resumed(c) for s, c in json.loads(options.get("after", "{}")).items() if c}
        self.marks, self.progress = options.get("marks", "false").lower() == "true", options.get("progress", "")

    def wanted(self, shard: str) -> bool:
        return not self.only or shard in self.only

    def read(self, part: ShardSlice) -> Iterator[tuple]:
        low, since = sequence_key(part.seq), _time(part.since)
        for line, _ in self.folder.lines(part.shard, part.byte, part.upto):
            row = _parse(part.shard, line)
            if sequence_key(row[1]) > low and (since is None or row[4] is not None and row[4] >= since):
                yield row
        if part.mark:
            yield part.shard, part.mark, None, None, None, None


class ShardLogReader(_Reading, DataSourceReader):
    def pushFilters(self, filters):
        """An equality on shard_id prunes partitions."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("shard_id",):
                self.only = {f.value} if not self.only else self.only & {f.value} or {""}
            else:
                yield f

    def partitions(self):
        names = self.folder.names()
        parents = self.folder.parents(names)
        found = {n.removesuffix(".jsonl") for n in names if n.endswith(".jsonl") and n != "_shards.jsonl"}
        out = []
        for shard in sorted(filter(self.wanted, found)):
            at, child = self.after.get(shard), any(p in found or p in parents for p in parents.get(shard, []))
            if at is not None and not at["end"]:
                out.append(ShardSlice(shard, at["seq"], 0, None))
            elif at is None and (child or self.start != LATEST):
                out.append(ShardSlice(shard, "", 0, None, "" if child or self.start != AT_TIMESTAMP else self.since))
        return out


class ShardLogStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.planned: dict | None = None
        self.begun: dict | None = None

    def _note(self, end: dict) -> None:
        self.planned = end
        if self.progress:
            files, root = fs.FileSystem.from_uri(self.progress)
            files.create_dir(root)
            with files.open_output_stream(f"{root}/planned.json.new") as f:
                f.write(json.dumps(end).encode())
            files.move(f"{root}/planned.json.new", f"{root}/planned.json")

    def _noted(self) -> dict | None:
        if not self.progress:
            return None
        files, root = fs.FileSystem.from_uri(self.progress)
        if files.get_file_info(f"{root}/planned.json").type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(f"{root}/planned.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        """Positions of shards that are resumed, and the tips of those that start there; a query's first offset.

        Spark may ask for the latest offset before; both begin alike.
        """
        if self.begun is None:
            out = {s: dict(at) for s, at in self.after.items() if self.wanted(s)}
            if self.start == LATEST:
                names = self.folder.names()
                parents = self.folder.parents(names)
                for shard in (n.removesuffix(".jsonl") for n in names if n.endswith(".jsonl") and n != "_shards.jsonl"):
                    if self.wanted(shard) and shard not in out and not parents.get(shard):
                        seq, byte = self.folder.tip(shard, 0) or ("", 0)
                        out[shard] = NEW | {"seq": seq, "byte": byte, "tip": True, "begin": byte}
            self.begun = out
        return self.begun

    def latestOffset(self) -> dict:
        base = self.planned
        if base is None:  # a query that begins, or one that starts again: where it stopped is known from the note alone
            base = self._noted()
        names = self.folder.names()
        parents = self.folder.parents(names)
        if base is None:
            if not self.progress and (self.most or any(parents.values())):
                raise ValueError("a stream with maxRecordsPerShardPerBatch or with parents needs the option progress")
            base = self.initialOffset()
        found = {n.removesuffix(".jsonl") for n in names if n.endswith(".jsonl") and n != "_shards.jsonl"}
        out = dict(base)
        for shard in sorted(filter(self.wanted, found)):
            known = [p for p in parents.get(shard, []) if p in found or p in parents or p in base]
            at = base.get(shard)
            if at is None:
                if not all(base.get(p, NEW)["end"] for p in known if self.wanted(p)):
                    continue
                at = NEW | {"since": not known and self.start == AT_TIMESTAMP}
                if not known and self.start == LATEST:
                    seq, byte = self.folder.tip(shard, 0) or ("", 0)
                    at |= {"seq": seq, "byte": byte, "begin": byte}
            out[shard] = at if at["end"] else self._further(shard, at, f"{shard}.closed" in names)
        return out

    def _further(self, shard: str, at: dict, closed: bool) -> dict:
        """The position after what may be read now; ``closed`` was seen before the file's end is looked up."""
        seq, byte, n = at["seq"], at["byte"], 0
        if self.most:
            for line, after in self.folder.lines(shard, byte):
                own = json.loads(line)["sequence_number"]
                if sequence_key(own) > sequence_key(at["seq"]):
                    if n == self.most:
                        break
                    seq, n = own, n + 1
                byte = after
        else:
            tip = self.folder.tip(shard, byte)
            if tip is not None:
                seq, byte = max(tip[0], seq, key=sequence_key), tip[1]
        there = self.folder.tip(shard, byte) is None
        return at | {"seq": seq, "byte": byte, "end": closed and there, "tip": there}

    def partitions(self, start: dict, end: dict):
        self._note(end)
        out = []
        for shard, to in end.items():
            at = start.get(shard, NEW | {"byte": to["begin"]})
            mark = ""
            if self.marks and to["end"] and not at["end"]:
                mark = f"{SHARD_END}:{to['seq']}" if to["seq"] else SHARD_END
            elif self.marks and to["tip"] and to["byte"] > at["byte"]:
                mark = "TIP"
            if to["byte"] > at["byte"] or mark:
                out.append(ShardSlice(shard, at["seq"], at["byte"], to["byte"], self.since if to["since"] else "", mark))
        return out

    def commit(self, end: dict) -> None: ...


class ShardLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shardlog"

    def schema(self):
        return RECORDS

    def reader(self, schema) -> ShardLogReader:
        return ShardLogReader(self.options)

    def streamReader(self, schema) -> ShardLogStreamReader:
        return ShardLogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardLog)


def export_log(records: DataFrame, path: str, closed: tuple[str, ...] = (), parents: dict[str, tuple[str, ...]] | None = None) -> None:
    """Writes the shards of ``records`` as a log: one file for each, in sequence order; a longer log replaces a shorter one."""
    spark = records.sparkSession
    at = F.date_format(F.to_utc_timestamp("approximate_arrival_timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # regexp: Spark cuts base64 into lines
    row = F.struct("sequence_number", "partition_key", F.regexp_replace(F.base64("data"), r"[\r\n]", "").alias("data"), at.alias("approximate_arrival_timestamp"), "encryption_type")
    ordered = records.select("shard_id", F.length("sequence_number").alias("_n"), "sequence_number", F.to_json(row).alias("value"))
    ordered = ordered.repartition("shard_id").sortWithinPartitions("shard_id", "_n", "sequence_number")
    ordered.select("shard_id", "value").write.mode("overwrite").partitionBy("shard_id").option("maxRecordsPerFile", 0).text(f"{path}/_parts")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    for shard in [f.getPath() for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts")) if f.isDirectory()]:
        name = shard.getName().removeprefix("shard_id=")
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.jsonl")
        files.delete(to, False)
        (part,) = [f.getPath() for f in files.listStatus(shard) if f.getPath().getName().startswith("part-")]
        files.rename(part, to)
    files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts"), True)
    target, root = fs.FileSystem.from_uri(path)
    for shard in closed:
        target.open_output_stream(f"{root}/{shard}.closed").close()
    if parents:
        with target.open_output_stream(f"{root}/_shards.jsonl") as f:
            f.write("".join(json.dumps({"shard_id": s, **dict(zip(("parent_shard_id", "adjacent_parent_shard_id"), p))}) + "\n" for s, p in parents.items()).encode())


def write_shard_log(rows: list[tuple], path: str, closed: tuple[str, ...] = (), parents: dict[str, tuple[str, ...]] | None = None) -> None:
    """Appends (shard_id, sequence_number, partition_key, data[, arrival]) to a local log, closes shards and lists parents; for tests and tools."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    for shard, seq, key, data, *at in rows:
        row = {"sequence_number": seq, "partition_key": key, "data": base64.b64encode(data).decode()} | ({"approximate_arrival_timestamp": at[0]} if at else {})
        with (folder / f"{shard}.jsonl").open("a") as f:
            f.write(json.dumps(row) + "\n")
    for shard in closed:
        (folder / f"{shard}.jsonl").touch()
        (folder / f"{shard}.closed").touch()
    if parents:
        with (folder / "_shards.jsonl").open("a") as f:
            f.writelines(json.dumps({"shard_id": s, **dict(zip(("parent_shard_id", "adjacent_parent_shard_id"), p))}) + "\n" for s, p in parents.items())
