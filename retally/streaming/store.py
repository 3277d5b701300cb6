"""The view store: views, and the table they are of, as of the last committed batch.

::

    log/batch_id=N/              what batch N adds to the views, sorted by view and date
    table/log/batch_id=N/        the last image batch N leaves of each key (stores with a table)
    rejects/batch_id=N/          text lines of batch N that are no events
    commits/group=G/N.json       commit record of batch N, written after all of these
    heads/N.json                 says that batch N was committed, written after its record
    base/version=K/month=M/view=V/    months of the views as of batch K
    table/base/version=K/bucket=B/    buckets of the table as of batch K
    manifests/K.json             which version each month and bucket has as of batch K

**Commits.** A batch counts once its commit record is there, for all views, the table and the
rejected lines at the same moment. The record names the files of the batch, its rows and its
predecessor. It is never written again: a batch that is replayed after its commit is skipped,
one that failed half-way is overwritten. Readers follow the records from the last manifest to
the head: a record or a file that is gone is an error, never a smaller result.

**Months.** A manifest says for each month of the views, and for each bucket of the table, which
files hold it. Folding the log rewrites the months and buckets that the log touches and names
the files of the others again (copy on write). Readers add up base and log for touched months
only; all others are read as they are, without a shuffle. Committed files do not change, so
reading, maintaining and folding can go on side by side (one maintaining query and one fold at a
time); files that no recent manifest names are removed by ``vacuum``.

Batch numbers count up from 0, as a streaming query's do.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changelog
from ..plans.views import ALL_KEYS, VIEWS, ViewSpec, delta, from_deltas, from_merged, merge, signed
from ..schemas import DELTA, EVENT, IMAGE, KEY, NOTICE, REJECT
from ..storage import Folder

#: Commit records per folder, so that looking for recent ones does not list all of them.
GROUP = 1000
#: Row groups of written files: rows are sorted, so small ones let readers skip views and dates.
ROW_GROUP_BYTES = 16 << 20
#: Buckets of the table, by a hash of the key. Fixed when the store is made.
BUCKETS = 64
#: Keys of the log that may be sent to all tasks, some 40 bytes each there. With more of them base and
#: log are shuffled: Spark estimates them from their file, which says little about one column.
MOST_KEYS = 100_000

Clock = Callable[[int], datetime.datetime]


def _now(batch_id: int) -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def _text(time: datetime.datetime) -> str:
    if time.tzinfo is None:
        raise ValueError("the commit clock gives a time without a zone")
    return time.astimezone(datetime.timezone.utc).isoformat(timespec="microseconds")


def month_of(date: str) -> F.Column:
    """Month of a YYYYMMDD date column as YYYYMM, 0 for a missing date."""
    return F.coalesce(F.expr(f"{date} div 100"), F.lit(0)).cast("int")


class ViewStore:
    """Reads and writes the views kept under ``root``, a folder all executors can reach.

    ``clock`` gives the time of a batch, once per batch; its own time by default. With ``table`` the
    store also keeps the table that the changes are of.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Clock = _now, table: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.clock, self.keeps_table = clock, table
        self._folder = Folder(spark, self.root)
        self._records: dict[int, dict] = {}

    # --- commit records -------------------------------------------------------------------

    def _record(self, batch_id: int) -> dict | None:
        """Commit record of a batch, None while it is not committed. Records do not change."""
        if batch_id not in self._records:
            found = self._folder.read_json(_record_name(batch_id)) if batch_id >= 0 else None
            if found is None:
                return None
            self._records[batch_id] = found
        return self._records[batch_id]

    def _head(self) -> int:
        """The last batch known to be committed, -1 without one."""
        return max((int(n.split(".")[0]) for n in self._folder.names("heads") if n[:1].isdigit()), default=-1)

    def _since(self, after: int) -> list[dict]:
        """Commit records of the batches later than ``after``, each the next one's predecessor.

        The head may be one behind, if a writer stopped between record and head.
        """
        head, found = self._head(), []
        while (record := self._record(after + 1 + len(found))) is not None:
            found.append(record)
        last = after + len(found)
        if last < head:
            raise ValueError(f"commit records are missing under {self.root}: batch {last + 1} is not there, batch {head} is committed")
        for one, number in zip(found, range(after + 1, last + 1)):
            if one["batch_id"] != number or one["follows"] != number - 1:
                raise ValueError(f"the commit record of batch {number} under {self.root} is one of batch {one['batch_id']}")
        return found

    def committed_batches(self, after: int = -1) -> list[int]:
        """Committed batches later than ``after``. Records before the last fold may be gone."""
        return [r["batch_id"] for r in self._since(after)]

    def notices(self) -> DataFrame:
        """Change notices: per batch and view the number of changed groups and the time."""
        if not self._folder.exists("commits"):
            return self.spark.createDataFrame([], NOTICE)
        stored = T.StructType([NOTICE["batch_id"], NOTICE["feed"], NOTICE["committed_at"], T.StructField("keys_changed", T.MapType(T.StringType(), T.LongType()))])
        read = self.spark.read.schema(stored).json(f"{self.root}/commits")
        return read.select("*", F.explode("keys_changed").alias("view", "n")).select(
            "view", F.col("n").alias("keys_changed"), "committed_at", "feed", "batch_id"
        )

    # --- manifests ------------------------------------------------------------------------

    def _manifests(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._folder.names("manifests") if n[:1].isdigit())

    def _manifest(self, upto: int | None = None) -> dict:
        """The newest manifest, or the one as of a batch; an empty one if there is none."""
        if upto is None:
            upto = max(self._manifests(), default=-1)
        empty = {"upto": -1, "months": {}, "buckets": {}, "rejects": [], "marks": {}}
        return empty if upto < 0 else self._folder.read_json(f"manifests/{upto}.json")

    def compacted_upto(self) -> int:
        """Last batch contained in the newest base, -1 without one."""
        return self._manifest()["upto"]

    # --- reading --------------------------------------------------------------------------

    def _paths(self, names: Iterable[str]) -> list[str]:
        return [f"{self.root}/{name}" for name in names]

    def _parquet(self, schema: T.StructType, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._paths(names))

    def view(self, name: str, dates: tuple[int, int] | None = None) -> DataFrame:
        """A view as of now, with ``last_updated``; later batches are not seen.

        ``dates`` (first and last) leaves the files of other months out before anything is read; a
        filter on ``event_date`` alone skips them by their statistics.
        """
        return self.views(name, dates=dates)[name]

    def views(self, *names: str, dates: tuple[int, int] | None = None) -> dict[str, DataFrame]:
        """The named views, or all four, as of the same batch."""
        manifest = self._manifest()
        records = self._since(manifest["upto"])
        return {n: self._view(VIEWS[n], manifest, records, dates) for n in names or VIEWS}

    def _view(self, spec: ViewSpec, manifest: dict, records: list[dict], dates: tuple[int, int] | None) -> DataFrame:
        months = {m: v for m, v in manifest["months"].items() if dates is None or dates[0] // 100 <= int(m) <= dates[1] // 100}
        touched = {m for r in records for m in r["months"]}
        log = [name for r in records for name in r["files"]]
        kind = T.StructType([f for f in DELTA if f.name != "view"])

        def base(chosen: Iterable[str]) -> DataFrame:
            return self._parquet(kind, [f for m in chosen for f in months[m].get(spec.name, [])]).withColumn("view", F.lit(spec.name))

        def within(df: DataFrame) -> DataFrame:
            return df if dates is None else df.filter(F.col("event_date").between(*dates))

        untouched = [m for m in months if m not in touched]
        parts = []
        if untouched or not log:
            parts.append(from_merged(within(base(untouched)), spec, latest="committed_at"))
        if log:
            changed = [m for m in months if m in touched]
            deltas = self._parquet(DELTA, log)
            if changed:
                deltas = base(changed).unionByName(deltas)
            # A single batch has one row per group already.
            build = from_merged if len(records) == 1 and not changed else from_deltas
            parts.append(build(within(deltas), spec, latest="committed_at"))
        return reduce(DataFrame.unionByName, parts)

    def events(self) -> DataFrame:
        """The table as of now: the base without the keys of the log, and what the log leaves of these."""
        manifest = self._manifest()
        return self._table(manifest, self._since(manifest["upto"]))

    def _table(self, manifest: dict, records: list[dict], buckets: set[str] | None = None) -> DataFrame:
        names = [f for b, files in manifest["buckets"].items() if buckets is None or b in buckets for f in files]
        base = self._parquet(EVENT, names)
        log = [f for r in records for f in r.get("table", {}).get("files", [])]
        if not log:
            return base
        images = self._parquet(IMAGE, log)
        if len(records) > 1:  # of one batch there is one image of each key
            images = images.groupBy(KEY).agg(F.max_by(F.struct("deleted", "event"), "batch_id").alias("i")).select(KEY, "i.*")
        entered = images.filter(~F.col("deleted")).select("event.*")
        if not names:
            return entered
        keys = images.select(KEY)
        if sum(r["table"]["rows"] for r in records if "table" in r) > MOST_KEYS:
            keys = keys.hint("merge")
        return base.join(keys, KEY, "left_anti").select(*EVENT.fieldNames()).unionByName(entered)

    def rejects(self) -> DataFrame:
        """The rejected lines of all batches, with the batch."""
        manifest = self._manifest()
        files = [f for r in self._since(manifest["upto"]) for f in r.get("rejects", [])]
        return self._parquet(REJECT, [*manifest["rejects"], *files])

    def freshness(self, since_batch: int = -1) -> DataFrame:
        """Per view: its last change, the batch that made it, and whether that is later than
        ``since_batch``. Also the way to notice new data in old dates."""
        manifest = self._manifest()
        marks = self._marks(manifest, self._since(manifest["upto"]))
        rows = [(v, datetime.datetime.fromisoformat(m["last_updated"]), m["last_batch"], m["last_batch"] > since_batch) for v, m in marks.items()]
        return self.spark.createDataFrame(rows, "view string, last_updated timestamp, last_batch long, updated boolean")

    @staticmethod
    def _marks(manifest: dict, records: list[dict]) -> dict[str, dict]:
        """Last change per view."""
        marks = dict(manifest["marks"])
        for record in records:
            for view, changed in record["keys_changed"].items():
                if changed:
                    marks[view] = {"last_updated": record["committed_at"], "last_batch": record["batch_id"]}
        return marks

    # --- writing --------------------------------------------------------------------------

    def apply(self, changes: DataFrame, batch_id: int, feed: str = "") -> bool:
        """Add one batch of change records to the views, and to the table if the store keeps it;
        False if it was there already."""
        return self._commit(signed(changes), batch_id, feed, changes if self.keeps_table else None)

    def add(self, rows: DataFrame, batch_id: int, feed: str = "") -> bool:
        """Add one batch of signed rows to the views; False if it was there already."""
        if self.keeps_table:
            raise ValueError("signed rows do not say what is left of a key; apply change records")
        return self._commit(rows, batch_id, feed)

    def append_parsed(self, parsed: DataFrame, batch_id: int, feed: str = "") -> bool:
        """Add the events of one batch of parsed lines (``event_text.parse``); False if they were there.

        Ids follow those of the batch before without gaps. Lines are parsed once, into a file of their
        own; ids come from its rows, so a replay gives the same range, and what was committed is
        never numbered again. Lines with a bad field are kept as rejects of the same commit.
        """
        if self._known(batch_id, feed):
            return False
        before = self._record(batch_id - 1)
        first = (before or {}).get("next_id", 1)
        staged = f"staged/batch_id={batch_id}"
        place = F.monotonically_increasing_id()
        placed = parsed.select("*", F.spark_partition_id().alias("part"), place.alias("place"))
        placed.write.mode("overwrite").parquet(f"{self.root}/{staged}")
        stored = self.spark.read.schema(placed.schema).parquet(f"{self.root}/{staged}")
        good = stored.filter("problem IS NULL")
        # One number per task that parsed, however many lines: as many as input splits.
        counts = good.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
        offsets, total = {}, 0
        for row in counts:
            offsets[row["part"]], total = total, total + row["n"]
        events = _numbered(good, offsets, first, self.spark)
        rejected = stored.filter("problem IS NOT NULL").select("value", "problem", F.lit(batch_id).cast("bigint").alias("batch_id"))
        records = changelog.insert_records(events)
        extra = {"first_id": first, "next_id": first + total}
        done = self._commit(signed(records), batch_id, feed, records if self.keeps_table else None, rejected, extra)
        self._folder.remove(staged)
        return done

    def _known(self, batch_id: int, feed: str) -> bool:
        """Whether a batch is committed; refuses batches of another feed, and those that follow none."""
        present = self._record(batch_id)
        before = self._record(batch_id - 1) if batch_id > 0 else present
        for other in (present, before):
            if other is not None and other["feed"] != feed:
                raise ValueError(
                    f"the views under {self.root} are kept from feed {other['feed']!r}, not {feed!r};"
                    " a new checkpoint needs a new root"
                )
        if present is not None:
            self._mark_head(batch_id)  # the writer may have stopped before it
            return True
        if batch_id > 0 and before is None:
            raise ValueError(f"batch {batch_id} follows a batch that is not in {self.root}")
        if self._head() >= batch_id:
            raise ValueError(f"commit records are missing under {self.root}: batch {batch_id} was committed, its record is gone")
        return False

    def _commit(
        self,
        rows: DataFrame,
        batch_id: int,
        feed: str,
        changes: DataFrame | None = None,
        rejected: DataFrame | None = None,
        extra: dict | None = None,
    ) -> bool:
        """One job computes and writes all deltas: sorted where the aggregate leaves them, so its
        shuffle is the only one. The table's images and the rejects follow, the commit record is last."""
        if self._known(batch_id, feed):
            return False
        time = self.clock(batch_id)
        log = f"log/batch_id={batch_id}"
        self._write(self._deltas(rows, time), log, "view", "event_date")
        files = self._folder.files(log)
        counted = self._parquet(DELTA, files).groupBy("view", month_of("event_date").alias("month")).agg(F.count(F.lit(1)).alias("n")).collect()
        record = {
            "batch_id": batch_id,
            "follows": batch_id - 1,
            "feed": feed,
            "committed_at": _text(time),
            "keys_changed": {v: sum(r["n"] for r in counted if r["view"] == v) for v in VIEWS},
            "months": sorted({str(r["month"]) for r in counted}),
            "rows": sum(r["n"] for r in counted),
            "files": files,
            **(extra or {}),
        }
        if changes is not None:
            record["table"] = self._write_images(changes, batch_id)
        if rejected is not None:
            name = f"rejects/batch_id={batch_id}"
            self._write(rejected, name)
            record["rejects"] = self._folder.files(name) if not self._parquet(REJECT, self._folder.files(name)).isEmpty() else []
        if not self._write_record(record):
            raise ValueError(f"another writer committed batch {batch_id} under {self.root}")
        self._mark_head(batch_id)
        return True

    def _write_record(self, record: dict) -> bool:
        """The commit itself; False if the batch has a record."""
        return self._folder.write_json(_record_name(record["batch_id"]), record)

    def _deltas(self, rows: DataFrame, time: datetime.datetime) -> DataFrame:
        stamped = delta(rows).withColumn("committed_at", F.lit(_text(time)).cast("timestamp"))
        return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DELTA])

    def _write(self, df: DataFrame, name: str, *order: str) -> None:
        ordered = df.sortWithinPartitions(*order) if order else df
        ordered.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.root}/{name}")

    def _write_images(self, changes: DataFrame, batch_id: int) -> dict:
        """What the batch leaves of each key it changes, by bucket."""
        after, key = F.col("after"), F.coalesce(F.col("after")[KEY], F.col("before")[KEY])
        # An update that changes the key also takes the old one away.
        moved = F.col("before")[KEY].isNotNull() & after[KEY].isNotNull() & (F.col("before")[KEY] != after[KEY])
        none = F.lit(None).cast(EVENT)
        both = F.when(moved, F.array(F.struct(F.col("before")[KEY].alias("k"), none.alias("e")), F.struct(key.alias("k"), after.alias("e"))))
        each = changes.select("seq", F.explode(F.coalesce(both, F.array(F.struct(key.alias("k"), after.alias("e"))))).alias("i"))
        last = each.groupBy(F.col("i.k").alias(KEY)).agg(F.max_by(F.struct(F.col("i.e")), "seq").alias("last"))
        event = F.col("last")["e"]
        images = last.select(
            KEY, event.alias("event"), event.isNull().alias("deleted"), F.lit(batch_id).cast("bigint").alias("batch_id"), _bucket().alias("bucket")
        )
        name = f"table/log/batch_id={batch_id}"
        self._write(images, name, "bucket", KEY)
        files = self._folder.files(name)
        buckets = self._parquet(IMAGE, files).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        return {"files": files, "buckets": sorted(str(r["bucket"]) for r in buckets), "rows": sum(r["n"] for r in buckets)}

    def _mark_head(self, batch_id: int) -> None:
        self._folder.write_json(f"heads/{batch_id}.json", {"batch_id": batch_id})
        for name in self._folder.names("heads"):
            if name[:1].isdigit() and int(name.split(".")[0]) < batch_id - 1:
                self._folder.remove(f"heads/{name}")

    # --- folding and removing -------------------------------------------------------------

    def compact(self) -> int:
        """Fold the committed batches into the base; returns the last batch in it.

        Only months and buckets that these batches touch are written anew; the new manifest names the
        files of the others again. Groups without rows are left out, and months without groups. Rows are
        range-partitioned by all keys, so a busy day is spread over files.
        """
        before = self._manifest()
        records = self._since(before["upto"])
        if not records:
            return before["upto"]
        upto = records[-1]["batch_id"]
        manifest = {
            "upto": upto,
            "follows": before["upto"],
            "committed_at": _text(self.clock(upto)),
            "months": {**before["months"], **self._fold_views(before, records, upto)},
            "buckets": {**before["buckets"], **self._fold_table(before, records, upto)},
            "rejects": [*before["rejects"], *(f for r in records for f in r.get("rejects", []))],
            "marks": self._marks(before, records),
        }
        for part in ("months", "buckets"):
            manifest[part] = {k: v for k, v in manifest[part].items() if v}
        if not self._folder.write_json(f"manifests/{upto}.json", manifest):
            raise ValueError(f"another fold wrote the base up to {upto} under {self.root}")
        return upto

    def _fold_views(self, before: dict, records: list[dict], upto: int) -> dict[str, dict[str, list[str]]]:
        """Files by month and view of the months that the records touch."""
        touched = sorted({m for r in records for m in r["months"]})
        if not touched:
            return {}
        found = self._parquet(DELTA, [f for r in records for f in r["files"]])
        kind = T.StructType([f for f in DELTA if f.name != "view"])
        for name in VIEWS:
            base = [f for m in touched for f in before["months"].get(m, {}).get(name, [])]
            if base:
                found = found.unionByName(self._parquet(kind, base).withColumn("view", F.lit(name)))
        order = ("view", *ALL_KEYS)
        summed = merge(found, *order, latest="committed_at").withColumn("month", month_of("event_date"))
        place = f"base/version={upto}"
        ordered = summed.repartitionByRange(*order).sortWithinPartitions("month", *order)
        ordered.write.mode("overwrite").partitionBy("month", "view").parquet(f"{self.root}/{place}")
        out: dict[str, dict[str, list[str]]] = {m: {} for m in touched}
        for name in self._folder.files(place):
            month, view = (part.partition("=")[2] for part in name.split("/")[2:4])
            out[month].setdefault(view, []).append(name)
        return out

    def _fold_table(self, before: dict, records: list[dict], upto: int) -> dict[str, list[str]]:
        """Files by bucket of the buckets that the records touch."""
        touched = {b for r in records for b in r.get("table", {}).get("buckets", [])}
        if not touched:
            return {}
        place = f"table/base/version={upto}"
        rows = self._table(before, records, touched).withColumn("bucket", _bucket())
        ordered = rows.repartition("bucket", F.pmod(F.xxhash64(KEY, F.lit(1)), F.lit(_PIECES))).sortWithinPartitions("bucket", KEY)
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{place}")
        out: dict[str, list[str]] = {b: [] for b in touched}
        for name in self._folder.files(place):
            out[name.split("/")[3].partition("=")[2]].append(name)
        return out

    def vacuum(self, grace: datetime.timedelta) -> list[str]:
        """Removes what no reader needs who began at most ``grace`` ago: files that only older manifests
        name, and the log and records before the oldest manifest that is still kept. Returns the names."""
        until = _text(self.clock(self._head()) - grace)
        manifests = self._manifests()
        old = [m for m in manifests if self._manifest(m)["committed_at"] <= until]
        if not old:
            return []
        kept = [self._manifest(m) for m in manifests if m >= old[-1]]
        named = {f for m in kept for views in m["months"].values() for files in views.values() for f in files}
        named |= {f for m in kept for files in m["buckets"].values() for f in files}
        gone = [f"manifests/{m}.json" for m in manifests if m < old[-1]]
        for place in ("base", "table/base"):
            for version in self._folder.names(place):
                if int(version.partition("=")[2]) > old[-1]:
                    continue  # newer, or being written
                for unit in self._folder.names(f"{place}/{version}"):
                    name = f"{place}/{version}/{unit}"
                    if "=" in unit and not any(f.startswith(f"{name}/") for f in named):
                        gone.append(name)
        for place in ("log", "table/log"):
            gone += [f"{place}/{n}" for n in self._folder.names(place) if int(n.partition("=")[2]) <= old[-1]]
        for group in self._folder.names("commits"):
            names = [n for n in self._folder.names(f"commits/{group}") if n[:1].isdigit()]
            gone += [f"commits/{group}/{n}" for n in names if int(n.split(".")[0]) < old[-1]]  # the last one's successor names it
        for name in gone:
            self._folder.remove(name)
        return gone

    def register(self) -> None:
        """Create temporary views under the table names, for SQL reports, as of now."""
        for name, view in self.views().items():
            view.createOrReplaceTempView(VIEWS[name].table)


#: Tasks that write one bucket of the table.
_PIECES = 4


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int")


def _record_name(batch_id: int) -> str:
    return f"commits/group={batch_id // GROUP}/{batch_id}.json"


def _numbered(good: DataFrame, offsets: dict[int, int], first: int, spark: SparkSession) -> DataFrame:
    """Events with ids from ``first`` on: each task's rows after those of the tasks before, in its order."""
    names = [f.name for f in EVENT if f.name != KEY]
    starts = spark.createDataFrame(list(offsets.items()), "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("place"))
    located = good.select("*", within.alias("n")).join(starts, "part")
    return located.select((F.lit(first - 1) + F.col("start") + F.col("n")).alias(KEY), *names)
