"""Problem 3: records that differ only in formatting, collapsed through an incremental ledger.

The ledger holds, in hash buckets, one row per canonical key: how many copies were seen and the earliest
of them. A batch is aggregated first, then full-outer-joined with the ledger bucket by bucket. The ledger is a bucketed table, so its
rows are not shuffled for that, and what is written is bucketed again without a shuffle. A small batch reads and writes only the buckets
it touches. What belongs to the ledger stands in manifests in its folder, so that later sessions go on with it.

Citations have up to four fields (parties, application number, paragraph, date) in any order. The key
keeps which fields there are and each field without white space, case and punctuation. Nulls and blanks
are no records. Keys are two 64-bit hashes of the canonical text.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.runtime import materialize, scratch_folder

#: English names of months (fixed values).
MONTHS = "january february march april may june july august september october november december".split()
_DATE = rf"(?<!\d)(\d{{1,2}})[^\p{{L}}\p{{N}}]+({'|'.join(MONTHS)})[^\p{{L}}\p{{N}}]+(\d{{4}})(?!\d)"
_PARAGRAPH = r"§[^\p{L}\p{N}]*(\d+)"
_NUMBER = r"(?<![\p{L}\p{N}])no[^\p{L}\p{N}]*(\d+)[^\p{L}\p{N}]*/[^\p{L}\p{N}]*(\d+)"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is made a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", "")


def _taken(s: Column, patterns: list[str], found: list[Column]) -> Column:
    """The fields that the patterns find in turn, each looked for in what the ones before leave; what is left comes first."""
    if not patterns:
        # the words that mark a field are in every number alike
        parties, (date, paragraph, number) = _plain(s), found
        return F.concat_ws("|", parties, number, paragraph, date)
    return _once(F.regexp_extract(s, patterns[0], 0), lambda x: _once(F.replace(s, x, F.lit("|")), lambda rest: _taken(rest, patterns[1:], [*found, _plain(x)])))


def citation_key(citation: Column) -> Column:
    """Canonical text of a citation; null for nulls and blanks."""
    made = _once(F.lower(citation), lambda s: _taken(s, [_DATE, _PARAGRAPH, _NUMBER], []))
    return F.when(citation.rlike(r"\S"), made)


def keyed(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """(k1, k2, id) of the rows with a key and an id, the only thing of them that the ledger needs; written once, so that keys are made once."""
    rows = df.select(key.alias("key"), F.col(row_id).cast("long").alias("id"))
    rows = rows.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(29), "key").alias("k2"), "id", F.col("key").isNotNull().alias("is_record"))
    return materialize(rows, "record-keys").filter("is_record and id is not null").drop("is_record")


class Ledger:
    """Counts per canonical key in hash buckets below a folder.

    A new ledger gets as many buckets as the first batch needs at ROWS_PER_BUCKET keys, and twice as many when it outgrows them.
    An update writes new tables and then a new manifest: a failed one leaves the ledger as it was and can be repeated.
    """

    COLUMNS = "k1 long, k2 long, copies long, first_id long, bucket int"
    ROWS_PER_BUCKET = 2_000_000

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 0):
        self.spark, self.first_buckets = spark, buckets
        self.root = (folder or f"{scratch_folder(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")
        #: Number of buckets, version, keys and copies in all, and for each bucket the version that holds its rows.
        self.state: dict = {"buckets": 0, "version": 0, "keys": 0, "copies": 0, "parts": []}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Ledger:
        """The ledger that an earlier session left in the folder; an empty one if there is none."""
        ledger = cls(spark, folder)
        fs, path = ledger._path("")
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        manifests = sorted(n for n in found if n.startswith("manifest-"))
        if manifests:
            ledger.state = json.loads(spark.read.text(f"{ledger.root}/{manifests[-1]}", wholetext=True).first()[0])
        return ledger

    def _path(self, name: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _save(self, state: dict) -> None:
        # a manifest that exists already is another session's update of the same version, and is not overwritten
        fs, path = self._path(f"manifest-{state['version']:09d}.json")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(state), "utf-8"))
        finally:
            out.close()
        self.state = state

    def _table(self, version: int, buckets: int) -> str:
        """The name under which a version's folder is known to this session as a bucketed table."""
        name = f"ledger_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_v{version}"
        columns = self.COLUMNS.replace("long", "bigint")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (k1, k2) INTO {buckets} BUCKETS LOCATION '{self.root}/v{version}'")
        return name

    def rows(self, touched: list[int] | None = None) -> DataFrame:
        """The ledger, or its rows in some buckets."""
        parts, n = self.state["parts"], self.state["buckets"]
        wanted = range(n) if touched is None else touched
        held: dict[int, list[int]] = {}
        for b in wanted:
            held.setdefault(parts[b], []).append(b)
        out = None
        for version, own in sorted(held.items()):
            rows = self.spark.table(self._table(version, n))
            # the bucket is a constant of each file, so the other files are skipped by their statistics
            rows = rows if len(own) == n else rows.filter(F.col("bucket").isin(own))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.COLUMNS) if out is None else out

    def update(self, batch: DataFrame, small: bool = False) -> None:
        """Add a batch of keyed rows. ``small``: the batch is far smaller than the ledger, so that leaving out untouched buckets pays."""
        fresh = batch.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        n, version = self.state["buckets"], self.state["version"] + 1
        small = small and n > 0
        wanted = max(1, -(-self.state["keys"] // self.ROWS_PER_BUCKET))
        if n == 0 or small:
            fresh = materialize(fresh, "ledger-batch")
        if n == 0:
            wanted = max(1, -(-fresh.count() // self.ROWS_PER_BUCKET))
            # no fewer than a shuffle has, or the ledger would be shuffled to these
            n = self.first_buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), wanted)
        elif wanted > 2 * n:
            n, small = 2 * n, False
        bucket = F.pmod(F.hash("k1", "k2"), F.lit(n)).cast("int")
        touched = [r.b for r in fresh.select(bucket.alias("b")).distinct().collect()] if small else list(range(n))  # at most as many as there are buckets
        old = self.rows(touched if small else None).drop("bucket")
        merged = old.join(fresh, ["k1", "k2"], "full_outer").select(
            "k1", "k2",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
            F.least("first_id", "low").alias("first_id"), bucket.alias("bucket"),
        )
        if self.state["version"] == 0:
            merged = fresh.select("k1", "k2", F.col("n").alias("copies"), F.col("low").alias("first_id"), bucket.alias("bucket")).repartition(n, "k1", "k2")
        name = f"ledger_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_v{version}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        merged.write.format("parquet").mode("overwrite").bucketBy(n, "k1", "k2").option("path", f"{self.root}/v{version}").saveAsTable(name)
        parts = list(self.state["parts"]) if small else [version] * n
        for b in touched:
            parts[b] = version
        before, self.state = self.state, self.state | {"buckets": n, "version": version, "parts": parts}
        try:
            if small:  # keys are an upper bound then
                added = fresh.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
                keys, copies_ = before["keys"] + added[0], before["copies"] + added[1]
            else:
                keys, copies_ = self.rows().agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
            self._save(self.state | {"keys": keys, "copies": copies_})
        except BaseException:
            self.state = before
            raise


def collapse(rows: DataFrame, batches: int = 4) -> Ledger:
    """A ledger of keyed rows, taken in as ``batches`` ranges of the id, each one an update."""
    ledger = Ledger(rows.sparkSession)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ledger
    step = max(1, -(-(high - low + 1) // batches))
    for start in range(low, high + 1, step):
        ledger.update(rows.filter((F.col("id") >= start) & (F.col("id") < start + step)))
    return ledger


def copies(rows: DataFrame, ledger: Ledger) -> DataFrame:
    """(kept_id, copy_id) of every keyed row that is a later copy of another.

    Keys with at least a thousandth of all rows are at most a thousand; these are broadcast, so that the
    rows of a hot key never meet in one task. The others are joined by shuffle.
    """
    entries = ledger.rows().filter("copies > 1").select("k1", "k2", "copies", "first_id")
    limit = max(2, ledger.state["copies"] // 1000)
    # at most a thousand rows of four numbers
    hot, cold = F.broadcast(entries.filter(F.col("copies") > limit)), entries.filter(F.col("copies") <= limit)
    rows = rows.withColumnRenamed("id", "copy_id")
    joined = rows.join(hot, ["k1", "k2"]).unionByName(rows.join(hot, ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"]))
    return joined.filter("first_id < copy_id").select(F.col("first_id").alias("kept_id"), "copy_id")


def collapsed(df: DataFrame, text: str, row_id: str, ledger: Ledger) -> DataFrame:
    """(row id, text, copies): the earliest representative of every record with the number of its copies."""
    entries = ledger.rows().select(F.col("first_id").alias(row_id), "copies")
    return df.select(row_id, text).join(entries, row_id)
