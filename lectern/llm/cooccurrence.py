"""Items that appear together: an incremental pair table.

State in the shared folder, hash-bucketed: baskets (basket, item), marginals (item, n) and
pairs (a, b, n). A change replaces whole baskets. The old and new contents of the changed
baskets give signed marginal and pair deltas, summed before they are merged; only
the buckets they fall into are rewritten, and scores are recomputed for pairs
whose counts or marginals changed.

A pair count can't exceed either marginal. With a wanted support and lift, items below
the support, or in too large a share of the baskets, can't be part of any wanted pair:
they stay in the marginals but emit no pairs. An item that crosses either bound
re-emits its baskets, so the table stays exact.

A manifest, written after the tables of an update, names the files in force, so another session can go on from
it and a failed update leaves the state as it was; superseded files are deleted after that.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialize, remove_path, scratch_path

#: Rows that a bucket is meant to hold, and the fewest buckets.
BUCKET_ROWS = 250_000
BUCKETS = 16
BLOCK = 256
SCHEMAS = {"baskets": "basket string, item string", "marginals": "item string, n long", "pairs": "a string, b string, n long"}
KEYS = {"baskets": ("basket",), "marginals": ("item",), "pairs": ("a", "b")}


def pair_deltas(entries: DataFrame) -> DataFrame:
    """a < b, n: signed counts of the pairs within each basket. entries: basket, item, sign (distinct).

    Baskets over BLOCK items are divided into cells of two blocks each, so no task
    ever holds a whole large basket; counts are combined before the shuffle.
    """
    sizes = entries.groupBy("basket", "sign").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = entries.join(sizes, ["basket", "sign"]).withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    cells = cells.select("basket", "sign", lo.alias("lo"), hi.alias("hi"), "block", "item")
    held = cells.groupBy("basket", "sign", "lo", "hi").agg(
        F.collect_list(F.when(F.col("block") == F.col("lo"), F.col("item"))).alias("left"), F.collect_list(F.when(F.col("block") == F.col("hi"), F.col("item"))).alias("right")
    )
    one = held.select("sign", (F.col("lo") == F.col("hi")).alias("same"), F.explode("left").alias("x"), "right").select("sign", "same", "x", F.explode("right").alias("y"))
    one = one.where((~F.col("same") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return one.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("sign").alias("n")).where("n <> 0")


@dataclass
class PairIndex:
    """The persistent state. min_support and max_share bound the items that emit pairs; 1 and 1.0 keep every pair.

    buckets: of each table; unless given, from the rows of the first load. root: the folder of tables and manifests.
    """

    spark: SparkSession
    min_support: int = 1
    max_share: float = 1.0
    buckets: dict[str, int] = field(default_factory=dict)
    files: dict[str, dict[int, str]] = field(default_factory=lambda: {t: {} for t in SCHEMAS})
    total: int = 0
    version: int = 0
    root: str = ""

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> PairIndex:
        """The state as the last complete update left it."""
        names = [s.getPath().getName() for s in cls._fs(spark, root).listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))]
        last = max(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        saved = json.loads(spark.read.text(f"{root}/{last}", wholetext=True).first()[0])
        saved["files"] = {t: {int(b): p for b, p in part.items()} for t, part in saved["files"].items()}
        return cls(spark, root=root, **saved)

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit(self, files: dict[str, dict[int, str]], total: int) -> None:
        """Write the manifest, take the new state over, delete what no longer belongs to it."""
        state = {"min_support": self.min_support, "max_share": self.max_share, "buckets": self.buckets, "files": files, "total": total, "version": self.version + 1}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest-{self.version + 1:09d}.json")
        fs = self._fs(self.spark, self.root)
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/draft.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.rename(draft, path)
        gone = {p for t in SCHEMAS for p in self.files[t].values()} - {p for t in SCHEMAS for p in files[t].values()}
        earlier = f"{self.root}/manifest-{self.version:09d}.json"
        self.files, self.total, self.version = files, total, self.version + 1
        for p in [*gone, earlier]:
            remove_path(self.spark, p)

    def _read(self, table: str, only: set[int] | None = None, but: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self.files[table].items()) if (only is None or b in only) and (but is None or b not in but)]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def _write(self, rows: DataFrame, table: str, touched: set[int] | None) -> dict[int, str]:
        """Files in force after new versions of the touched buckets (None: all); the others keep theirs."""
        path = f"{self.root}/{table}-{self.version + 1:09d}"
        remove_path(self.spark, path)  # of an update that failed
        n = self.buckets[table]
        rows.withColumn("bucket", self._bucket(table)).repartition(min(n, len(touched) if touched else n), "bucket").write.partitionBy("bucket").parquet(path)
        fs, root = self._fs(self.spark, path), self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.isDirectory() and "=" in s.getPath().getName()}
        kept = {} if touched is None else {b: p for b, p in self.files[table].items() if b not in touched}
        return kept | {b: f"{path}/bucket={b}" for b in there}

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(self.buckets[table])).cast("int").alias("bucket")

    def _touched(self, rows: DataFrame, table: str) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(table)).distinct().collect()}  # at most one row per bucket

    def _eligible(self, n: str, total: int) -> Column:
        return (F.col(n) >= self.min_support) & (F.col(n) <= self.max_share * total + 1e-6)

    def _load(self, entries: DataFrame) -> DataFrame:
        """The first load: entries are basket, item."""
        self.root = self.root or scratch_path(self.spark, "pair-index")
        margin = materialize(entries.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "marginals-new")
        total = entries.select("basket").distinct().count()
        bounded = self.min_support > 1 or self.max_share < 1
        emit = entries.join(margin.where(self._eligible("n", total)).select("item"), "item") if bounded else entries
        pairs = materialize(pair_deltas(emit.select("basket", "item", F.lit(1).alias("sign"))), "pair-deltas")
        tables = {"baskets": entries, "marginals": margin, "pairs": pairs}
        for t, rows in tables.items():
            if t not in self.buckets:
                self.buckets[t] = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
        self._commit({t: self._write(rows, t, None) for t, rows in tables.items()}, total)
        return self.scores()

    def _crossing(self, margin: DataFrame, touched: set[int], total: int) -> DataFrame:
        """item, before, after: the items that cross a bound. Those outside the touched buckets can only do so by the total, so a range of counts is read."""
        flags = lambda r: r.select("item", self._eligible("was", self.total).alias("before"), self._eligible("n", total).alias("after"))
        out = flags(margin)
        if total != self.total and self.max_share < 1:
            low, high = sorted((self.max_share * self.total + 1e-6, self.max_share * total + 1e-6))
            rest = self._read("marginals", but=touched).where((F.col("n") > low) & (F.col("n") <= high))
            out = out.unionByName(flags(rest.select("item", "n", F.col("n").alias("was"))))
        return out.where("before <> after")

    def update(self, changed: DataFrame) -> DataFrame:
        """Replace baskets by their new contents and return the recomputed scores of the pairs affected.

        changed: basket, item; a changed basket comes whole, a removed one with a null item.
        Null baskets are ignored, repeated rows count once. Returns a, b, n, n_a, n_b, ratio.
        """
        changed = materialize(changed.where(F.col("basket").isNotNull()).select("basket", "item").distinct(), "changed")
        new = changed.where(F.col("item").isNotNull())
        if not self.version:
            return self._load(new)
        names = changed.select("basket").distinct()
        touched = self._touched(names, "baskets")
        stored = self._read("baskets", touched)
        old = materialize(stored.join(names, "basket", "left_semi"), "old")
        total = self.total + new.select("basket").distinct().count() - old.select("basket").distinct().count()
        signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        items = materialize(signed.groupBy("item").agg(F.sum("sign").alias("d")).where("d <> 0"), "item-deltas")
        item_touched = self._touched(items, "marginals")
        margin = self._read("marginals", item_touched).join(items, "item", "full")
        margin = materialize(margin.select("item", (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"), F.coalesce("n", F.lit(0)).alias("was")), "marginals-new")
        entries = signed
        if self.min_support > 1 or self.max_share < 1:
            crossing = materialize(self._crossing(margin, item_touched, total), "crossing")
            again = new.limit(0)
            if not crossing.isEmpty():
                kept = self._read("baskets").join(names, "basket", "left_anti")
                again = materialize(kept.join(kept.join(crossing.select("item"), "item", "left_semi").select("basket").distinct(), "basket", "left_semi"), "again")
            affected = signed.select("item").union(again.select("item")).distinct()
            known = margin.unionByName(self._read("marginals", but=item_touched).select("item", "n", F.col("n").alias("was"))).join(affected, "item", "left_semi")
            flags = materialize(known.select("item", self._eligible("was", self.total).alias("before"), self._eligible("n", total).alias("after")), "bounds")
            after = new.unionByName(again).join(flags.where("after").select("item"), "item", "left_semi").withColumn("sign", F.lit(1))
            before = old.unionByName(again).join(flags.where("before").select("item"), "item", "left_semi").withColumn("sign", F.lit(-1))
            entries = after.unionByName(before)
        deltas = materialize(pair_deltas(entries.select("basket", "item", "sign")), "pair-deltas")
        pair_touched = self._touched(deltas, "pairs")
        pairs = self._read("pairs", pair_touched).unionByName(deltas).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")
        left = stored.join(names, "basket", "left_anti").unionByName(new)
        moved = margin.where("n <> was").select("item")
        files = {"pairs": self._write(pairs, "pairs", pair_touched), "marginals": self._write(margin.where("n > 0").select("item", "n"), "marginals", item_touched), "baskets": self._write(left, "baskets", touched)}
        same_total = total == self.total
        self._commit(files, total)
        full = self.scores()
        if not same_total:
            return full
        by_count = full.join(deltas.select("a", "b"), ["a", "b"], "left_semi")
        by_a, by_b = full.join(moved.withColumnRenamed("item", "a"), "a", "left_semi"), full.join(moved.withColumnRenamed("item", "b"), "b", "left_semi")
        return by_count.unionByName(by_a).unionByName(by_b).distinct()

    def scores(self) -> DataFrame:
        """a, b, n, n_a, n_b, ratio: every stored pair; ratio = n * baskets / (n_a * n_b), its count over the one expected by chance."""
        pairs, m = self._read("pairs"), self._read("marginals")
        out = pairs.join(m.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(m.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        ratio = F.col("n") * F.lit(float(self.total)) / (F.col("n_a").cast("double") * F.col("n_b"))
        return out.select("a", "b", "n", "n_a", "n_b", ratio.alias("ratio"))


def note_entities(triples: DataFrame) -> DataFrame:
    """basket, item: the entities of each note, stripped of spaces and lower-cased; null and empty ones and null notes don't count."""
    item = F.explode(F.array("subject", "object"))
    rows = triples.where(F.col("note_path").isNotNull()).select(F.col("note_path").alias("basket"), item.alias("item"))
    return rows.select("basket", F.lower(F.trim("item")).alias("item")).where(F.length("item") > 0).distinct()


def entity_pairs(triples: DataFrame, min_support: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """entity_a < entity_b, weight (notes with both), ratio to chance: all pairs with the support and ratio or more."""
    index = PairIndex(triples.sparkSession, min_support, 1 / min_ratio if min_ratio > 1 else 1.0)
    scores = index.update(note_entities(triples))
    wanted = scores.where((F.col("n") >= min_support) & (F.col("n") * F.lit(index.total) >= F.lit(float(min_ratio)) * F.col("n_a") * F.col("n_b")))
    return wanted.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("n").alias("weight"), "ratio")
