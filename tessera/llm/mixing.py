"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i is the point i times the golden ratio, modulo 1. Points fall through the cumulated targets onto sources, so any
run of slots holds each source in its share. A source's slots are ranked; its documents, shuffled by a hash and laid end
to end, are cut into blocks of equal words; and slot r of a source joins its block r modulo the number of blocks. What a
document gives is the words of its pieces times the slots of their blocks.

Ranks and offsets are prefix sums in two levels (slot ranges, hash ranges), so a source with most of the rows is spread
over all tasks. Only the table of sources, one row each, is collected.

Targets: weights 5, 2, 1, repeating over the sources in code-point order, null last, share the size of all sources. A
target stops at `MOST` times its source's size, and the excess is shared again by weight until none is above. No slot
takes a source's block more than `MOST` times.

Defined results: a null or blank text has size 0 and gives 0 words. A null source is a source. Null doc_ids and repeated
rows are kept; repeated rows are equal but may give different words, as each has its own place. An empty table gives no
rows. Columns besides doc_id, source and text aren't read by `taken`, and pass `mix` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, partitions, release, work_path
from .sharding import HASH_BITS, row_hash

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Slots that a mix has at least, if it has so many words; words of a block at most.
SLOTS, BLOCK = 1 << 16, 1 << 16
GOLDEN, POINT_BITS = 2654435769, 32
#: The line of points is cut into cells of so many bits; a point looks at its cell's sources only.
CELL_BITS = 12
#: Sources of a mix at most; their table is collected and sent to all tasks.
MOST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[tuple[int, str | None, int, float]]:
    """(k, source, size, target), by source in code-point order, null last."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(ordered))]
    total, capped = sum(n for _, n in ordered), set()
    while True:
        rest = total - most * sum(ordered[k][1] for k in capped)
        shared = sum(w for k, w in enumerate(weight) if k not in capped)
        share = rest / shared if shared else 0.0
        over = {k for k in range(len(ordered)) if k not in capped and share * weight[k] > most * ordered[k][1]}
        if not over:
            return [(k, s, n, float(most * n) if k in capped else share * weight[k]) for k, (s, n) in enumerate(ordered)]
        capped |= over


class Mix:
    """The schedule of a table of (row, doc_id, source, size, hash); row is any key of a row."""

    def __init__(self, rows: DataFrame):
        spark = self.spark = rows.sparkSession
        by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(by_source) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources; mix groups of them")
        self.sources = targets([(r.source, r.size) for r in by_source])
        self.total, n_rows = sum(s[2] for s in self.sources), sum(r.n for r in by_source)
        self.block = max(1, min(self.total >> SLOTS.bit_length() - 1, BLOCK))
        self.hash_bits = max(2, n_rows.bit_length() // 2)
        table = spark.createDataFrame([(k, s, n, t, -(-n // self.block)) for k, s, n, t in self.sources], "k int, source_ string, source_size long, target double, n_blocks long")
        self.table = F.broadcast(table)
        self.rows = rows.join(self.table, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    def places(self) -> DataFrame:
        """Rows of a size above 0 with `at`, the words of the source before them."""
        rows = self.rows.filter("size > 0").withColumn("range", F.expr(f"shiftright(hash, {HASH_BITS - self.hash_bits})"))
        base = rows.groupBy("k", "range").agg(F.sum("size").alias("held"))
        base = base.select("k", "range", (F.sum("held").over(Window.partitionBy("k").orderBy("range")) - F.col("held")).alias("base"))
        own = Window.partitionBy("k", "range").orderBy("hash", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
        before = rows.withColumn("before", F.sum("size").over(own) - F.col("size"))
        return before.join(base, ["k", "range"]).withColumn("at", F.col("base") + F.col("before")).drop("range", "base", "before")

    def slots(self) -> DataFrame:
        """(slot, k, block) of all slots."""
        n = -(-self.total // self.block)
        range_bits = max(4, n.bit_length() // 2)
        cumulated, edges = 0.0, []
        for *_, target in self.sources:
            cumulated += target
            edges.append(int(cumulated / self.total * (1 << POINT_BITS)) if self.total else 0)
        if edges:
            edges[-1] = 1 << POINT_BITS
        # each source's stretch of points, once for each cell of the line that it meets
        shift = POINT_BITS - CELL_BITS
        stretches = [(k, low, high, cell) for k, (low, high) in enumerate(zip([0, *edges], edges)) for cell in (range(low >> shift, (high - 1 >> shift) + 1) if high > low else ())]
        stretches = F.broadcast(self.spark.createDataFrame(stretches, "k int, low long, high long, cell long"))
        # multiplied in two halves, which stay within a long for any slot
        point = F.expr(f"((id & 4294967295L) * {GOLDEN}L) & {(1 << POINT_BITS) - 1}L")
        slots = self.spark.range(n).withColumn("point", point).withColumn("cell", F.expr(f"shiftright(point, {shift})"))
        slots = slots.join(stretches, "cell").filter("low <= point and point < high").select(F.col("id").alias("slot"), "k", F.expr(f"shiftright(id, {range_bits})").alias("range"))
        base = slots.groupBy("k", "range").count()
        base = base.select("k", "range", (F.sum("count").over(Window.partitionBy("k").orderBy("range")) - F.col("count")).alias("base"))
        ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("k", "range").orderBy("slot")) - 1).join(base, ["k", "range"])
        ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).join(self.table.select("k", "n_blocks"), "k")
        return ranked.filter(F.col("rank") < MOST * F.col("n_blocks")).select("slot", "k", F.expr("rank % n_blocks").alias("block"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of each row."""
        times = self.slots().groupBy("k", "block").agg(F.count("*").alias("times"))
        end, width = F.col("at") + F.col("size"), self.block
        pieces = self.places().withColumn("block", F.explode(F.sequence(F.expr(f"at div {width}"), F.expr(f"(at + size - 1) div {width}"))))
        pieces = pieces.withColumn("words", F.least(end, (F.col("block") + 1) * width) - F.greatest("at", F.col("block") * width))
        given = pieces.join(times, ["k", "block"], "left").groupBy("k", "at").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        empty = self.rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        return given.select(columns).unionByName(empty.select(columns))

    def order(self) -> DataFrame:
        """(row, slot, at): a row for each time that a document starts in a slot's block."""
        return self.places().select("row", "k", "at", F.expr(f"at div {self.block}").alias("block")).join(self.slots(), ["k", "block"]).select("row", "slot", "at")


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def taken(docs: DataFrame) -> DataFrame:
    return Mix(materialize(_rows(docs, F.monotonically_increasing_id()), "sizes")).taken()


def mix(docs: DataFrame) -> DataFrame:
    """The documents in the order of the schedule, each as often as it is taken up, with the columns of `docs`, whatever
    their names. A document belongs to the block in which it starts, so what a source gives differs from its target by
    less than a document at each end of a block."""
    spark = docs.sparkSession
    paths = [work_path(spark, "mix") for _ in range(4)]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("id"))
    held = materialize(held, "", paths[0])
    order = Mix(materialize(_rows(held.select("id", "row.doc_id", "row.text", "row.source"), F.col("id")), "", paths[1])).order()
    order = materialize(order.withColumnRenamed("row", "id"), "", paths[2])
    drop_path(spark, paths[1])
    release(spark)
    # written, so that the texts of this join are off the disk when they are put in order
    found = materialize(held.join(order, "id").drop("id"), "", paths[3])
    for path in (paths[0], paths[2]):
        drop_path(spark, path)
    release(spark)
    return found.repartitionByRange(partitions(spark), "slot", "at").sortWithinPartitions("slot", "at").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op7_golden_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM rows GROUP BY source),
weighted AS (SELECT *, {list(WEIGHTS)}[k % {len(WEIGHTS)} + 1] AS w FROM sources),
ordered AS (
  SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total,
         CAST(sum(n) OVER () - {MOST} * (sum(n) OVER o - n) AS DOUBLE) / CAST(sum(w) OVER () - (sum(w) OVER o - w) AS DOUBLE) AS share, row_number() OVER o AS place
  FROM weighted WINDOW o AS (ORDER BY n / CAST(w AS DOUBLE), k ROWS UNBOUNDED PRECEDING)),
shared AS (SELECT share FROM ordered WHERE share * w <= {MOST} * n ORDER BY place LIMIT 1),
goals AS (
  SELECT k, source, n, total, CASE WHEN s.share * w > {MOST} * n THEN CAST({MOST} * n AS DOUBLE) ELSE s.share * w END AS target,
         greatest(1, least(total >> {SLOTS.bit_length() - 1}, {BLOCK})) AS block FROM ordered, shared s),
edges AS (SELECT k, CASE WHEN k = max(k) OVER () THEN 1::BIGINT << {POINT_BITS} ELSE CAST(floor(sum(target) OVER (ORDER BY k) / total * (1::BIGINT << {POINT_BITS})) AS BIGINT) END AS edge FROM goals),
points AS (SELECT id, id * {GOLDEN} % (1::BIGINT << {POINT_BITS}) AS point FROM (SELECT unnest(range((SELECT CAST(ceil(any_value(total) / CAST(any_value(block) AS DOUBLE)) AS BIGINT) FROM goals))) AS id)),
falls AS (SELECT id, (SELECT min(k) FROM edges WHERE edge > point) AS k FROM points),
ranked AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS rank FROM falls),
slots AS (
  SELECT k, rank % n_blocks AS b, count(*) AS times FROM ranked JOIN (SELECT k, CAST(ceil(n / CAST(block AS DOUBLE)) AS BIGINT) AS n_blocks FROM goals) USING (k)
  WHERE rank < {MOST} * n_blocks GROUP BY 1, 2),
places AS (
  SELECT r.doc_id, r.size, g.k, g.block, CAST(sum(r.size) OVER (PARTITION BY g.k ORDER BY r.hash, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS BIGINT) AS begins, r.hash
  FROM rows r JOIN goals g ON g.source IS NOT DISTINCT FROM r.source WHERE r.size > 0),
pieces AS (SELECT *, unnest(range(begins // block, (begins + size - 1) // block + 1)) AS b FROM places),
given AS (
  SELECT k, begins, any_value(doc_id) AS doc_id, CAST(sum((least(begins + size, (b + 1) * block) - greatest(begins, b * block)) * coalesce(times, 0)) AS BIGINT) AS taken
  FROM pieces LEFT JOIN slots USING (k, b) GROUP BY k, begins)
SELECT p.doc_id, p.size, g.n AS source_size, g.target, v.taken FROM places p JOIN goals g USING (k) JOIN given v USING (k, begins)
UNION ALL SELECT r.doc_id, r.size, g.n, g.target, 0 FROM rows r JOIN goals g ON g.source IS NOT DISTINCT FROM r.source WHERE r.size = 0
"""
