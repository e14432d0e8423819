"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, the source's target over
its size. Documents are laid out by size, largest first; the prefix sums of the expected
copies, shifted by one random offset for the source, cross an integer once for each copy
that is emitted. Since sizes fall along the order, the words taken miss the target by a few
documents' size at most.

The prefix sums need no single ordered pass: documents fall in cells of a source, a size
class (64 for each power of two) and a number made of id and length; cell counts are summed by class within
a source, by remainder within a class, and documents are ranked within a cell.

Defined results: null or blank text has size 0, is laid out like any other and takes no
words. A null source is a source of its own, last in the order; an empty name is another.
Repeated rows are separate documents. No words at all: every target is 0. An empty table
gives no rows. Added names replace columns that are called the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomdex.llm.common import materialize, named_again, numbered_columns, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
CELL_ROWS = 1_000_000
FEWEST_CELLS = 16
_PRIME, _MIXER = 2_147_483_647, 1_327_217_885
ADDED = ("size", "source_size", "target", "copies")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_class(size: Column) -> Column:
    """Exact below 128, then 64 classes for each power of two; grows with size."""
    power = F.length(F.bin(size)) - 7
    return F.when(size < 128, size).otherwise(power.cast("long") * 64 + F.call_function("shiftright", size, power))


def targets(sources: DataFrame) -> DataFrame:
    """sources (mix_named, mix_source, source_size) with target and factor: one row a source.

    Capping at MOST times the size and resharing by weight until none is above ends where
    every source has the lesser of its cap and one common level times its weight. Sources
    below that level are the first ones in the order of cap over weight.
    """
    order = Window.orderBy(F.desc("mix_named"), "mix_source")
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (place + 1).cast("int"))
    t = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MOST)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.desc("mix_named"), "mix_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "light": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all_size": F.sum(F.col("source_size").cast("double")).over(everything),
        "all_weight": F.sum("weight").over(everything),
    })
    t = t.withColumn("level", (F.col("all_size") - F.col("full")) / (F.col("all_weight") - F.col("light")))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    t = t.withColumn("common", F.coalesce(level, F.lit(float("inf"))))
    capped = F.col("ratio") <= F.col("common")
    target = F.when(capped, F.col("cap")).otherwise(F.col("common") * F.col("weight"))
    factor = F.when(F.col("source_size") == 0, 0.0).when(capped, float(MOST)).otherwise(target / F.col("source_size"))
    key = F.concat(F.lit(f"{SEED}|"), F.when(F.col("mix_named"), F.concat(F.lit("s"), "mix_source")).otherwise("n"))
    offset = F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0
    return t.select("mix_named", "mix_source", "source_size", target.alias("target"), factor.alias("factor"), offset.alias("offset"))


def _spread(id_: Column, text: Column) -> Column:
    """A number of id and length, mixed: null ids, or ids of one remainder, don't share a cell."""
    number = F.pmod(F.coalesce(id_.cast("long"), F.lit(0)), F.lit(_PRIME)) * 31 + F.length(text)
    return F.floor(F.pmod(number, F.lit(_PRIME)) * F.lit(_MIXER) / F.lit(65536)).cast("long")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies (0 to MOST)."""
    given = docs.drop(*ADDED)
    docs = numbered_columns(given)
    names = docs.columns
    id_col, text_col, source_col = (f"c{given.columns.index(c)}" for c in (id_col, text_col, source_col))
    keys = ["mix_named", "mix_source", "mix_class", "mix_cell"]
    d = docs.withColumns({"size": words(text_of(text_col)), "mix_named": F.col(source_col).isNotNull(), "mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})
    d = d.withColumn("mix_class", size_class(F.col("size")))
    remainder = _spread(F.col(id_col), text_of(text_col))
    fine = materialize(
        d.groupBy("mix_named", "mix_source", "mix_class", F.pmod(remainder, F.lit(FEWEST_CELLS)).alias("mix_cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")),
        "mix-cells",
    )
    total = fine.agg(F.sum("n")).first()[0] or 0
    cells = max(FEWEST_CELLS, -(-total // CELL_ROWS))
    d = d.withColumn("mix_cell", F.pmod(remainder, F.lit(cells)))
    if cells != FEWEST_CELLS:
        fine = materialize(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells")
    sources = materialize(targets(fine.groupBy("mix_named", "mix_source").agg(F.sum("words").alias("source_size"))), "mix-targets")
    classes = fine.groupBy("mix_named", "mix_source", "mix_class").agg(F.sum("n").alias("n"))
    by_class = Window.partitionBy("mix_named", "mix_source").orderBy(F.desc("mix_class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("above", F.coalesce(F.sum("n").over(by_class), F.lit(0))).drop("n")
    by_cell = Window.partitionBy("mix_named", "mix_source", "mix_class").orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = fine.withColumn("beside", F.coalesce(F.sum("n").over(by_cell), F.lit(0))).drop("n", "words")
    placed = placed.join(classes, keys[:3]).join(sources, keys[:2])
    placed = placed.select(*keys, (F.col("above") + F.col("beside")).alias("mix_before"), "source_size", "target", "factor", "offset")
    within = Window.partitionBy(*keys).orderBy(F.desc("size"), id_col, F.xxhash64(*([c for c in (id_col, source_col, text_col) if c in names])))
    ranked = d.withColumn("mix_rank", F.row_number().over(within))
    out = ranked.join(placed.withColumnsRenamed({"source_size": "mix_ss", "target": "mix_t", "factor": "mix_f", "offset": "mix_o", "mix_before": "mix_b"}), keys)
    last = F.col("mix_b") + F.col("mix_rank")

    def crossed(n: Column) -> Column:
        return F.floor(F.col("mix_o") + n.cast("double") * F.col("mix_f"))

    copies = F.least(crossed(last) - crossed(last - 1), F.lit(MOST)).cast("long")
    return out.select(*named_again(given), "size", F.col("mix_ss").alias("source_size"), F.col("mix_t").alias("target"), copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: each document as many times as it was drawn, with the columns of docs."""
    plain = numbered_columns(docs)
    columns = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    drawn = mix_counts(plain, *columns).filter("copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*named_again(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST(floor(((((coalesce(doc_id, 0) % {_PRIME}) + {_PRIME}) % {_PRIME} * 31 + length(coalesce(text, ''))) % {_PRIME}) * {_MIXER}::BIGINT / 65536.0::DOUBLE) AS BIGINT) AS rid FROM documents),
c AS (SELECT *, CASE WHEN size < 128 THEN size ELSE (length(bin(size)) - 7) * 64 + (size >> (length(bin(size)) - 7)) END AS cls FROM d),
n AS (SELECT greatest({FEWEST_CELLS}, CAST(ceil(count(*) / {CELL_ROWS}.0) AS BIGINT)) AS cells FROM d),
r AS (SELECT c.*, row_number() OVER (PARTITION BY named, src ORDER BY cls DESC, ((rid % cells) + cells) % cells, size DESC, doc_id) AS k FROM c, n),
s AS (SELECT named, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY named, src),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY named DESC, src) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight,
    CAST(source_size AS DOUBLE) * {MOST} AS cap FROM s),
v AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl
    FROM v WINDOW b AS (ORDER BY ratio, named DESC, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT lvl FROM l WHERE lvl <= ratio ORDER BY ratio, lvl LIMIT 1) AS common FROM l),
t AS (SELECT named, src, source_size, CASE WHEN ratio <= common THEN cap ELSE common * weight END AS target,
    CASE WHEN source_size = 0 THEN 0.0 WHEN ratio <= common THEN {MOST}.0 ELSE common * weight / source_size END AS factor,
    CAST(('0x' || substr(md5('{SEED}|' || CASE WHEN named THEN 's' || src ELSE 'n' END), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS o FROM f)
SELECT doc_id, size, source_size, target,
    size * CAST(least(floor(o + k * factor) - floor(o + (k - 1) * factor), {MOST}) AS BIGINT) AS taken
FROM r JOIN t USING (named, src)
"""
