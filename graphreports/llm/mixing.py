"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 60-bit hash. Per source, sizes are summed by the leading 12 bits; the bucket in which the running sum
meets the budget is the only one looked at again, by its next 12 bits, and so on until it holds one hash. A document belongs
to the mix if its hash is below the threshold found. Nothing is sorted but the 4,096 sums of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphreports.llm.common import free_names, words
from graphreports.runtime import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEAT = 1.5, 2.0  # of all sizes; of a source's size
BITS, LEVELS = 12, 5


def place(doc_id: Column) -> Column:
    """A document's 60-bit place, the same in every run."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def targets(totals: DataFrame, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """Add ``target`` to one row per source with ``source_size``.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Targets are ``share`` of all sizes by weight; none is above
    ``repeat`` times its source's size, and what is cut off goes to the others by weight.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_cap = Window.orderBy("cap_ratio", F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % 3 + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(repeat) * F.col("source_size")).withColumn("cap_ratio", F.col("cap") / F.col("weight"))
    all_of_it = F.lit(share) * F.sum("source_size").over(everything)
    rest = all_of_it - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = weighed.withColumn("level", rest / F.sum("weight").over(onward))
    free = F.max(F.when(F.col("cap_ratio") >= F.col("level"), F.col("level"))).over(everything)
    return level.select("source", "source_size", F.least(F.col("cap"), free * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """Per source: target, whole passes over it, and the hash below which a document is taken once more.

    ``sized`` has source, size and place. The threshold is on the side of the boundary document that comes nearer the target.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, share, repeat)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = goal.select(
        "source", "source_size", "target", passes.alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("need"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at_edge"),
    )
    for level in range(1, LEVELS + 1):
        edge = cut_lineage(_refine(sized, edge, level))
    more = F.col("need") - F.col("below") > F.col("at_edge") / 2
    return edge.select("source", "source_size", "target", "passes", (F.col("prefix") + more.cast("long")).alias("threshold"))


def _refine(sized: DataFrame, edge: DataFrame, level: int) -> DataFrame:
    """The boundary bucket of each source one level down."""
    e, wide = edge.alias("e"), BITS * (LEVELS - level)
    inside = sized.alias("d").join(
        e.select(F.col("source").alias("of"), "prefix"),
        F.col("d.source").eqNullSafe(F.col("of")) & (F.shiftright("d.place", wide + BITS) == F.col("prefix")),
    )
    sums = inside.groupBy("d.source", F.shiftright("d.place", wide).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("bucket_size").over(upto)).alias("s")
    met = sums.join(e, F.col("s.source").eqNullSafe(F.col("e.source"))).filter("e.below + s.upto > e.need")
    first = met.groupBy(F.col("e.source").alias("source")).agg(F.min(F.struct("s.bucket", "s.upto", "s.bucket_size")).alias("b")).alias("f")
    joined = e.join(first, F.col("e.source").eqNullSafe(F.col("f.source")), "left")
    found = F.col("f.b").isNotNull()
    return joined.select(
        "e.source", "e.source_size", "e.target", "e.passes", "e.need",
        F.when(found, F.col("f.b.bucket")).otherwise(F.shiftleft("e.prefix", BITS)).alias("prefix"),
        F.when(found, F.col("e.below") + F.col("f.b.upto") - F.col("f.b.bucket_size")).otherwise(F.col("e.below")).alias("below"),
        F.when(found, F.col("f.b.bucket_size")).otherwise(0).cast("long").alias("at_edge"),
    )


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and place of each document; a null text has size 0."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), place(F.col("doc_id")).alias("place"))


def plan(docs: DataFrame, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, size, source_size, target, taken (size times the number of passes that take it). Rows that repeat a
    doc_id share a hash and are taken alike; a null doc_id hashes as the empty text; a source without words has target 0; an
    empty table gives no rows; other columns are not read.
    """
    sized = cut_lineage(sized_rows(docs)).alias("d")
    edge = thresholds(sized, share, repeat).alias("e")
    times = F.col("passes") + (F.col("place") < F.col("threshold")).cast("long")
    joined = sized.join(edge, F.col("d.source").eqNullSafe(F.col("e.source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with."""
    edge = thresholds(cut_lineage(sized_rows(docs)), share, repeat).select(F.col("source").alias("of"), "passes", "threshold").alias("e")
    times = F.col("e.passes") + (place(F.col("d.doc_id")) < F.col("e.threshold")).cast("long")
    joined = docs.alias("d").join(edge, F.col("d.source").eqNullSafe(F.col("e.of")))
    (copy,) = free_names(docs, "copy")
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias(copy)).drop(copy)


SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as place
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select source, source_size, 2.0 * source_size as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as weight
  from totals),
levels as (
  select source, source_size, cap, weight,
         (1.5 * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
goals as (
  select source, source_size,
         least(cap, weight * max(case when cap / weight >= level then level end) over ()) as target from levels),
needs as (
  select source, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from goals),
places as (select source, place, sum(size) as here from sized group by source, place),
running as (
  select p.source, p.place, here, sum(here) over (partition by p.source order by place) as upto,
         n.target - n.passes * n.source_size as need
  from places p join needs n on p.source is not distinct from n.source),
taken as (
  select source, place from running
  where upto <= need or (upto - here <= need and upto > need and need - (upto - here) > here / 2.0))
select s.doc_id, cast(s.size as bigint) as size, n.source_size, cast(n.target as double) as target,
       cast(s.size * (n.passes + case when t.place is not null then 1 else 0 end) as bigint) as taken
from sized s join needs n on s.source is not distinct from n.source
left join taken t on s.source is not distinct from t.source and s.place = t.place
"""
