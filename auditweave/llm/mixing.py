"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source_size`` times; whole copies are certain, the fraction left is a
probability. Within leaves of ``FAN`` documents two fractional documents at a time meet: words of probability mass move
from one to the other, at random in such a direction that expectations stay, until one of the two is integral. Each leaf
leaves one fractional document at most; these meet in the next level, ``FAN`` leaves together, up to one for each source
(a distributed reduction tree, log_FAN levels, every group bounded). The source's last fraction is rounded to the nearest
copy, and the words so gained or lost are settled against the one document whose size fits them best.

Only DataFrame functions are used. Random numbers are hashes of doc_id, text and, for rows equal in both, their number, so
reruns agree and no leaf grows with repeated ids. Edge cases: a null source is a source of its own, last in order; null and
empty texts have size 0 and are never taken; a text of any length is one document; null and repeated doc_ids and repeated
rows are documents of their own; ties go by these hashes; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.shared import cut, unused

WORD = r"[^\x20\x09-\x0D]+"
FAN, MOST, SEED = 64, 3, 20240229
#: A source table of so many rows at most (a few MB) is broadcast; a longer one is joined by its key.
BROADCAST_SOURCES = 50_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds sums over all rows before this one in the order: by ranges, then over the totals of the ranges (a row a partition)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(*(F.sum(c).alias(f"{k}_all") for k, c in sums.items()))
    offsets = totals.select("range", *(F.coalesce(F.sum(f"{k}_all").over(before(Window.orderBy("range"))), F.lit(0)).alias(f"{k}_off") for k in sums))
    inside = before(Window.partitionBy("range").orderBy(*order))
    return placed.join(F.broadcast(offsets), "range").select(*rows.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{k}_off")).alias(k) for k, c in sums.items()))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, n, target: shares by weight of all sizes, stopped at ``most`` times the source's size.

    Reshared excess settles at one level of words per weight; the sources that stop are those with the least size per weight."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    name = F.col("source").asc_nulls_last()
    s = running(s, [name], place=F.lit(1))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("room", F.col("cap") / F.col("weight"))
    s = cut(running(s, [F.col("room"), name], capped=F.col("cap"), used=F.col("weight")))
    words, shares = s.agg(F.sum("source_size"), F.sum("weight")).first()
    s = s.withColumn("level", (F.lit(float(words or 0)) - F.col("capped")) / (F.lit(float(shares or 0)) - F.col("used")))
    level = s.agg(F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level")))["level"]).first()[0]
    return s.select("source", "source_size", "n", F.least(F.col("cap"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``k``: which of the rows equal in source, doc_id and text it is, from 0. One task sees such rows of one partition of the input only."""
    key = ["source", "doc_id", "th"]
    if not rows.groupBy(*key).count().filter("count > 1").limit(1).count():
        return rows.withColumn("k", F.lit(0).cast("long"))
    rows = rows.withColumn("dealt", F.shiftright("rid", 33))
    before = Window.partitionBy(*key).orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key, "dealt").agg(F.count("*").alias("many")).select(*(F.col(c).alias(f"of_{c}") for c in [*key, "dealt"]), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("off"))
    own = (F.row_number().over(Window.partitionBy(*key, "dealt").orderBy("rid")) - 1).cast("long")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*key, "dealt"]]
    return rows.withColumn("own", own).join(offsets, same).withColumn("k", F.col("own") + F.col("off")).select(*[c for c in rows.columns if c != "dealt"], "k")


def bind(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def settle(members: Column, depth: int) -> Column:
    """Folds an array of fractional documents pairwise; gives all of them, settled but for the last."""

    def meet(acc: Column, e: Column) -> Column:
        c = acc["carry"]

        def outcome(m: Column) -> Column:
            give = m["u"] * (m["to_c"] + m["to_e"]) < m["to_e"]  # mass goes to the carried document
            c_full, e_void = m["to_c"] == (1 - c["pi"]) * c["size"], m["to_c"] == e["pi"] * e["size"]
            c_void = m["to_e"] == c["pi"] * c["size"]
            return F.when(give & c_full, made(c, 1.0, e, e["pi"] - m["to_c"] / e["size"])).when(give & e_void, made(e, 0.0, c, c["pi"] + m["to_c"] / c["size"])).when(
                ~give & c_void, made(c, 0.0, e, e["pi"] + m["to_e"] / e["size"])
            ).otherwise(made(e, 1.0, c, c["pi"] - m["to_e"] / c["size"]))

        def made(done: Column, pi: float, left: Column, left_pi: Column) -> Column:
            return F.struct(
                F.struct(*[left[k].alias(k) for k in ("h", "doc_id", "size", "rid")], F.least(F.greatest(left_pi, F.lit(0.0)), F.lit(1.0)).alias("pi"), F.lit(False).alias("settled")).alias("carry"),
                F.concat(acc["done"], F.array(F.struct(*[done[k].alias(k) for k in ("h", "doc_id", "size", "rid")], F.lit(pi).alias("pi"), F.lit(True).alias("settled")))).alias("done"),
            )

        mass = F.struct(
            F.least((1 - c["pi"]) * c["size"], e["pi"] * e["size"]).alias("to_c"), F.least(c["pi"] * c["size"], (1 - e["pi"]) * e["size"]).alias("to_e"),
            (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(depth), c["h"], e["h"]), 11) / float(1 << 53)).alias("u"),
        )
        return bind(mass, outcome)

    first = F.struct(members[0].alias("carry"), F.slice(members, 1, 0).alias("done"))
    return bind(F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), first, meet), lambda a: F.array_append(a["done"], a["carry"]))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, keep_key: bool = False) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    rows = cut(sized(docs, id_col, text_col, source_col))
    sources = cut(source_targets(rows, weights, most))
    n_sources, largest = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda x: x
    renamed = hint(sources.withColumnRenamed("source", "of"))
    rows = rows.join(renamed, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    times = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("times", times).withColumn("whole", F.floor(F.col("times") + 1e-9).cast("int")).withColumn("pi", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0)))
    part = F.col("pi") > 1e-9
    leaves = F.ceil(F.col("n") / FAN).cast("long")
    own = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "th", "k")
    at = numbered(rows.filter(part)).select("source", F.pmod(own(SEED), leaves).alias("leaf"), F.struct(own(SEED + 1).alias("h"), "doc_id", "size", "rid", "pi", F.lit(False).alias("settled")).alias("d"))
    depth, width, done = 0, -(-largest // FAN), []
    while largest:
        group = at.groupBy("source", "leaf").agg(F.array_sort(F.collect_list("d")).alias("members"))
        after = cut(group.select("source", "leaf", F.explode(settle(F.col("members"), depth)).alias("d")))
        done.append(after.filter("d.settled").select("source", "d"))
        at = after.filter("not d.settled").select("source", F.floor(F.col("leaf") / FAN).alias("leaf"), "d")
        if width <= 1:
            break
        depth, width = depth + 1, -(-width // FAN)
    if done:
        settled = done[0]
        for more in done[1:]:
            settled = settled.union(more)
        last = at.select(F.col("source").alias("of"), (F.col("d.size") * (F.round("d.pi") - F.col("d.pi"))).alias("over"))
        fit = settled.join(hint(last), F.col("source").eqNullSafe(F.col("of"))).filter((F.col("over") != 0) & ((F.col("d.pi") == 1.0) == (F.col("over") > 0)))
        off = F.abs(F.col("d.size") - F.abs("over"))
        partner = fit.filter(off < F.abs("over")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "d")).alias("m")).select(F.col("m.d.rid").alias("rid"), F.lit(1.0 - F.col("m.d.pi")).alias("turned"))
        copies = settled.select("d.rid", "d.pi").union(at.select("d.rid", F.round("d.pi").alias("pi"))).join(hint(partner), "rid", "left").select("rid", F.coalesce("turned", "pi").cast("int").alias("more"))
        rows = rows.join(copies, "rid", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("int"))
    count = F.col("whole") + F.coalesce("more", F.lit(0))
    return rows.select(*["th"] * keep_key, "doc_id", "size", "source_size", "target", (F.col("size") * count).cast("long").alias("taken"), count.alias("copies"))


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Each row as often as the mix takes it, all columns as they are, whatever their names. Edge cases as above; a document without words is not taken."""
    of, other, hashed, total, many, k, times, copy = unused(docs, "of", "other", "hashed", "total", "many", "k", "times", "copy")
    plan = mixed(docs, id_col, text_col, source_col, weights, most, keep_key=True).groupBy(F.col("doc_id").alias(of), F.col("th").alias(other)).agg(F.sum("copies").alias(total), F.count("*").alias(many)).filter(F.col(total) > 0)
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(plan, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(hashed) == F.col(other)))
    rows = rows.withColumn(k, F.row_number().over(Window.partitionBy(of, other).orderBy(F.lit(0))))  # equal rows share their copies
    upto = lambda n: F.floor(F.col(total) * n / F.col(many))
    rows = rows.withColumn(times, (upto(F.col(k)) - upto(F.col(k) - 1)).cast("int")).filter(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
