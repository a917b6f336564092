"""Selections of posts: users, pages and post numbers, from short texts or from tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.functions.lines import squeeze as squeeze_text
from quillstack.functions.text import filled, normalize_space, squeeze
from quillstack.operators.ordering import islands, numbered
from quillstack.staging import Stage

#: Intervals that are sent to every task; more are matched by a shuffle.
BROADCAST_RANGES = 10_000
#: Intervals that are written out in a filter; more are looked up in one constant.
PLAIN_RANGES = 50
#: Numbers beyond a long count as the largest long.
LARGEST = (1 << 63) - 1
#: Elements of an array that one row is expanded to.
STEP = 1 << 13


def bounded_number(digits: str) -> int:
    return min(LARGEST, int(digits)) if len(digits) < 1000 else LARGEST


def parse_ranges(spec: str | None, *, hashes: bool = False) -> list[tuple[int, int]]:
    """Disjoint inclusive intervals of a selection such as ``145,200-202``, never expanded.

    Reversed ranges are turned, values below one and malformed parts are ignored.
    """
    mark, out = "#?" if hashes else "", []
    for part in re.split(r"[\s,]+", spec or ""):
        found = re.fullmatch(rf"{mark}(\d+)(?:-{mark}(\d+))?", part)
        if found:
            lo, hi = sorted(map(bounded_number, (found[1], found[2] or found[1])))
            if hi >= 1:
                out.append((max(1, lo), hi))
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(out):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def parse_users(spec: str | None) -> list[str]:
    """Names of a comma list, the first spelling of each."""
    names: dict[str, str] = {}
    for name in map(squeeze_text, (spec or "").split(",")):
        if name:
            names.setdefault(name.lower(), name)
    return list(names.values())


def ranges_of(spec: Column, *, hashes: bool = False) -> Column:
    """``parse_ranges`` for a column: an array of (lo, hi), not merged."""
    mark = "#?" if hashes else ""
    pattern = rf"^{mark}([0-9]+)(?:-{mark}([0-9]+))?$"
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(LARGEST))
    parts = F.filter(F.split(filled(spec), r"[\s,]+"), lambda x: x.rlike(pattern))

    def pair(x: Column) -> Column:
        a = number(F.regexp_extract(x, pattern, 1))
        b = F.regexp_extract(x, pattern, 2)
        b = F.when(b == "", a).otherwise(number(b))
        return F.struct(F.greatest(F.lit(1).cast("long"), F.least(a, b)).alias("lo"), F.greatest(a, b).alias("hi"))

    return F.filter(F.transform(parts, pair), lambda x: x["hi"] >= 1)


def expand_ranges(specs: DataFrame, id_col: str, spec_col: str, *, hashes: bool = False) -> DataFrame:
    """(id, value): every selected number once; for reports, not for filtering.

    A long interval is cut into shorter ones in steps, so no row ever holds more than ``STEP`` of its parts.
    """
    each = specs.select(id_col, F.explode(ranges_of(F.col(spec_col), hashes=hashes)).alias("r")).select(id_col, "r.lo", "r.hi").distinct()
    for power in range(4, 0, -1):
        size = F.lit(STEP**power)
        part = each.select(id_col, "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(hi - lo) div {STEP**power}L"))).alias("k"))
        first = F.col("lo") + F.col("k") * size
        each = part.select(id_col, first.alias("lo"), F.when(F.col("hi") - first < size, F.col("hi")).otherwise(first + (size - 1)).alias("hi"))
    return each.select(id_col, F.explode(F.sequence("lo", "hi")).alias("value")).distinct()


def user_list(specs: DataFrame, id_col: str, spec_col: str) -> DataFrame:
    """(id, position, user): first spelling of every name of a comma list."""
    each = specs.select(id_col, F.posexplode(F.split(filled(F.col(spec_col)), ","))).select(id_col, "pos", squeeze(F.col("col")).alias("user")).filter("user <> ''")
    first = each.groupBy(id_col, F.lower("user").alias("low")).agg(F.min(F.struct("pos", "user")).alias("x"))
    return first.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("x.pos")).alias("position"), "x.user")


def number_of(c: Column) -> Column:
    """Post number as a number; what is none counts as zero."""
    return F.coalesce(F.replace(filled(c.cast("string")), F.lit(","), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def inside(value: Column, ranges: list[tuple[int, int]]) -> Column:
    if len(ranges) > PLAIN_RANGES:
        table = F.from_json(F.lit(json.dumps([{"lo": lo, "hi": hi} for lo, hi in ranges])), "array<struct<lo:long,hi:long>>")
        return F.exists(table, lambda r: value.between(r["lo"], r["hi"]))
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | value.between(lo, hi)
    return out


def filter_by_users(posts: DataFrame, spec: str | None) -> DataFrame:
    users = [x.lower() for x in parse_users(spec)]
    return posts.filter(F.lower(normalize_space(F.col("author"))).isin(users)) if users else posts


def filter_by_pages(posts: DataFrame, spec: str | None) -> DataFrame:
    ranges = parse_ranges(spec)
    return posts.filter(inside(F.coalesce(F.col("page"), F.lit(0)), ranges)) if ranges else posts


def filter_by_post_numbers(posts: DataFrame, spec: str | None, more: str | None = None) -> DataFrame:
    """``more`` is the text of a selection file; both selections are united."""
    ranges = parse_ranges(f"{spec or ''},{more or ''}", hashes=True)
    return posts.filter(inside(number_of(F.col("post_number")), ranges)) if ranges else posts


def sort_key() -> list[Column]:
    """Canonical order of posts of a thread: page, number, id as text."""
    return [F.coalesce(F.col("page"), F.lit(0)), number_of(F.col("post_number")), filled(F.col("post_id"))]


def apply_export_filters(posts: DataFrame, *, users: str | None = None, pages: str | None = None, numbers: str | None = None, more: str | None = None) -> DataFrame:
    """All given filters together.  A selection that parses to nothing filters nothing."""
    return filter_by_post_numbers(filter_by_pages(filter_by_users(posts, users), pages), numbers, more)


def canonical_order(posts: DataFrame) -> DataFrame:
    """Sorted by thread and canonical order; threads of any size are split by range."""
    return posts.orderBy("thread_id", *sort_key())


def range_selection_join(posts: DataFrame, ranges: DataFrame, value: Column) -> DataFrame:
    """Posts whose value lies in any (lo, hi) of their thread.

    Posts without a thread or a value match nothing.  Few intervals are broadcast after counting them.  Many are
    met in order of value: posts and intervals are sorted together over range partitions, the farthest end so far is
    kept within each partition, and a row per partition and thread carries it on, so a large thread is split.
    """
    ranges = ranges.select("thread_id", "lo", "hi").filter("thread_id IS NOT NULL AND lo <= hi")
    if ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        r = ranges.withColumnRenamed("thread_id", "r_thread")
        return posts.join(F.broadcast(r), (posts["thread_id"] == r["r_thread"]) & value.between(r["lo"], r["hi"]), "left_semi")
    posts = posts.filter(F.col("thread_id").isNotNull() & value.isNotNull())
    marked = posts.select("thread_id", value.alias("__v"), F.struct(*posts.columns).alias("__row"), F.lit(1).alias("__kind"))
    none = F.lit(None).cast(marked.schema["__row"].dataType)
    starts = ranges.select("thread_id", F.col("lo").alias("__v"), none.alias("__row"), F.lit(0).alias("__kind"), F.col("hi").alias("__hi"))
    both = marked.unionByName(starts, allowMissingColumns=True)
    both = Stage(posts.sparkSession, "ranges").put("sorted", both.repartitionByRange("thread_id", "__v", "__kind").withColumn("__part", F.spark_partition_id()))
    line = lambda *by: Window.partitionBy("thread_id", *by)
    ends = both.groupBy("thread_id", "__part").agg(F.max("__hi").alias("__end"))
    carried = ends.select("thread_id", "__part", F.max("__end").over(line().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    own = F.max("__hi").over(line("__part").orderBy("__v", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("__own", own).filter("__kind = 1").join(carried, ["thread_id", "__part"])
    return met.filter(F.greatest("__own", "__carry") >= F.col("__v")).select("__row.*")


def collapse_ranges(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, label): distinct numbers of a key as ``1-3, 7``; runs are found over range partitions, and only runs meet in a label."""
    runs = islands(values.filter(F.col(value) >= 1), keys, value)
    chunk = lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string")))
    return runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("x")).select(*keys, F.array_join(F.transform("x", chunk), ", ").alias("label"))


def ranges_label(ranges: list[tuple[int, int]]) -> str:
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in ranges)


def filter_label(users: str | None = None, pages: str | None = None, numbers: str | None = None) -> str:
    """What an export holds, in words."""
    out = [", ".join(parse_users(users)) or "all posts"]
    for name, ranges in (("pages", parse_ranges(pages)), ("posts", parse_ranges(numbers, hashes=True))):
        if ranges:
            out.append(f"{name} {ranges_label(ranges)}")
    return " | ".join(out)


def display_label(posts: DataFrame) -> DataFrame:
    """``label``: the post number, else the position among the posts of its thread; only threads that need positions are sorted.

    The posts are computed once: what follows reads a staged table.
    """
    told = F.when(F.col("post_number") != "", F.col("post_number"))
    posts = Stage(posts.sparkSession, "labels").put("posts", posts)
    some = posts.filter(told.isNull()).select(F.col("thread_id").alias("__thread")).distinct()
    here = F.col("thread_id").eqNullSafe(F.col("__thread"))
    need = numbered(posts.join(some, here, "left_semi").select(posts.columns), ["thread_id"], sort_key(), "__place")
    rest = posts.join(some, here, "left_anti").select(*posts.columns, told.alias("label"))
    return rest.unionByName(need.select(*posts.columns, F.coalesce(told, F.col("__place").cast("string")).alias("label")))


#: Rows of a rank up to which every task drops the rest before the shuffle.
RANKED = 1000


def limit_pages(pages: DataFrame, start: int, n: int) -> DataFrame:
    """The first ``n`` pages of every thread from ``start``.

    Of a small ``n`` every task keeps so many rows of a thread before they meet; for a larger one places are counted over range partitions.
    """
    here = pages.filter(F.col("page") >= start)
    if n < RANKED:
        rank = F.row_number().over(Window.partitionBy("thread_id").orderBy("page"))
        return here.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
    return numbered(here, ["thread_id"], [F.col("page")], "__rank").filter(F.col("__rank") <= n).drop("__rank")


def explode_lists(posts: DataFrame, column: str) -> DataFrame:
    """One row per element of a list with its position from one; empty lists keep a row."""
    return posts.select("thread_id", "post_id", F.posexplode_outer(column).alias("idx", "value")).withColumn("idx", F.col("idx") + 1)


def union_selections(*selections: DataFrame) -> DataFrame:
    """Distinct values, one at least, of several selections with equal columns ending in ``value``."""
    out = selections[0]
    for s in selections[1:]:
        out = out.unionByName(s)
    return out.filter("value >= 1").distinct()
