"""Validation of posts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import filled, is_blank, normalize_space

NO_DATE, NO_AUTHOR = "Unknown date", "Unknown"


def post_validation_reasons() -> Column:
    """Ordered reason codes of a post row."""
    author, time, number, ident = (normalize_space(F.col(c)) for c in ("author", "timestamp", "post_number", "post_id"))
    signals = (ident != "").cast("int") + (number != "").cast("int") + ((time != "") & (time != NO_DATE)).cast("int")
    empty = is_blank(F.col("text")) & (F.coalesce(F.size("image_urls"), F.lit(0)) <= 0)
    code = lambda test, name: F.when(test, F.lit(name))
    return F.array_compact(
        F.array(
            code(signals < 2, "weak_post_signals"),
            code(F.lower(author).startswith("quoting "), "author_is_quote_header"),
            code(author.isin(NO_AUTHOR, "Quote"), "weak_author"),
            code(empty, "empty_post"),
            code((number == "") & (time == NO_DATE), "missing_label_and_timestamp"),
        )
    )


def judged_posts(posts: DataFrame) -> DataFrame:
    """Posts with ``validation_reasons`` and ``accepted``: text or images, and two signals of three."""
    out = posts.withColumn("validation_reasons", post_validation_reasons())
    return out.withColumn("accepted", ~F.arrays_overlap("validation_reasons", F.array(F.lit("empty_post"), F.lit("weak_post_signals"))))


def unknown_date_posts(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("timestamp") == NO_DATE)


def public_posts(posts: DataFrame) -> DataFrame:
    """Without the raw HTML; pruned before any shuffle."""
    return posts.drop("raw_html")


def missing_numbers(expected: Column, accepted: Column) -> Column:
    """Expected labels that were not accepted; order and repeats stay."""
    return F.filter(expected, lambda x: ~F.array_contains(accepted, x))


def _with_opener(page: Column, expected: Column) -> Column:
    """Page one must hold post 1."""
    first = F.get(expected, F.lit(0))
    return F.when((page == 1) & (first.isNull() | (first != "1")), F.concat(F.array(F.lit("1")), expected)).otherwise(expected)


def validation_of(page: Column, expected: Column, labels: Column, n_accepted: Column, n_rejected: Column, n_unknown: Column) -> Column:
    """A page's validation as a struct; a later page without any label to expect passes."""
    expected = _with_opener(page, F.coalesce(expected, F.array().cast("array<string>")))
    labels = F.coalesce(labels, F.array().cast("array<string>"))
    missing, n_expected = missing_numbers(expected, labels), F.size(expected)
    unlabelled = n_accepted - F.size(labels)
    some = n_expected > 0
    off, opener, lost, bare = some & (n_accepted != n_expected), some & (page == 1) & ~F.array_contains(labels, "1"), some & (F.size(missing) > 0), some & (unlabelled > 0)
    say = lambda test, *parts: F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    text = lambda c: c.cast("string")
    warnings = F.array_compact(
        F.array(
            say(off, "expected ", text(n_expected), " labelled posts but accepted ", text(n_accepted)),
            say(opener, "page 1 opener missing"),
            say(lost, "missing post numbers: ", F.array_join(F.slice(missing, 1, 12), ", ")),
            say(bare, text(unlabelled), " accepted post(s) had no post number"),
            say(n_rejected > 0, "rejected ", text(n_rejected), " weak candidate(s)"),
            say(n_unknown > 0, text(n_unknown), " accepted post(s) had Unknown date"),
        )
    )
    return F.struct(
        page.cast("int").alias("page"),
        expected.alias("expected_post_numbers"),
        n_expected.cast("int").alias("expected_post_count"),
        n_accepted.cast("int").alias("accepted_post_count"),
        n_rejected.cast("int").alias("rejected_post_count"),
        labels.alias("accepted_post_numbers"),
        missing.alias("missing_post_numbers"),
        unlabelled.cast("int").alias("extra_unlabelled_posts"),
        n_unknown.cast("int").alias("unknown_date_posts"),
        (~(off | opener | lost | bare)).alias("passed"),
        warnings.alias("warnings"),
    )


def validate_pages(pages: DataFrame, posts: DataFrame) -> DataFrame:
    """(thread_id, page, validation) of pages (thread_id, page, expected) and judged posts, in any order of posts."""
    number = F.col("post_number")
    label = F.when(F.col("accepted") & (filled(number) != ""), F.struct(F.coalesce(number.try_cast("long"), F.lit(0).cast("long")).alias("n"), number.alias("label")))
    told = posts.groupBy("thread_id", "page").agg(
        F.transform(F.sort_array(F.collect_list(label)), lambda x: x["label"]).alias("labels"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_rejected"),
        F.count_if(F.col("accepted") & (F.col("timestamp") == NO_DATE)).alias("n_unknown"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pages.join(told, ["thread_id", "page"], "left").select("thread_id", "page", validation_of(F.col("page"), F.col("expected"), F.col("labels"), zero("n_accepted"), zero("n_rejected"), zero("n_unknown")).alias("validation"))


def missing_posts(expected: DataFrame, posts: DataFrame) -> DataFrame:
    """(thread_id, page, label) expected but not accepted, as a join of exploded labels."""
    have = posts.filter("accepted").select("thread_id", "page", F.col("post_number").alias("label"))
    return expected.join(have.distinct(), ["thread_id", "page", "label"], "left_anti")
