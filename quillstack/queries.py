"""Registered queries over the supplied tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack import adapters as A
from quillstack.functions import lines as L
from quillstack.functions import text as T
from quillstack.functions import urls as U
from quillstack.operators import images, merge, parse, rename, render, report, select, validate
from quillstack.operators.ordering import numbered
from quillstack.plans import archive
from quillstack.sources import readers, writers
from quillstack.sources.archive_log import ArchiveLog
from quillstack.staging import Stage, read_table
from quillstack.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CONV, EVENTS = A.CONVERSATION_POSTS_SQL, A.EVENT_POSTS_SQL
NUMBER = "coalesce(TRY_CAST(replace(coalesce(post_number, ''), ',', '') AS BIGINT), 0)"
ORDER = f"page, {NUMBER}, post_id"


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as full posts."""
    none = F.array().cast("array<string>")
    made = A.conversation_posts(spark, sf_dir)
    return made.withColumn("signature_text", F.lit("")).withColumn("attachment_labels", none).withColumn("image_urls", none).withColumn("images", none)


# ---------------------------------------------------------------- reports


@query(
    "top_authors",
    """
    WITH c AS (SELECT event_type AS thread_id, 'user_' || CAST(user_id AS VARCHAR) AS author, count(*) AS post_count FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY post_count DESC, lower(author), author) AS rank,
        sum(post_count) OVER (PARTITION BY thread_id) AS total FROM c)
    SELECT thread_id, CAST(rank AS INTEGER) AS rank, author, post_count, round(100 * post_count / total, 2) AS share_percent FROM r WHERE rank <= 10""",
)
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_authors(A.event_authors(spark, sf_dir))


@query("author_totals", "SELECT event_type AS thread_id, count(*) AS total_posts, count(DISTINCT user_id) AS distinct_users FROM events GROUP BY event_type")
def author_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.author_totals(A.event_authors(spark, sf_dir)).select("thread_id", F.col("total_posts").cast("long").alias("total_posts"), "distinct_users")


@query(
    "author_rank",
    f"""SELECT thread_id, author, count(*) AS post_count, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY count(*) DESC, lower(author), author) AS INTEGER) AS rank
    FROM (SELECT thread_id, CASE WHEN {NUMBER} % 7 = 0 THEN 'Unknown' ELSE author || ' & co' END AS author FROM ({CONV})) GROUP BY thread_id, author""",
)
def author_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in several spellings: entities, double and hard blanks, or nothing at all."""
    return report.author_rank(report.author_counts(misspelt(A.conversation_posts(spark, sf_dir))))


def misspelt(p: DataFrame) -> DataFrame:
    n = select.number_of(F.col("post_number"))
    spelt = F.when(n % 7 == 0, "&nbsp; ").when(n % 3 == 0, F.concat("author", F.lit("  &amp;\u00a0co"))).when(n % 3 == 1, F.concat(F.lit("\u00a0"), "author", F.lit(" & co "))).otherwise(F.concat("author", F.lit(" &amp; co")))
    return p.withColumn("author", spelt)


@query(
    "export_report",
    f"""SELECT thread_id, count(*) AS total_posts, count(*) FILTER (lower(author) = 'user') AS exported_posts, 'filtered' AS filter_mode FROM ({CONV}) GROUP BY thread_id""",
)
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    return report.export_report(p, select.filter_by_users(p, "USER"), filtered=True)


# ---------------------------------------------------------------- text functions


@query("repair_cp1252", "SELECT doc_id, replace(replace(text, 'e', '–'), 'a', '€') AS out FROM documents")
def repair_cp1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.repair_cp1252(F.translate("text", "ea", "\x96\x80")).alias("out"))


@query("repair_mojibake", "SELECT doc_id, replace(replace(replace(text, 'the', '’'), 'ing', '—'), 'x', '<') AS out FROM documents")
def repair_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = F.replace(F.replace(F.replace("text", F.lit("the"), F.lit(L.MOJIBAKE[0][0])), F.lit("ing"), F.lit(L.MOJIBAKE[5][0])), F.lit("x"), F.lit("&lt;"))
    return texts(spark, sf_dir).select("doc_id", T.repair_mojibake(spoilt).alias("out"))


@query("normalize_space", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS out FROM documents")
def normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.normalize_space(F.col("text")).alias("out"))


@query("normalize_space_all_rows", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS out FROM documents")
def normalize_space_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.normalize_space(F.col("text")).alias("out"))


@query("slugify", "SELECT doc_id, CASE WHEN s = '' THEN 'thread' ELSE s END AS out FROM (SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-zA-Z0-9]+', '-', 'g'), '-'), 1, 80) AS s FROM documents)")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.slugify(F.col("text")).alias("out"))


@query(
    "safe_filename",
    """SELECT page_id, CASE WHEN s = '' THEN 'file' ELSE s END AS out FROM (SELECT page_id, trim(substr(trim(regexp_replace(url, '[^\\w.\\-]+', '_', 'g'), '._'), 1, 120), '._') AS s FROM pages)""",
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("out"))


PLAIN_URL = "rtrim(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[0-9]+&?', '\\1'), '[?&]$', ''), '?')"


@query("normalize_thread_url", f"SELECT page_id, {PLAIN_URL} AS out FROM pages")
def normalize_thread_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", U.normalize_thread_url(F.col("url")).alias("out"))


@query("page_url", f"SELECT page_id, u AS first, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'page=3' AS third FROM (SELECT page_id, {PLAIN_URL} AS u FROM pages)")
def page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = U.normalize_thread_url(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", U.page_url(u, F.lit(1)).alias("first"), U.page_url(u, F.lit(3)).alias("third"))


@query(
    "thread_key",
    f"""SELECT page_id, CASE WHEN s = '' THEN 'thread' ELSE s END AS out FROM (SELECT page_id,
        substr(trim(regexp_replace(lower(regexp_extract(rtrim(regexp_replace(regexp_replace({PLAIN_URL}, '\\?.*$', ''), '^[a-z]+://[^/]*', ''), '/'), '[^/]*$')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS s FROM pages)""",
)
def thread_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", U.thread_key(U.normalize_thread_url(F.col("url"))).alias("out"))


SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def one_gap(lines: str) -> str:
    """SQL that joins a list of lines, with one empty line for a run of them and none at the ends."""
    return f"trim(regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


def clean(text: str = "text") -> str:
    """SQL of a text whose lines are squeezed."""
    return one_gap(f"list_transform(string_split({text}, chr(10)), lambda x: {SQUEEZED.format('x')})")


LINES = f"(SELECT *, {SQUEEZED.format('line')} AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


@query("normalize_multiline", f"SELECT doc_id, {clean()} AS out FROM documents")
def normalize_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.normalize_multiline("text").alias("out"))


@query(
    "dedupe_consecutive_lines",
    f"""WITH m AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM {LINES})
    SELECT doc_id, trim(string_agg(rtrim(line, chr(32) || chr(9)), chr(10) ORDER BY i), chr(10)) AS out FROM m WHERE before IS NULL OR key = '' OR key <> before GROUP BY doc_id""",
)
def dedupe_consecutive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.dedupe_consecutive_lines("text").alias("out"))


@query(
    "dedupe_all_lines",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS n FROM {LINES}),
    g AS (SELECT doc_id, list(rtrim(line, chr(32) || chr(9)) ORDER BY i) AS kept FROM k WHERE n = 1 OR key = '' GROUP BY doc_id)
    SELECT doc_id, {one_gap('kept')} AS out FROM g""",
)
def dedupe_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.dedupe_all_lines("text").alias("out"))


@query("strip_attachment_artifacts", f"SELECT conv_id, turn, {clean()} AS out FROM conversations")
def strip_attachment_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = F.concat(F.lit("Attached File(s)\n12.5 KB\n|\n"), F.col("text"), F.lit("\n1,204 downloads\nFile Type: pdf\n"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_attachment_artifacts(spoilt).alias("out"))


@query(
    "is_noise_line",
    """SELECT event_id, regexp_matches(props, '^\\d+$') OR trim(props) = '' AS noise, false AS author_echo, event_id % 2 = 0 AS date_echo, event_id % 3 = 0 AS label_echo, event_id % 5 = 0 AS word, event_id % 4 = 0 AS statistics FROM events""",
)
def is_noise_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that echo the row's own date or label, or another one's; words of the interface beside others; statistics and what only looks like them."""
    e = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    t, n, line = F.date_format("ts", "MMM d, yyyy h:mma"), i.cast("string"), T.squeeze(F.col("props"))
    noise = lambda x: T.is_noise_line(x, t, n)
    other = lambda k, own, off: F.when(i % k == 0, own).otherwise(off)
    date = other(2, t, F.date_format(F.expr("ts + INTERVAL 1 DAY"), "MMM d, yyyy h:mma"))
    label, word = F.concat(F.lit("# "), other(3, n, F.concat(F.lit("x"), n))), other(5, F.lit("Top of Page"), F.lit("Top of the page"))
    statistics = F.concat(F.lit("Joined 2020 | "), n, other(4, F.lit(" Posts"), F.lit(" Post")))
    return e.select("event_id", noise(line).alias("noise"), noise(F.concat(F.lit("user_"), n)).alias("author_echo"), noise(date).alias("date_echo"), noise(label).alias("label_echo"), noise(word).alias("word"), noise(statistics).alias("statistics"))


@query(
    "normalize_timestamp",
    """SELECT event_id, t || CASE WHEN t <> u THEN ' | ' || u ELSE '' END AS out FROM (SELECT event_id, strftime(ts, '%b %-d, %Y %-I:%M%p') AS t, strftime(ts + INTERVAL (event_id % 2) DAY, '%b %-d, %Y %-I:%M%p') AS u FROM events)""",
)
def normalize_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    t, u = F.date_format("ts", "MMM d, yyyy h:mma"), F.date_format(F.expr("ts + make_interval(0, 0, 0, CAST(event_id % 2 AS INT))"), "MMM d, yyyy h:mma")
    return e.select("event_id", T.normalize_timestamp(F.concat(F.lit("Posted "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" | Edited "), u, F.lit(" by x"))).alias("out"))


@query(
    "normalize_image_url",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/attachment/image/' || page_id || '?d=1' WHEN page_id % 3 = 1 THEN url || '/attachment/image/' || page_id ELSE url || '/attachment/file/' || page_id || '/thumbnail' END AS out FROM pages""",
)
def normalize_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails of attached images, whole images, and thumbnails of something else."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    end = F.when(k == 0, F.concat(F.lit("/attachment/image/"), i, F.lit("/thumbnail?d=1"))).when(k == 1, F.concat(F.lit("/attachment/image/"), i)).otherwise(F.concat(F.lit("/attachment/file/"), i, F.lit("/thumbnail")))
    return read_table(spark, sf_dir, "pages").select("page_id", U.normalize_image_url(F.concat("url", end)).alias("out"))


@query(
    "image_filters",
    """SELECT page_id, regexp_matches(lower(url), 'avatar|smiley|emoji|icon|logo|sprite|blank|spacer|pixel') AS skip, regexp_matches(u, '(?i)\\.(jpg|jpeg|png|gif|webp|bmp|svg)(\\?|$)') AS image,
        CASE WHEN contains(url, '.html') THEN '.html' WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS extension
    FROM (SELECT *, CASE WHEN page_id % 2 = 0 OR contains(url, '.html') THEN url ELSE regexp_replace(url, '[/]?([?#].*)?$', '/x.PNG') END AS u FROM pages)""",
)
def image_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when((F.col("page_id") % 2 == 0) | F.col("url").contains(".html"), F.col("url")).otherwise(F.regexp_replace("url", "^([^?#]*?)/?([?#].*)?$", "$1/x.PNG"))
    return read_table(spark, sf_dir, "pages").select("page_id", U.should_skip_image(F.col("url")).alias("skip"), U.is_image_url(u).alias("image"), U.guess_extension(u).alias("extension"))


@query(
    "parse_ranges",
    "SELECT conv_id, turn, unnest(list_distinct(list_concat(list_concat(range(turn + 1, turn + 4), CASE WHEN turn = 0 THEN [] ELSE [turn] END), [9, 9223372036854775807]))) AS value FROM conversations",
)
def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn has its own selection, with numbers beyond a long and malformed parts."""
    t = F.col("turn").cast("string")
    spec = F.concat(F.lit("#"), (F.col("turn") + 3).cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string"), F.lit(", "), t, F.lit(" 9,1-2-3 x #9 99999999999999999999"))
    each = select.expand_ranges(read_table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), spec.alias("spec")), "id", "spec", hashes=True)
    return each.select("id.conv_id", "id.turn", "value")


@query(
    "parse_ranges_all_rows",
    "SELECT conv_id, unnest(list_distinct(list_concat(list_concat(range(turn + 1, turn + 4), CASE WHEN turn = 0 THEN [] ELSE [turn] END), [9]))) AS value FROM conversations",
)
def parse_ranges_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("string")
    c = read_table(spark, sf_dir, "conversations")
    spec = F.concat(F.lit("#"), (F.col("turn") + 3).cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string"), F.lit(", "), t, F.lit(" 9,1-2-3 x #9"))
    each = select.expand_ranges(c.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("id"), spec.alias("spec")), "id", "spec", hashes=True)
    return each.select(F.split("id", ":")[0].cast("long").alias("conv_id"), "value")


@query(
    "parse_user_list",
    """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p) AS INTEGER) AS position, role AS "user" FROM (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY ALL)""",
)
def parse_user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    spec = F.concat_ws(",", F.array_join(F.transform("x", lambda r: r["role"]), " , ,"), F.upper(F.array_join(F.transform("x", lambda r: r["role"]), ",")))
    return select.user_list(specs.select("conv_id", spec.alias("spec")), "conv_id", "spec")


@query("export_sections", f"SELECT post_id, trim({clean()}) AS body, 'chart.png | 3 KB' AS attachments, 'bye' AS signature FROM ({CONV})")
def export_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("text", F.lit("\nAttachment: chart.png | 3 KB\nSig: bye\nAttachment: chart.png | 3 KB"))
    s = T.export_sections(body, F.lit(""), F.array().cast("array<string>"), F.lit("bye"))
    return A.conversation_posts(spark, sf_dir).select("post_id", s.alias("s")).select("post_id", "s.body", F.array_join("s.attachments", "; ").alias("attachments"), F.array_join("s.signature", "; ").alias("signature"))


@query(
    "compose_text",
    f"SELECT post_id, concat_ws(chr(10) || chr(10), CASE WHEN body_text <> '' THEN body_text END, CASE WHEN page = 1 THEN 'Attachment: a' || chr(10) || 'Attachment: b' END, CASE WHEN author = 'user' THEN 'Sig: x' END) AS out FROM ({CONV})",
)
def compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.when(F.col("page") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return A.conversation_posts(spark, sf_dir).select("post_id", T.compose_text(F.col("body_text"), labels, F.when(F.col("author") == "user", "\nx\n").otherwise("")).alias("out"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS out FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("out"))


@query(
    "data_uri",
    "SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS inline, 'images/a.png' AS missing, 'https://x.org/a.png' AS outside FROM documents",
)
def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    return texts(spark, sf_dir).select("doc_id", U.data_uri(F.lit("images/a.png"), content).alias("inline"), U.data_uri(F.lit("images/a.png"), F.lit(None).cast("binary")).alias("missing"), U.data_uri(F.lit("https://x.org/a.png"), content).alias("outside"))


@query(
    "post_key",
    f"SELECT post_id AS snapshot, post_number AS number, author, \"timestamp\" AS time, 'page' || CAST(page AS VARCHAR) || '_postunknown' AS anonymous FROM ({CONV})",
)
def post_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    bare = p.withColumn("post_id", F.lit("")).withColumn("post_number", F.lit(None).cast("string"))
    named = p.select("thread_id", "post_number", merge.snapshot_key().alias("snapshot"), merge.repair_key().alias("k"))
    other = bare.select("thread_id", "page", F.col("post_url"), merge.snapshot_key().alias("anonymous"))
    return named.join(other.withColumn("snapshot", F.element_at(F.split("post_url", "/"), -1)), ["thread_id", "snapshot"]).select("snapshot", "k.number", "k.author", F.col("k.timestamp").alias("time"), "anonymous")


@query("sort_key", f"SELECT post_id, CAST(page AS INTEGER) AS page, {NUMBER} AS number FROM ({EVENTS})")
def sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.event_posts(spark, sf_dir).withColumn("post_number", F.format_number(F.col("post_number").cast("long"), 0))
    page, number, ident = select.sort_key()
    return p.select(ident.alias("post_id"), page.alias("page"), number.alias("number"))


@query(
    "filter_label",
    """SELECT conv_id, 'all posts | pages ' || CASE WHEN max(turn) = 0 THEN '1' ELSE '1-' || CAST(max(turn) + 1 AS VARCHAR) END AS label FROM conversations GROUP BY conv_id HAVING count(*) = max(turn) + 1""",
)
def filter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    whole = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("m")).filter("n = m + 1").select("conv_id")
    label = select.collapse_ranges(c.select("conv_id", (F.col("turn") + 1).alias("v")), ["conv_id"], "v")
    return label.join(whole, "conv_id").select("conv_id", F.concat(F.lit(select.filter_label() + " | pages "), "label").alias("label"))


@query(
    "attachment_label",
    """SELECT page_id, concat_ws(' | ', CASE WHEN page_id % 3 = 0 THEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') ELSE 'file ' || page_id || '.zip' END,
        CASE WHEN page_id % 4 > 0 THEN page_id || CASE page_id % 4 WHEN 1 THEN ' KB' WHEN 2 THEN '.5 mb' ELSE ' bytes' END END, CASE WHEN page_id % 5 > 0 THEN page_id || ' downloads' END) AS out FROM pages""",
)
def attachment_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with and without a mark, or none; rows with sizes in several units, twice, or none; with and without downloads."""
    i, n = F.col("page_id").cast("string"), F.col("page_id")
    label = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("! file  "), i, F.lit(".zip"))).otherwise(F.concat(F.lit(" file "), i, F.lit(".zip ")))
    size = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(i, F.lit(" KB"))).when(n % 4 == 2, F.concat(i, F.lit(".5 mb"))).otherwise(F.concat(i, F.lit(" bytes")))
    row = F.concat(F.lit("plan "), size, F.lit("  | "), F.when(n % 5 == 0, "").otherwise(F.concat(i, F.lit("  downloads"))), F.lit(" of "), size)
    return read_table(spark, sf_dir, "pages").select("page_id", T.attachment_label(label, row, F.col("url")).alias("out"))


# ---------------------------------------------------------------- selections, order, labels


@query("filter_by_users", f"SELECT post_id FROM ({CONV}) WHERE lower(author) IN ('user', 'system') AND {NUMBER} % 7 <> 0")
def filter_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_by_users(misspelt(A.conversation_posts(spark, sf_dir)), " User&amp; co, User  & co, SYSTEM &amp; CO ,user,").select("post_id")


@query("filter_by_pages", f"SELECT post_id FROM ({EVENTS}) WHERE page BETWEEN 2 AND 4 OR page = 7")
def filter_by_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_by_pages(A.event_posts(spark, sf_dir), "4-2, 7 x #9 99999999999999999999").select("post_id")


@query("filter_by_post_numbers", f"SELECT post_id FROM ({EVENTS}) WHERE {NUMBER} BETWEEN 10 AND 40 OR {NUMBER} = 99")
def filter_by_post_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_by_post_numbers(A.event_posts(spark, sf_dir), "#10-#40", "99\n").select("post_id")


@query("apply_export_filters", f"SELECT post_id FROM ({CONV}) WHERE lower(author) = 'assistant' AND page IN (1, 2) AND {NUMBER} BETWEEN 2 AND 5")
def apply_export_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.apply_export_filters(A.conversation_posts(spark, sf_dir), users="Assistant", pages="1-2", numbers="#2-5").select("post_id")


@query("empty_selection_keeps_all", f"SELECT post_id FROM ({CONV})")
def empty_selection_keeps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.apply_export_filters(A.conversation_posts(spark, sf_dir), users=" , ", pages="abc", numbers="1-2-3").select("post_id")


@query("unknown_date_posts", f"SELECT post_id FROM ({CONV}) WHERE \"timestamp\" = 'Unknown date'")
def unknown_date_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unknown_date_posts(A.conversation_posts(spark, sf_dir)).select("post_id")


@query("public_posts", CONV)
def public_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.public_posts(A.conversation_posts(spark, sf_dir).withColumn("raw_html", F.lit("<p>")))


@query("explode_lists", f"SELECT thread_id, post_id, CAST(i AS INTEGER) AS idx, 'https://x.org/' || CAST(i AS VARCHAR) AS value FROM ({CONV}), range(1, 3) r(i) UNION ALL SELECT thread_id, post_id || 'e', NULL, NULL FROM ({CONV})")
def explode_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    full = p.withColumn("image_urls", F.array(F.lit("https://x.org/1"), F.lit("https://x.org/2")))
    empty = p.withColumn("post_id", F.concat("post_id", F.lit("e"))).withColumn("image_urls", F.array().cast("array<string>"))
    return select.explode_lists(full.unionByName(empty), "image_urls")


@query("range_selection_join", f"SELECT post_id FROM ({EVENTS}) WHERE {NUMBER} BETWEEN 5 AND 9 OR (thread_id = 'click' AND {NUMBER} BETWEEN 100 AND 1000000000)")
def range_selection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.event_posts(spark, sf_dir)
    ranges = p.select("thread_id").distinct().withColumn("r", F.explode(F.array(F.struct(F.lit(5).alias("lo"), F.lit(9).alias("hi")), F.struct(F.lit(100).alias("lo"), F.lit(1_000_000_000).alias("hi")))))
    ranges = ranges.select("thread_id", "r.lo", "r.hi").filter("lo = 5 OR thread_id = 'click'")
    return select.range_selection_join(p, ranges, select.number_of(F.col("post_number"))).select("post_id")


@query(
    "collapse_ranges",
    """WITH d AS (SELECT DISTINCT user_id, event_id % 50 + 1 AS v FROM events), g AS (SELECT *, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS g FROM d),
    r AS (SELECT user_id, min(v) AS lo, max(v) AS hi FROM g GROUP BY user_id, g)
    SELECT user_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS label FROM r GROUP BY user_id""",
)
def collapse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.collapse_ranges(read_table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50 + 1).alias("v")), ["user_id"], "v")


@query(
    "display_label",
    f"SELECT post_id, CASE WHEN author = 'user' THEN CAST(row_number() OVER (PARTITION BY thread_id ORDER BY page, CASE WHEN author = 'user' THEN 0 ELSE {NUMBER} END, post_id) AS VARCHAR) ELSE post_number END AS label FROM ({CONV})",
)
def display_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir).withColumn("post_number", F.when(F.col("author") == "user", "").otherwise(F.col("post_number")))
    return select.display_label(p).select("post_id", "label")


@query("canonical_order", f"SELECT thread_id, post_id, CAST(row_number() OVER (ORDER BY thread_id, {ORDER}) AS BIGINT) AS place FROM ({CONV})")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places come from the sorted parts: a count per part and a running sum, not one window over all rows."""
    parts = Stage(spark, "order").put("sorted", select.canonical_order(A.conversation_posts(spark, sf_dir)).select("thread_id", "post_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    base = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return parts.join(F.broadcast(base), "part").select("thread_id", "post_id", (F.col("base") + F.col("at") - F.col("first") + 1).alias("place"))


@query("top_k", f"SELECT thread_id, post_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY {ORDER}) AS r FROM ({CONV})) WHERE r <= 2")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy(*select.sort_key()))
    return A.conversation_posts(spark, sf_dir).withColumn("r", place).filter("r <= 2").select("thread_id", "post_id")


EVENT_PAGES = f"(SELECT DISTINCT thread_id, page FROM ({EVENTS}))"


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_posts(spark, sf_dir).select("thread_id", "page").distinct()


@query("limit_pages", f"SELECT thread_id, page FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY page) AS r FROM {EVENT_PAGES} WHERE page >= 3) WHERE r <= 4")
def limit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.limit_pages(event_pages(spark, sf_dir), 3, 4)


@query("distinct_pages", f"SELECT * FROM {EVENT_PAGES}")
def distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pages(spark, sf_dir)


@query("union_posts", f"SELECT post_id FROM ({CONV}) UNION ALL SELECT post_id FROM ({CONV}) WHERE page = 1")
def union_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    return merge.union_posts(p, p.filter("page = 1")).select("post_id")


@query("union_selections", "SELECT DISTINCT conv_id, v AS value FROM (SELECT conv_id, turn AS v FROM conversations UNION ALL SELECT conv_id, turn * 2 FROM conversations) WHERE v >= 1")
def union_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return select.union_selections(c.select("conv_id", F.col("turn").alias("value")), c.select("conv_id", (F.col("turn") * 2).alias("value")))


@query("except_pages", f"SELECT post_id FROM ({CONV}) WHERE page <> 2")
def except_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    return merge.except_pages(p, p.filter("page = 2")).select("post_id")


# ---------------------------------------------------------------- merging


@query("new_posts_bucketed", f"SELECT thread_id, post_id FROM ({CONV}) WHERE page % 2 = 0 UNION ALL SELECT thread_id, '' FROM ({CONV}) WHERE page = 1")
def new_posts_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is a bucketed table of the odd pages: only the new posts are dealt out to meet it."""
    p, table = A.conversation_posts(spark, sf_dir), f"archive_{uuid.uuid4().hex}"
    writers.save_bucketed_archive(p.filter("page % 2 = 1"), table, buckets=8, path=f"{Stage(spark, 'bucketed').root}/posts")
    parsed = p.unionByName(p.filter("page = 1").withColumn("post_id", F.lit("")))
    return merge.new_posts_only(parsed, spark.table(table)).select("thread_id", "post_id")


@query(
    "merge_posts",
    f"""SELECT post_id, CASE WHEN {NUMBER} % 3 = 0 THEN 'new' ELSE 'old' END AS side FROM ({CONV})""",
)
def merge_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    number = select.number_of(F.col("post_number"))
    return merge.merge_posts(p.filter(number % 3 != 0).withColumn("side", F.lit("old")), p.withColumn("side", F.lit("new"))).select("post_id", "side")


@query("new_posts_only", f"SELECT post_id, post_number FROM ({CONV}) WHERE page > 1 UNION ALL SELECT '', post_number FROM ({CONV})")
def new_posts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    return merge.new_posts_only(p.unionByName(p.withColumn("post_id", F.lit(""))), p.filter("page = 1")).select("post_id", "post_number")


@query("replace_pages", f"SELECT post_id, CASE WHEN page = 2 THEN 'repaired' ELSE author END AS author FROM ({CONV}) WHERE page <> 2 OR {NUMBER} % 2 = 0")
def replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    fixed = p.filter("page = 2").filter(select.number_of(F.col("post_number")) % 2 == 0).withColumn("author", F.lit("repaired"))
    return merge.replace_pages(p, fixed, p.filter("page = 2").select("thread_id", "page").distinct()).select("post_id", "author")


@query("replace_pages_bucketed", f"SELECT post_id, CASE WHEN page = 2 THEN 'repaired' ELSE author END AS author FROM ({CONV}) WHERE page <> 2 OR {NUMBER} % 2 = 0")
def replace_pages_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is a bucketed table of threads and pages: its rows are passed on where they lie."""
    p, table = A.conversation_posts(spark, sf_dir), f"archive_{uuid.uuid4().hex}"
    writers.save_bucketed_archive(p, table, buckets=8, keys=("thread_id", "page"), path=f"{Stage(spark, 'bucketed').root}/posts")
    fixed = p.filter("page = 2").filter(select.number_of(F.col("post_number")) % 2 == 0).withColumn("author", F.lit("repaired"))
    return merge.replace_pages(spark.table(table), fixed, p.filter("page = 2").select("thread_id", "page").distinct(), merged=True).select("post_id", "author")


@query(
    "repair_added_vs_replaced",
    f"SELECT thread_id, page, count(*) FILTER (author <> 'assistant' OR {NUMBER} % 2 = 0) AS added, count(*) FILTER (author = 'assistant' AND {NUMBER} % 2 = 1) AS replaced FROM ({CONV}) GROUP BY ALL",
)
def repair_added_vs_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    return merge.repair_added_vs_replaced(p.filter(select.number_of(F.col("post_number")) % 2 == 1), p.withColumn("author", F.when(F.col("author") == "assistant", F.col("author")).otherwise("renamed")))


# ---------------------------------------------------------------- validation and planning


def spoilt_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of which some lack an id, a number or a text, by their number."""
    n = select.number_of(F.col("post_number"))
    p = posts(spark, sf_dir).withColumn("n", n)
    p = p.withColumn("post_number", F.when(F.col("n") % 5 == 0, "").otherwise(F.col("post_number"))).withColumn("text", F.when(F.col("n") % 4 == 0, " ").otherwise(F.col("text")))
    return p.withColumn("author", F.when(F.col("n") % 3 == 0, "Quoting x").when(F.col("n") % 7 == 0, "Unknown").otherwise(F.col("author"))).withColumn("key", F.col("post_id"))


REASONS = """concat_ws(',', CASE WHEN n % 5 = 0 THEN 'weak_post_signals' END, CASE WHEN n % 3 = 0 THEN 'author_is_quote_header' END, CASE WHEN n % 3 <> 0 AND n % 7 = 0 THEN 'weak_author' END,
    CASE WHEN n % 4 = 0 OR trim(text) = '' THEN 'empty_post' END, CASE WHEN n % 5 = 0 THEN 'missing_label_and_timestamp' END)"""


@query("post_validation_reasons", f"SELECT post_id, {REASONS} AS reasons, n % 5 <> 0 AND n % 4 <> 0 AND trim(text) <> '' AS accepted FROM (SELECT *, {NUMBER} AS n FROM ({CONV}))")
def post_validation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.judged_posts(spoilt_posts(spark, sf_dir)).select("post_id", F.array_join("validation_reasons", ",").alias("reasons"), "accepted")


for _side, _test in (("accepted_posts", ""), ("rejected_posts", "NOT ")):

    @query(_side, f"SELECT post_id FROM (SELECT *, {NUMBER} AS n FROM ({CONV})) WHERE {_test}(n % 5 <> 0 AND n % 4 <> 0 AND trim(text) <> '')")
    def _judged(spark: SparkSession, sf_dir: str, test: str = _test) -> DataFrame:
        return validate.judged_posts(spoilt_posts(spark, sf_dir)).filter(f"{test}accepted").select("post_id")


def expected_pages(p: DataFrame) -> DataFrame:
    """Pages with the labels that their posts should have."""
    each = p.groupBy("thread_id", "page").agg(F.sort_array(F.collect_list("n")).alias("e"))
    return each.select("thread_id", "page", F.transform("e", lambda x: x.cast("string")).alias("expected"))


@query(
    "validate_pages",
    f"""WITH p AS (SELECT *, {NUMBER} AS n, {NUMBER} % 5 <> 0 AND {NUMBER} % 4 <> 0 AND trim(text) <> '' AS ok FROM ({CONV})),
    g AS (SELECT thread_id, page, count(*) AS expected, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n) FILTER (NOT ok) AS missing FROM p GROUP BY ALL)
    SELECT thread_id, page, CAST(expected AS INTEGER) AS expected, CAST(accepted AS INTEGER) AS accepted, CAST(rejected AS INTEGER) AS rejected, coalesce(missing, '') AS missing, rejected = 0 AS passed,
        concat_ws('; ', CASE WHEN rejected > 0 THEN 'expected ' || expected || ' labelled posts but accepted ' || accepted END,
            CASE WHEN page = 1 AND starts_with(missing || ',', '1,') THEN 'page 1 opener missing' END, 'missing post numbers: ' || missing, CASE WHEN rejected > 0 THEN 'rejected ' || rejected || ' weak candidate(s)' END,
            CASE WHEN accepted > 0 THEN accepted || ' accepted post(s) had Unknown date' END) AS warnings FROM g""",
)
def validate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = validate.judged_posts(spoilt_posts(spark, sf_dir))
    v = validate.validate_pages(expected_pages(p), p)
    return v.select("thread_id", "page", F.col("validation.expected_post_count").alias("expected"), F.col("validation.accepted_post_count").alias("accepted"), F.col("validation.rejected_post_count").alias("rejected"), F.array_join("validation.missing_post_numbers", ", ").alias("missing"), "validation.passed", F.array_join("validation.warnings", "; ").alias("warnings"))


@query("missing_post_numbers", f"SELECT thread_id, page, CAST(n AS VARCHAR) AS label FROM (SELECT *, {NUMBER} AS n FROM ({CONV})) WHERE n % 5 = 0 OR n % 4 = 0 OR trim(text) = ''")
def missing_post_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = validate.judged_posts(spoilt_posts(spark, sf_dir))
    return validate.missing_posts(expected_pages(p).select("thread_id", "page", F.explode("expected").alias("label")), p)


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state per page of the events: every third page fails its validation."""
    e = A.event_posts(spark, sf_dir).groupBy("thread_id", "page").agg(F.count(F.lit(1)).cast("int").alias("n"))
    v = F.struct((F.col("page") % 3 != 0).alias("passed"), F.col("n").alias("accepted_post_count"), (F.col("page") % 2).cast("int").alias("rejected_post_count"), F.lit(1).alias("unknown_date_posts"))
    return e.select("thread_id", "page", F.col("n").alias("new_posts_count"), F.lit(2).alias("new_images_downloaded"), F.lit(1).alias("new_images_reused"), (F.col("page") % 2 == 0).alias("used_cached_html"), v.alias("validation"))


STATES = f"(SELECT thread_id, page, count(*) AS n FROM ({EVENTS}) GROUP BY ALL)"


@query(
    "run_summary",
    f"""SELECT thread_id, count(*) AS pages_completed, CAST(sum(n) AS BIGINT) AS new_posts, 2 * count(*) AS images_downloaded, count(*) AS images_reused, count(*) FILTER (page % 2 = 0) AS cached_pages,
    CAST(sum(page % 2) AS BIGINT) AS rejected_candidates, count(*) AS unknown_date_posts, count(*) FILTER (page % 3 = 0) AS validation_failures, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (page % 3 = 0), '') AS warning_pages FROM {STATES} GROUP BY thread_id""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = archive.run_summary(page_states(spark, sf_dir))
    return s.withColumn("warning_pages", F.array_join("validation_warning_pages", ",")).drop("validation_warning_pages")


@query(
    "repair_summary",
    f"""SELECT thread_id, count(*) AS pages_requested, count(*) FILTER (page % 2 = 0) AS pages_processed, count(*) FILTER (page % 2 = 0 AND page % 3 <> 0) AS pages_repaired_cleanly,
    count(*) FILTER (page % 6 = 0) AS pages_still_warning, CAST(coalesce(sum(n) FILTER (page % 2 = 0), 0) AS BIGINT) AS posts_added, count(*) FILTER (page % 2 = 0) AS posts_replaced FROM {STATES} GROUP BY thread_id""",
)
def repair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = page_states(spark, sf_dir)
    done = s.filter("page % 2 = 0")
    return archive.repair_summary(s, done.select("thread_id", "page", "validation.passed"), done.select("thread_id", "page", F.col("new_posts_count").alias("added"), F.lit(1).alias("replaced")))


@query("warning_pages_update", f"SELECT thread_id, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (page % 3 = 0 AND page % 2 = 1), '') AS warning_pages FROM {STATES} GROUP BY thread_id")
def warning_pages_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = page_states(spark, sf_dir).select("thread_id", "page", "validation.passed", F.lit("2024-01-01").alias("completed_at"))
    again = s.filter("page % 2 = 0").withColumn("passed", F.lit(True)).withColumn("completed_at", F.lit("2024-01-02"))
    return archive.warning_pages_update(s.unionByName(again)).select("thread_id", F.array_join("warning_pages", ",").alias("warning_pages"))


@query("latest_page_state", f"SELECT thread_id, page, CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END AS attempts FROM {STATES}")
def latest_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_pages(spark, sf_dir).withColumn("attempts", F.lit(1)).withColumn("completed_at", F.lit("2024-01-01"))
    again = s.filter("page % 2 = 0").withColumn("attempts", F.lit(2)).withColumn("completed_at", F.lit("2024-01-02"))
    return archive.latest_page_state(s.unionByName(again)).drop("completed_at")


@query(
    "completion_status",
    f"""SELECT thread_id, m % 3 <> 0 AS complete, CASE WHEN m % 3 = 0 THEN 'final page validation failed' ELSE 'final page validated' END AS reason FROM (SELECT thread_id, max(page) AS m FROM {STATES} GROUP BY thread_id)""",
)
def completion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = page_states(spark, sf_dir).select("thread_id", "page", "validation.passed", "validation.accepted_post_count")
    last = s.groupBy("thread_id").agg(F.max("page").alias("last_page_seen")).withColumn("last_completed_page", F.col("last_page_seen"))
    return archive.completion_status(last, s)


@query(
    "progress_totals",
    f"SELECT thread_id, CASE WHEN m >= 5 THEN m - 4 END AS all_pages, least(10, greatest(0, m - 6)) AS limited, 10 AS unknown FROM (SELECT thread_id, CAST(max(page) AS INTEGER) AS m FROM {STATES} GROUP BY thread_id)",
)
def progress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, none = F.col("m"), F.lit(None).cast("int")
    m = event_pages(spark, sf_dir).groupBy("thread_id").agg(F.max("page").alias("m"))
    total = archive.progress_total_pages
    return m.select("thread_id", total(F.lit(5), F.lit(7), last, none).alias("all_pages"), total(F.lit(5), F.lit(7), last, F.lit(10)).alias("limited"), total(F.lit(5), F.lit(7), none, F.lit(10)).alias("unknown"))


@query(
    "resume_plan",
    f"""WITH t AS (SELECT thread_id, CAST(thread_id AS BIGINT) % 5 AS k, max(page) AS m FROM ({CONV}) GROUP BY thread_id)
    SELECT thread_id, CAST(CASE WHEN k = 0 THEN 9 WHEN k = 1 AND m >= 1 THEN m + 1 WHEN k = 2 AND m >= 2 THEN m + 1 WHEN k = 3 AND m >= 2 THEN m ELSE 1 END AS INTEGER) AS start_page,
        CASE WHEN k = 0 THEN 'state' WHEN k = 1 THEN 'page_markers' WHEN k = 2 AND m >= 2 THEN 'thread_json' WHEN k = 3 AND m >= 2 THEN 'raw_html' ELSE 'requested_with_overlap' END AS source FROM t""",
)
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir).select("thread_id", "page", (F.col("thread_id").cast("long") % 5).alias("k"))
    return archive.resume_plan(p, state=p.filter("k = 0").select("thread_id", F.lit(9).alias("next_page")), markers=p.filter("k = 1"), posts=p.filter("k = 2"), cached=p.filter("k = 3"), requested=2, overlap=1)


@query(
    "repair_candidates",
    f"SELECT DISTINCT thread_id, CAST(page AS INTEGER) AS page FROM (SELECT thread_id, page FROM ({CONV}) WHERE CAST(thread_id AS BIGINT) % 2 = 0 UNION ALL SELECT thread_id, 77 FROM ({CONV}) WHERE CAST(thread_id AS BIGINT) % 2 = 1 UNION ALL SELECT thread_id, 5 FROM ({CONV}))",
)
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    own = p.groupBy("thread_id").agg(F.collect_set("page").alias("pages"))
    even = F.col("thread_id").cast("long") % 2 == 0
    state = own.select("thread_id", F.when(even, F.col("pages")).otherwise(F.array().cast("array<int>")).alias("validation_warning_pages"))
    summary = own.select("thread_id", F.array(F.lit(77), F.lit(0)).alias("validation_warning_pages"))
    return archive.repair_candidates(state, summary, own.select("thread_id", F.lit(5).alias("page")))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page log of the events: page 6 shows page 5 again, page 9 has nothing new."""
    m = A.event_posts(spark, sf_dir).groupBy("thread_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"), F.min(F.col("post_id").cast("long")).cast("string").alias("first_post"))
    first = F.when((F.col("page") == 6) & (F.col("thread_id") < "e"), F.lit("x")).when((F.col("page") == 5) & (F.col("thread_id") < "e"), F.lit("x")).otherwise(F.col("first_post"))
    return m.select("thread_id", "page", "n_blocks", F.when(F.col("page") == 9, 0).otherwise(F.col("n_blocks")).alias("n_new"), first.alias("first_post"), F.lit(1_000_000).alias("last_page"))


@query("repeated_first_post", f"SELECT thread_id, page, page = 6 AND thread_id < 'e' AS repeated FROM {EVENT_PAGES}")
def repeated_first_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.repeated_first_post(crawl_pages(spark, sf_dir)).select("thread_id", "page", "repeated")


@query("crawl_stop_page", f"SELECT DISTINCT thread_id, CASE WHEN thread_id < 'e' THEN 6 ELSE 9 END AS stop_page, CASE WHEN thread_id < 'e' THEN 'first post repeated' ELSE 'no new posts' END AS reason FROM {EVENT_PAGES} WHERE page = 9")
def crawl_stop_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.crawl_stop_page(crawl_pages(spark, sf_dir))


@query("pages_before_stop", f"SELECT thread_id, page FROM {EVENT_PAGES} WHERE page <= CASE WHEN thread_id < 'e' THEN 5 ELSE 9 END")
def pages_before_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.pages_before_stop(crawl_pages(spark, sf_dir)).select("thread_id", "page")


@query(
    "page_time_estimate",
    f"""WITH d AS (SELECT thread_id, page, CAST(page % 7 AS DOUBLE) AS s FROM {EVENT_PAGES}),
    w AS (SELECT *, list(s) OVER (PARTITION BY thread_id ORDER BY page ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l, median(s) OVER (PARTITION BY thread_id ORDER BY page ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM d)
    SELECT thread_id, page, round(greatest(1.0, 0.85 * (0.70 * list_sum(list_transform(l, lambda x, i: x * i)) / (len(l) * (len(l) + 1) / 2) + 0.20 * m) + 0.15 * 4.0), 6) AS estimate FROM w""",
)
def page_time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_pages(spark, sf_dir).withColumn("seconds", (F.col("page") % 7).cast("double"))
    return archive.page_time_estimate(p, F.lit(4.0)).select("thread_id", "page", F.round("estimate", 6).alias("estimate"))


# ---------------------------------------------------------------- pages


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("thread_id"), F.lit(1).alias("page"), F.col("url").alias("page_url"), "html")


def forum_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as forum pages in our own markup, three posts a page."""
    body = F.concat(F.lit('<div class="message">'), F.replace(T.html_escape(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("</div>"))
    post = F.concat(F.lit('<div class="item"><a class="username" href="/u/1">'), T.html_escape(F.col("author")), F.lit('</a> <span class="date">Jan 5, 2024 1:05pm</span> <a href="'), "post_url", F.lit('"># '), "post_number", F.lit("</a>"), body, F.lit("</div>"))
    each = A.conversation_posts(spark, sf_dir).select("thread_id", "page", F.struct(select.number_of(F.col("post_number")).alias("n"), post.alias("html")).alias("x"))
    pages = each.groupBy("thread_id", "page").agg(F.transform(F.sort_array(F.collect_list("x")), lambda r: r["html"]).alias("posts"))
    pager = F.concat(F.lit('<nav><a href="?page=2">2</a> <a href="?page='), (F.col("thread_id").cast("long") % 7 + 2).cast("string"), F.lit('">last</a></nav>'))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><h1>Thread "), "thread_id", F.lit("</h1>"), F.array_join("posts", ""), pager, F.lit("</body></html>"))
    return pages.select("thread_id", "page", F.concat(F.lit("https://forum.example/thread/"), "thread_id").alias("page_url"), html.alias("html"))


PAGES = """SELECT CAST(thread_id AS VARCHAR) AS thread_id, page, 'https://forum.example/thread/' || thread_id AS page_url,
    '<html><head><title>t</title></head><body><h1>Thread ' || thread_id || '</h1>' || string_agg('<div class="item"><a class="username" href="/u/1">' || author || '</a> <span class="date">Jan 5, 2024 1:05pm</span> <a href="' || post_url || '"># ' || post_number ||
        '</a><div class="message">' || replace({escaped}, chr(10), '<br>') || '</div></div>', '' ORDER BY {number}) || '<nav><a href="?page=2">2</a> <a href="?page=' || (CAST(thread_id AS BIGINT) % 7 + 2) || '">last</a></nav></body></html>' AS html
    FROM ({posts}) GROUP BY thread_id, page"""
ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
PAGES = PAGES.format(escaped=ESCAPED.format("text"), number=NUMBER, posts=CONV)


def resolved(text: str) -> str:
    """SQL that resolves the references of pages, in the tree and again in the text; as HTML has it, these count also without their semicolon, as where a title was cut."""
    for name, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")) * 2:
        text = f"regexp_replace({text}, '&{name};?', '{letter}', 'g')"
    return text


HEADING = "regexp_extract(html, '<{0}[^>]*>([^<]*)</{0}>', 1)"


@query(
    "page_title",
    f"""WITH p AS (SELECT page_id, {HEADING.format('h1')} AS h, {HEADING.format('title')} AS t FROM pages)
    SELECT CAST(page_id AS VARCHAR) AS thread_id, trim(regexp_replace({resolved("CASE page_id % 3 WHEN 0 THEN h ELSE t END")}, '\\s+', ' ', 'g')) AS title FROM p""",
)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the supplied pages; every third page has a blank heading, every third none."""
    k = F.col("thread_id").cast("long") % 3
    html = F.when(k == 1, F.regexp_replace("html", "<h1[^>]*>[^<]*</h1>", "<h1> \n</h1>")).when(k == 2, F.regexp_replace("html", "(</?)h1", "$1h2")).otherwise(F.col("html"))
    return parse.parse_pages(raw_pages(spark, sf_dir).withColumn("html", html)).select("thread_id", "title")


@query("last_page", f"SELECT DISTINCT thread_id, page, greatest(page, CAST(thread_id AS BIGINT) % 7 + 2)::INTEGER AS last FROM ({CONV})")
def last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_pages(forum_pages(spark, sf_dir)).select("thread_id", "page", parse.last_page().alias("last"))


@query("expected_post_numbers", f"SELECT thread_id, page, string_agg(post_number, ',' ORDER BY {NUMBER}) AS expected FROM ({CONV}) GROUP BY ALL")
def expected_post_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_pages(forum_pages(spark, sf_dir)).select("thread_id", "page", F.array_join("expected", ",").alias("expected"))


@query("parse_pages", f"SELECT thread_id, page, post_id, post_number, 'https://forum.example' || post_url AS post_url, author, 'Jan 5, 2024 1:05pm' AS \"timestamp\", true AS accepted FROM ({CONV})")
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.posts_of_pages(forum_pages(spark, sf_dir)).select("thread_id", "page", "post_id", "post_number", "post_url", "author", "timestamp", "accepted")


#: A content element of fewer than twenty characters is none: then the body is the post's block, with author, date and number before the text.
BLOCK = "CASE WHEN length({squeezed}) < 20 THEN author || ' Jan 5, 2024 1:05pm # ' || post_number || {text} ELSE {text} END"


def body_sql(text: str) -> str:
    """SQL of the body of a forum page's post with this text."""
    return clean(f"({BLOCK.format(squeezed=SQUEEZED.format(text), text=text)})")


@query("body_text", f"SELECT post_id, {body_sql('text')} AS body FROM ({CONV})")
def body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.posts_of_pages(forum_pages(spark, sf_dir)).select("post_id", F.col("body_text").alias("body"))


@query("validated_pages", f"SELECT thread_id, page, page % 2 = 1 AS passed, CASE WHEN page % 2 = 1 THEN '' ELSE '999' END AS missing FROM ({CONV}) GROUP BY ALL")
def validated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages name one post more than they hold."""
    html = F.when(F.col("page") % 2 == 0, F.replace("html", F.lit("<nav>"), F.lit('<a href="/thread/post/999"># 999</a><nav>'))).otherwise(F.col("html"))
    v = parse.validated_pages(parse.parse_pages(forum_pages(spark, sf_dir).withColumn("html", html)))
    return v.select("thread_id", "page", "validation.passed", F.array_join("validation.missing_post_numbers", ",").alias("missing"))


@query(
    "longest_block_per_label",
    f"""WITH p AS (SELECT *, CASE page % 3 WHEN 0 THEN 'longer first ' WHEN 1 THEN '' ELSE 'longer second ' END || text AS longest FROM ({CONV}))
    SELECT thread_id, page, post_number, {body_sql('longest')} AS body FROM p""",
)
def longest_block_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post stands on its page twice: alike, or one of both with more words."""
    mark, k = '<div class="message">', F.col("page") % 3
    told = lambda c, word, rest: F.when(k == rest, F.replace(c, F.lit(mark), F.lit(f"{mark}longer {word} "))).otherwise(c)
    items = F.regexp_extract("html", r'(?s)(<div class="item">.*)<nav>', 1)
    twice = forum_pages(spark, sf_dir).withColumn("html", F.concat(told(items, "first", 0), told(items, "second", 2)))
    return parse.posts_of_pages(twice).select("thread_id", "page", "post_number", F.col("body_text").alias("body"))


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum pages whose posts have images, attachments and a signature; post 1 has no number, and every third a plain date and author."""
    n = select.number_of(F.col("post_number"))
    by = F.when(n % 3 == 0, F.concat(F.lit('<b></b><a href="/member/x">'), "author", F.lit("</a> <i>Jan 5, 2024 1:05pm</i> "))).otherwise(F.concat(F.lit('<a class="username">'), "author", F.lit('</a> <span class="date">Jan 5, 2024 1:05pm</span> ')))
    number = F.when(n == 1, "").otherwise(F.concat(F.lit('<a href="'), "post_url", F.lit('"># '), "post_number", F.lit("</a>")))
    more = '<img src="/i/{0}.png"><img src="/avatar/1.png"><a href="/attachment/image/{0}/thumbnail">pic {0}</a><div><a href="/attachment/file/{0}">plan.zip</a> 12 KB | 1,204 downloads</div><hr>my sig<br>my sig<br>bye {0}</div></div>'
    parts = [x for piece in more.split("{0}") for x in (F.col("post_id"), F.lit(piece))][1:]
    item = F.concat(F.lit('<div class="item">'), by, number, F.lit('<div class="message">'), F.replace(T.html_escape(F.col("text")), F.lit("\n"), F.lit("<br>")), *parts)
    each = A.conversation_posts(spark, sf_dir).select("thread_id", "page", F.struct(n.alias("n"), item.alias("html")).alias("x"))
    pages = each.groupBy("thread_id", "page").agg(F.transform(F.sort_array(F.collect_list("x")), lambda r: r["html"]).alias("posts"))
    html = F.concat(F.lit("<html><body><h1>t</h1>"), F.array_join("posts", ""), F.lit("</body></html>"))
    return pages.select("thread_id", "page", F.concat(F.lit("https://forum.example/thread/"), "thread_id").alias("page_url"), html.alias("html"))


#: Post 1 is found only beside a numbered post of its page.
FOUND = f"(SELECT * FROM (SELECT *, {NUMBER} AS n, count(*) OVER (PARTITION BY thread_id, page) AS on_page FROM ({CONV})) WHERE n > 1 OR on_page > 1)"


@query("opener_recovery", f"SELECT thread_id, page, post_number, CASE WHEN n = 1 THEN '' ELSE post_id END AS post_id, author, 'Jan 5, 2024 1:05pm' AS \"timestamp\" FROM {FOUND}")
def opener_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.posts_of_pages(rich_pages(spark, sf_dir)).select("thread_id", "page", "post_number", "post_id", "author", "timestamp")


for _name, _sql in (
    ("signature_text", "'my sig' || chr(10) || 'bye ' || post_id"),
    ("attachment_labels", "'pic ' || post_id || '; plan.zip | 12 KB | 1,204 downloads'"),
    ("image_urls", "'https://forum.example/i/' || post_id || '.png; https://forum.example/attachment/image/' || post_id"),
):

    @query(_name, f"SELECT thread_id, post_number, {_sql} AS out FROM {FOUND}")
    def _field(spark: SparkSession, sf_dir: str, column: str = _name) -> DataFrame:
        out = F.col(column) if column == "signature_text" else F.array_join(column, "; ")
        return parse.posts_of_pages(rich_pages(spark, sf_dir)).select("thread_id", "post_number", out.alias("out"))


# ---------------------------------------------------------------- images


def pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with one image of their own and one that the thread shares."""
    own = F.concat(F.lit("https://x.org/"), "post_id", F.lit(".PNG"))
    return posts(spark, sf_dir).withColumn("image_urls", F.array(own, F.lit("https://x.org/shared.gif"))).withColumn("images", F.array(F.lit("images/a.png"), F.concat(F.lit("images/"), "post_id", F.lit(".jpg"))))


@query(
    "image_manifest",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY {ORDER}) AS r, first_value(post_id) OVER (PARTITION BY thread_id ORDER BY {ORDER}) AS f FROM ({CONV}))
    SELECT thread_id, post_id, 1 AS idx, 'https://x.org/' || post_id || '.PNG' AS url, 'images/post_' || post_id || '_01.png' AS local_path, 'first' AS status FROM p
    UNION ALL SELECT thread_id, post_id, 2, 'https://x.org/shared.gif', 'images/post_' || f || '_02.gif', CASE WHEN r = 1 THEN 'first' ELSE 'reused' END FROM p""",
)
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_manifest(pictured(spark, sf_dir))


def picture_files(p: DataFrame) -> DataFrame:
    """The shared image of every thread, with the thread's name as content."""
    return p.select("thread_id").distinct().select("thread_id", F.lit("images/a.png").alias("path"), F.encode("thread_id", "UTF-8").alias("content"))


@query(
    "resolve_images",
    f"SELECT thread_id, post_id, 1 AS idx, 'images/a.png' AS path, 'data:image/png;base64,' || base64(encode(thread_id)) AS uri FROM ({CONV}) UNION ALL SELECT thread_id, post_id, 2, 'images/' || post_id || '.jpg', 'images/' || post_id || '.jpg' FROM ({CONV})",
)
def resolve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictured(spark, sf_dir)
    return images.resolve_images(p, picture_files(p))


@query("image_counts", f"SELECT thread_id, count(*) AS images FROM ({CONV}) GROUP BY thread_id")
def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.conversation_posts(spark, sf_dir)
    files = p.select("thread_id", F.concat("post_id", F.lit(".png")).alias("path"))
    return images.image_counts(files.unionByName(files.withColumn("path", F.concat("path", F.lit(".part")))))


@query("embedded_report", f"SELECT thread_id, count(*) AS posts, count(*) FILTER (text <> '') AS images_embedded, count(*) FILTER (text <> '') AS images_fallback FROM ({CONV}) GROUP BY thread_id")
def embedded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictured(spark, sf_dir)
    r = report.embedded_report(render.with_embedded(p, picture_files(p)))
    return r.select("thread_id", "posts", F.col("images_embedded").cast("long").alias("images_embedded"), F.col("images_fallback").cast("long").alias("images_fallback"))


# ---------------------------------------------------------------- documents


PICTURES = "['images/a.png', 'images/' || post_id || '.jpg']"
INLINE = "['data:image/png;base64,' || base64(encode(thread_id)), 'images/' || post_id || '.jpg']"


def markdown_sql(number: str = "post_number") -> str:
    """A post of a conversation as Markdown."""
    return f"'## Post ' || {number} || ' — ' || author || chr(10) || chr(10) || 'Page ' || page || ' | Unknown date | ' || post_url || CASE WHEN trim({clean()}) = '' THEN '' ELSE chr(10) || chr(10) || trim({clean()}) END"


def html_sql(images: str = "[]", number: str = "post_number") -> str:
    """A post of a conversation as HTML, with a list of images behind its text."""
    lines = f"list_transform(list_filter(string_split({clean()}, chr(10)), lambda x: x <> ''), lambda x: '<p>' || {ESCAPED.format('x')} || '</p>')"
    shown = f"list_transform({images}, lambda x: '<img src=\"' || x || '\" alt=\"post image\" loading=\"lazy\">')"
    return f"""'<article id="post-' || {number} || '">' || chr(10) || '<h2>Post ' || {number} || ' — ' || author || '</h2>' || chr(10) || '<p>Page ' || page || ' | Unknown date | <a href="' || post_url || '">link</a></p>' || chr(10)
        || CASE WHEN trim({clean()}) = '' THEN '' ELSE array_to_string(list_concat({lines}, {shown}), chr(10)) END || chr(10) || chr(10) || chr(10) || '</article>'"""


@query("render_markdown", f"SELECT post_id, {markdown_sql()} AS markdown FROM ({CONV})")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(render.render_markdown(posts(spark, sf_dir)), "markdown")


def _rendered(rows: DataFrame, column: str) -> DataFrame:
    """(post_id, column): the last part of the key is the id."""
    names = rows.select("key.*").columns
    return rows.select(F.col(f"key.{names[-1]}").alias("post_id"), column)


@query("render_html", f"SELECT post_id, {html_sql()} AS html FROM ({CONV})")
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(render.render_html(posts(spark, sf_dir)), "html")


@query("render_embedded_post", f"SELECT post_id, {html_sql(INLINE)} AS html FROM ({CONV})")
def render_embedded_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictured(spark, sf_dir)
    return _rendered(render.render_html(render.with_embedded(p, picture_files(p))), "html")


@query(
    "thread_documents",
    f"SELECT thread_id, CAST(count(*) AS INTEGER) AS posts, string_agg(text, chr(10) || chr(10) ORDER BY {ORDER}) AS document FROM ({CONV}) GROUP BY thread_id",
)
def thread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return render.assemble_threads(p.select("thread_id", F.struct(*select.sort_key()).alias("key"), "text"), "text")


@query("thread_parts", f"SELECT thread_id, text, row_number() OVER (PARTITION BY thread_id ORDER BY {ORDER}) AS place FROM ({CONV})")
def thread_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as they stand in the ordered part files; their places are counted from what was written."""
    stage, p = Stage(spark, "parts"), posts(spark, sf_dir)
    parts = render.thread_parts(p.select("thread_id", F.struct(*select.sort_key()).alias("key"), "text"), "text")
    written = stage.put("parts", parts.select("thread_id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    return numbered(written, ["thread_id"], [F.col("part"), F.col("at")], "place").select("thread_id", "text", "place")


HTML_HEAD = f"""'<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Thread ' || thread_id || '</title><style>{render.STYLE}</style></head><body>' || chr(10) || '<h1>Thread ' || thread_id || '</h1>' || chr(10)
    || '<p><a href="https://forum.example/' || thread_id || '">source</a>, ' || count(*) || ' posts</p>' || chr(10)"""
EXPORTS = {
    "export_markdown": f"""SELECT thread_id, '# Thread ' || thread_id || chr(10) || chr(10) || 'Source: https://forum.example/' || thread_id || chr(10) || 'Posts: ' || count(*) || chr(10) || chr(10)
        || string_agg({markdown_sql()}, chr(10) ORDER BY {ORDER}) || chr(10) AS document FROM ({CONV}) GROUP BY thread_id""",
    "export_html": f"SELECT thread_id, {HTML_HEAD} || string_agg({html_sql()}, chr(10) ORDER BY {ORDER}) || chr(10) || '</body></html>' || chr(10) AS document FROM ({CONV}) GROUP BY thread_id",
}


for _kind, _render, _whole in (("export_markdown", render.render_markdown, render.markdown_document), ("export_html", render.render_html, render.html_document)):

    @query(_kind, EXPORTS[_kind])
    def _export(spark: SparkSession, sf_dir: str, one=_render, whole=_whole, column=_kind.removeprefix("export_")) -> DataFrame:
        p = posts(spark, sf_dir)
        threads = p.select("thread_id").distinct().select("thread_id", F.concat(F.lit("Thread "), "thread_id").alias("title"), F.concat(F.lit("https://forum.example/"), "thread_id").alias("source_url"))
        return whole(threads, render.assemble_threads(one(p), column, joiner="\n"))


@query(
    "export_single_html",
    f"SELECT thread_id, string_agg({html_sql(PICTURES)}, chr(10) ORDER BY {ORDER}) AS document, CAST(count(*) AS INTEGER) AS posts FROM ({CONV}) WHERE lower(author) = 'user' AND page IN (1, 2) GROUP BY thread_id",
)
def export_single_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = select.apply_export_filters(pictured(spark, sf_dir), users="user", pages="1-2")
    return render.assemble_threads(render.render_html(p), "html", joiner="\n")


@query("export_embedded_html", f"SELECT thread_id, string_agg({html_sql(INLINE)}, chr(10) ORDER BY {ORDER}) AS document, CAST(count(*) AS INTEGER) AS posts FROM ({CONV}) WHERE lower(author) = 'user' GROUP BY thread_id")
def export_embedded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = select.apply_export_filters(pictured(spark, sf_dir), users="user")
    return render.assemble_threads(render.render_html(render.with_embedded(p, picture_files(p))), "html", joiner="\n")


#: Bytes of a part in the registered queries: small, so that documents have several.
PART = 4096


def parts_sql(section: str, head: str, foot: str) -> str:
    """Parts of the documents of all conversations: pieces of long sections, dealt by the bytes before them."""
    step = PART // 8 - 1
    return f"""WITH s AS (SELECT thread_id, {ORDER.replace('page, ', 'page AS k1, ').replace(', post_id', ' AS k2, post_id AS k3')}, {section} AS t FROM ({CONV})),
    c AS (SELECT *, unnest(CASE WHEN strlen(t) + 1 > {PART // 2} THEN range(0, (length(t) - 1) // {step} + 1) ELSE [0] END) AS cut FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY k1, k2, k3, cut) AS place,
        CASE WHEN strlen(t) + 1 > {PART // 2} THEN substr(t, cut * {step} + 1, {step}) ELSE t END AS piece FROM c),
    b AS (SELECT *, sum(strlen(piece) + CASE WHEN cut = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY place) - strlen(piece) - CASE WHEN cut = 0 THEN 1 ELSE 0 END AS before FROM p),
    d AS (SELECT thread_id, CAST(before // {PART // 2} + 1 AS INTEGER) AS part, string_agg(CASE WHEN cut = 0 AND place > 1 THEN chr(10) ELSE '' END || piece, '' ORDER BY place) AS text FROM b GROUP BY ALL),
    h AS (SELECT thread_id, {head} AS text FROM ({CONV}) GROUP BY thread_id)
    SELECT * FROM d UNION ALL SELECT thread_id, 0, text FROM h UNION ALL SELECT thread_id, max(part) + 1, {foot} FROM d GROUP BY thread_id"""


MARKDOWN_HEAD = "'# Thread ' || thread_id || chr(10) || chr(10) || 'Source: https://forum.example/' || thread_id || chr(10) || 'Posts: ' || count(*) || chr(10) || chr(10)"
HTML_FOOT = "chr(10) || '</body></html>' || chr(10)"


def thread_list(p: DataFrame) -> DataFrame:
    return p.select("thread_id").distinct().select("thread_id", F.concat(F.lit("Thread "), "thread_id").alias("title"), F.concat(F.lit("https://forum.example/"), "thread_id").alias("source_url"))


@query("export_markdown_parts", parts_sql(markdown_sql(), MARKDOWN_HEAD, "chr(10)"))
def export_markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return render.markdown_parts(thread_list(p), render.render_markdown(p), part_bytes=PART)[0]


@query("export_html_parts", parts_sql(html_sql(), HTML_HEAD, HTML_FOOT))
def export_html_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return render.html_parts(thread_list(p), render.render_html(p), part_bytes=PART)[0]


@query(
    "export_embedded_manifest",
    f"SELECT thread_id, count(*) AS posts, strlen({HTML_HEAD} || string_agg({html_sql(INLINE, 'post_number')}, chr(10) ORDER BY {ORDER}) || {HTML_FOOT}) AS bytes FROM ({CONV}) GROUP BY thread_id",
)
def export_embedded_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and posts of the embedded documents, put together of pieces."""
    p = pictured(spark, sf_dir)
    return render.html_parts(thread_list(p), render.embedded_pieces(p, picture_files(p), part_bytes=PART), "text", part_bytes=PART)[1].select("thread_id", "posts", "bytes")


@query(
    "embedded_without_ids",
    f"SELECT thread_id, post_number, 'data:image/png;base64,' || base64(encode(thread_id)) || ' images/' || {NUMBER} || '.jpg' AS shown, CASE WHEN text = '' THEN 0 ELSE 1 END AS n_embedded FROM ({CONV})",
)
def embedded_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose ids are empty, null or the same for a whole thread: each shows its own images."""
    n = select.number_of(F.col("post_number"))
    ident = F.when(n % 3 == 0, "").when(n % 3 == 1, F.lit(None).cast("string")).otherwise(F.lit("same"))
    p = pictured(spark, sf_dir).withColumn("post_id", ident).withColumn("images", F.array(F.lit("images/a.png"), F.concat(F.lit("images/"), n.cast("string"), F.lit(".jpg"))))
    return render.with_embedded(p, picture_files(p)).select("thread_id", "post_number", F.array_join("images", " ").alias("shown"), "n_embedded")


# ---------------------------------------------------------------- sources, sinks and streams


@query("write_read_archive", f"SELECT thread_id, post_id, page, author FROM ({CONV})")
def write_read_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'archive').root}/posts"
    writers.write_archive(posts(spark, sf_dir).withColumn("raw_html", F.lit("<p>")), path)
    return spark.read.parquet(path).select("thread_id", "post_id", "page", "author")


@query("read_raw_pages", f"SELECT thread_id, page, page_url, html FROM ({PAGES})")
def read_raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'raw-pages').root}/pages"
    writers.write_raw_pages(forum_pages(spark, sf_dir), path)
    return readers.read_page_table(spark, path)


@query("read_page_state", f"SELECT DISTINCT thread_id, page FROM ({CONV})")
def read_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'markers').root}/pages"
    writers.write_page_state(A.conversation_posts(spark, sf_dir).select("thread_id", "page", F.lit(1).alias("attempts")), path)
    return readers.read_page_state_table(spark, path)


@query("read_resume_state", f"SELECT thread_id, CAST(max(page) + 1 AS INTEGER) AS next_page, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS warning_pages FROM (SELECT DISTINCT thread_id, page FROM ({CONV})) GROUP BY thread_id")
def read_resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'resume-state').root}/state"
    pages = A.conversation_posts(spark, sf_dir).groupBy("thread_id").agg((F.max("page") + 1).alias("next_page"), F.sort_array(F.collect_set("page")).alias("validation_warning_pages"))
    writers.write_resume_state(pages, path)
    return readers.read_resume_table(spark, path).select("thread_id", "next_page", F.array_join("validation_warning_pages", ",").alias("warning_pages"))


@query("read_images", f"SELECT 'thread_id=' || thread_id AS thread_id, count(*) AS files, max(thread_id) || chr(10) AS content FROM (SELECT DISTINCT thread_id FROM ({CONV})) GROUP BY thread_id")
def read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file per thread in the layout of image folders, read as bytes."""
    root = f"{Stage(spark, 'images').root}/files"
    names = A.conversation_posts(spark, sf_dir).select("thread_id").distinct()
    writers.write_thread_files(names.withColumn("value", F.col("thread_id")), root)
    return readers.read_images(spark, root, folder="").groupBy("thread_id").agg(F.count(F.lit(1)).alias("files"), F.max(F.decode("content", "UTF-8")).alias("content"))


@query("read_archive", f"SELECT thread_id, post_id, page, author, text FROM ({CONV})")
def read_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, p = f"{Stage(spark, 'documents').root}/documents", validate.judged_posts(posts(spark, sf_dir))
    writers.write_documents(render.thread_document(p, p.select("thread_id").distinct()), path)
    return readers.read_document_table(spark, path).select("thread_id", "post_id", "page", "author", "text")


@query("read_selection_file", "SELECT DISTINCT conv_id + 1 AS lo, conv_id + 1 + turn AS hi FROM conversations")
def read_selection_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, lo = f"{Stage(spark, 'selection').root}/spec", F.col("conv_id") + 1
    line = F.concat(F.lit("#"), (lo + F.col("turn")).cast("string"), F.lit("-#"), lo.cast("string"), F.lit(", x 0"))
    read_table(spark, sf_dir, "conversations").select(line.alias("value")).write.text(path)
    return readers.read_selection_file(spark, path)


@query("write_report", f"SELECT thread_id, count(*) AS total_posts, count(*) AS exported_posts, 'all_posts' AS filter_mode FROM ({CONV}) GROUP BY thread_id")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, p = f"{Stage(spark, 'report').root}/report", A.conversation_posts(spark, sf_dir)
    writers.write_report(report.export_report(p, p, filtered=False), path)
    return spark.read.schema("thread_id string, total_posts long, exported_posts long, filter_mode string").json(path)


@query("assemble_thread_document", f"SELECT thread_id, count(*) AS total_posts, string_agg(post_id, ',' ORDER BY {ORDER}) AS ids FROM ({CONV}) GROUP BY thread_id")
def assemble_thread_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    docs = render.thread_document(p, p.select("thread_id").distinct())
    return docs.select("thread_id", "total_posts", F.array_join(F.transform("posts", lambda r: r["post_id"]), ",").alias("ids"))


@query("thread_document_manifest", f"SELECT thread_id, count(*) AS posts, count(*) AS total_posts FROM ({CONV}) GROUP BY thread_id")
def thread_document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads as JSON in parts: posts by the manifest, and as the header tells them."""
    p = posts(spark, sf_dir)
    parts, manifest = render.thread_document_parts(p, p.select("thread_id").distinct(), part_bytes=PART)
    told = parts.filter("part = 0").select("thread_id", F.regexp_extract("text", '"total_posts":([0-9]+)', 1).cast("long").alias("total_posts"))
    return manifest.join(told, "thread_id").select("thread_id", "posts", "total_posts")


@query("write_post_snapshots", f"SELECT thread_id, post_id AS snapshot, 'late' AS author FROM ({CONV})")
def write_post_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, p = f"{Stage(spark, 'snapshots').root}/posts", posts(spark, sf_dir)
    writers.write_post_snapshots(p.withColumn("at", F.lit(1)).unionByName(p.withColumn("author", F.lit("late")).withColumn("at", F.lit(2))), path, "at")
    return spark.read.parquet(path).select("thread_id", "snapshot", "author")


@query("write_page_state", f"SELECT thread_id, page, CAST(n AS INTEGER) AS new_posts_count FROM {STATES}")
def write_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'page-state').root}/pages"
    writers.write_page_state(page_states(spark, sf_dir), path)
    return spark.read.parquet(path).select("thread_id", "page", "new_posts_count")


@query("write_resume_state", f"SELECT thread_id, CAST(max(page) + 1 AS INTEGER) AS next_page FROM ({CONV}) GROUP BY thread_id")
def write_resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'resume').root}/state"
    writers.write_resume_state(A.conversation_posts(spark, sf_dir).groupBy("thread_id").agg((F.max("page") + 1).alias("next_page")), path)
    return spark.read.schema("thread_id string, next_page int").json(path)


@query("ingest_pages_stream", f"SELECT thread_id, post_id, post_number, author FROM ({CONV})")
def ingest_pages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive as a stream of table files and are upserted batch by batch."""
    stage = Stage(spark, "stream")
    raw = stage.put("raw", forum_pages(spark, sf_dir))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).parquet(stage.paths["raw"])
    ingest.ingest_pages_stream(spark, stream, f"{stage.root}/archive", f"{stage.root}/checkpoint", f"{stage.root}/repair")
    return ArchiveLog(spark, f"{stage.root}/archive").read().select("thread_id", "post_id", "post_number", "author")


@query(
    "archive_log",
    f"""SELECT thread_id, post_id, page, CASE WHEN {NUMBER} % 4 = 1 THEN 'base' WHEN {NUMBER} % 4 = 2 THEN 'first' ELSE 'second' END AS text FROM ({CONV})
    UNION ALL SELECT thread_id, '', page, 'nameless' FROM ({CONV})""",
)
def archive_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged base and two batches over it: each holds all posts of those before it again, and posts without an id."""
    log, p = ArchiveLog(spark, f"{Stage(spark, 'log').root}/posts"), posts(spark, sf_dir)
    step, nameless = select.number_of(F.col("post_number")) % 4, p.withColumn("post_id", F.lit("")).withColumn("text", F.lit("nameless"))
    log.append(p.filter(step == 1).withColumn("text", F.lit("base")), "a")
    log.compact()
    log.append(p.filter(step.isin(1, 2)).withColumn("text", F.lit("first")).unionByName(nameless), "b")
    log.append(p.withColumn("text", F.lit("second")).unionByName(nameless), "c")
    return log.read().select("thread_id", "post_id", "page", "text")


@query("stream_dedupe", f"SELECT thread_id, post_id FROM ({CONV})")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "dedupe")
    p = A.conversation_posts(spark, sf_dir)
    stage.put("posts", p.unionByName(p).repartition(4))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(stage.paths["posts"])
    out = ingest.stream_dedupe(stream).writeStream.format("parquet").option("path", f"{stage.root}/out").option("checkpointLocation", f"{stage.root}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{stage.root}/out").select("thread_id", "post_id")


@query("stream_dedupe_archive", f"SELECT thread_id, post_id, page FROM ({CONV}) UNION ALL SELECT thread_id, '', page FROM ({CONV}) WHERE {NUMBER} % 3 = 1")
def stream_dedupe_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts arrive twice, some without an id; half of them are in the archive before."""
    stage, p = Stage(spark, "dedupe-archive"), posts(spark, sf_dir)
    n = select.number_of(F.col("post_number"))
    both = p.unionByName(p.filter(n % 3 == 1).withColumn("post_id", F.lit("")))
    stage.put("posts", both.unionByName(both).repartition(4))
    log = ArchiveLog(spark, f"{stage.root}/archive")
    log.append(both.filter(n % 2 == 0))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(stage.paths["posts"])
    ingest.dedupe_into(stream, log, f"{stage.root}/checkpoint")
    return log.read().select("thread_id", "post_id", "page")


@query("stream_page_validation", f"SELECT DISTINCT thread_id, page, CASE WHEN CAST(thread_id AS BIGINT) % 2 = 0 THEN 'repair' ELSE 'retry' END AS action FROM ({CONV}) WHERE page = 2")
def stream_page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page loses its posts but keeps its number anchors; on its second arrival it is whole in every other thread, and must go to repair in the rest."""
    stage, pages = Stage(spark, "validation"), forum_pages(spark, sf_dir)
    spoilt = F.regexp_replace("html", "<div[^>]*>|</div>", "")
    even = F.col("thread_id").cast("long") % 2 == 0
    for k, broken in enumerate((F.col("page") == 2, (F.col("page") == 2) & even)):
        pages.withColumn("html", F.when(broken, spoilt).otherwise(F.col("html"))).write.mode("append").parquet(f"{stage.root}/raw")
        stream = spark.readStream.schema(pages.schema).parquet(f"{stage.root}/raw")
        ingest.ingest_pages_stream(spark, stream, f"{stage.root}/archive", f"{stage.root}/checkpoint", f"{stage.root}/repair")
    last = spark.read.schema(ingest.ACTIONS).parquet(f"{stage.root}/repair/actions").filter("page = 2")
    return last.groupBy("thread_id", "page").agg(F.max_by("action", "attempts").alias("action"))


# ---------------------------------------------------------------- renaming


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the urls' paths: some are Python files, some take a target's name."""
    i = F.col("page_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("a-b-"), i.cast("string"), F.lit(".py"))).when(i % 4 == 1, F.concat(F.lit("a_b_"), (i - 1).cast("string"), F.lit(".py"))).when(i % 4 == 2, F.concat(F.lit("m-"), i.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("x-y_"), i.cast("string"), F.lit(".py")))
    return read_table(spark, sf_dir, "pages").select(F.concat(F.lit("src-"), (i % 8 > 3).cast("int").cast("string"), F.lit("/"), name).alias("path"))


INVENTORY = """(SELECT 'src-' || CAST(page_id % 8 > 3 AS INTEGER) || '/' || CASE page_id % 4 WHEN 0 THEN 'a-b-' || page_id || '.py' WHEN 1 THEN 'a_b_' || (page_id - 1) || '.py' WHEN 2 THEN 'm-' || page_id || '.txt' ELSE 'x-y_' || page_id || '.py' END AS path FROM pages)"""
RENAMES = f"(SELECT path AS old_path, regexp_extract(path, '^(.*/)') || replace(regexp_extract(path, '[^/]*$'), '-', '_') AS new_path FROM {INVENTORY} WHERE ends_with(path, '.py') AND contains(regexp_extract(path, '[^/]*$'), '-'))"


@query("rename_plan", f"SELECT * FROM {RENAMES}")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_plan(inventory(spark, sf_dir))


@query("rename_conflicts", f"SELECT *, CASE WHEN new_path IN (SELECT path FROM {INVENTORY}) THEN 'Target already exists' ELSE 'planned' END AS status FROM {RENAMES}")
def rename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_conflicts(inventory(spark, sf_dir))


@query(
    "rename_summary",
    f"SELECT CASE WHEN new_path IN (SELECT path FROM {INVENTORY}) THEN 'Target already exists' ELSE 'planned' END AS status, count(*) AS files FROM {RENAMES} GROUP BY 1 UNION ALL SELECT 'found', count(*) FROM {RENAMES}",
)
def rename_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_summary(inventory(spark, sf_dir))
