"""Mixing sources to target weights: raking and calibrated sampling, in DataFrame operations only.

Documents are counted once into cells (source, language, topic) with their tokens.  Iterative
proportional fitting multiplies cell weights until the source, language and topic marginals meet
their targets.  A document is then kept with probability ``keep`` times its cell's weight over the
cell's tokens, never above one: a cell at that bound is held there while the rest of its source, language or topic is raked to what is left.

A round takes three steps, one by each dimension: weights are summed by its values (combined before the shuffle, so
a source with most of the cells or documents is no hot key) and the sums are joined back.  Rounds end when a round moves no more than
``tolerance`` of all tokens, or after ``rounds``.

Targets come from a table (dimension, value, share), or by default from the data, tempered: a
value's share is its token share to the power of ``temper``, normalised.  No value can get more than
its own tokens over ``keep``: what a target has beyond that goes to the other values in proportion.  Single targets can then be met,
all three dimensions together not always; ``marginals`` tells what was aimed at and what is reached.  Tokens are runs of characters other
than white space.  The topic may be any column of the table; by default it is a plain register by the form of the text.

Defined cases: null source, language or topic is the value ``unknown``; a null or empty text has
no tokens, its document weighs nothing in the cells and is kept or dropped like its cell.  A cell without tokens, and a
table without any, has probability ``keep``.  Values without a target get target zero when a table of
targets is given; null targets count as zero and repeated ones are added.  Repeated rows are sampled each, alike if their ids are equal; null ids count as the id ``null``.
Columns other than the chosen ones are not read by ``calibrate``; ``sample`` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.staging import Stage

DIMENSIONS = ("source", "lang", "topic")
#: Steps in SQL that share out what single targets have beyond their bound, and how little a step may change what each free share gets to be the last.
FILLS, SETTLED = 12, 1e-12
#: A weight this near to its bound counts as held there.
NEAR = 1 - 1e-9
#: Characters whose share tells a register, and the share from which on it does (one of so many characters).
DIGITS, SYMBOLS, CAPITALS = "0123456789", "!#$%&*+/<=>@[]^_`{|}~", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REGISTERS = (("figures", DIGITS, 10), ("symbols", SYMBOLS, 20), ("capitals", CAPITALS, 4), ("lines", "\n", 120))
SHORT = 300


def count_of(text: Column, letters: str) -> Column:
    """How many of a text's characters are among the letters; whole runs of others go at once."""
    own = "".join(c if c.isalnum() else "\\" + c for c in letters)
    return F.length(F.regexp_replace(text, f"[^{own}]+", ""))


def topic_of(text: Column) -> Column:
    """The register of a text: short, figures, symbols, capitals, lines or prose."""
    t = F.coalesce(text, F.lit(""))
    n, out = F.length(t), F.lit("prose")
    for name, letters, one_of in reversed(REGISTERS):
        out = F.when(count_of(t, letters) * one_of > n, name).otherwise(out)
    return F.when(n < SHORT, "short").otherwise(out)


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("double")


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every document; a narrow job."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    topic = topic_of(F.col("text")) if topic is None else topic
    return docs.select("doc_id", known(F.col("source")).alias("source"), known(F.col("lang")).alias("lang"), known(topic).alias("topic"), tokens_of(F.col("text")).alias("tokens"))


def margins_of(cells: DataFrame, temper: float, targets: DataFrame | None) -> DataFrame:
    """(dimension, value, tokens, share) of every source, language and topic; shares are not normalised."""
    each = cells.select("tokens", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("x"))
    margins = each.groupBy("x.dimension", "x.value").agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        return margins.withColumn("share", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(temper))).otherwise(0.0))
    own = targets.groupBy("dimension", "value").agg(F.sum("share").alias("share"))
    return margins.join(own, ["dimension", "value"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)).cast("double"))


def with_targets(margins: DataFrame, everything: float, keep: float) -> DataFrame:
    """Margins with ``target`` in tokens; only a number per dimension passes the driver in each step.

    Each step but the last brings at least one more value to its bound, so there are no more steps than values.
    """
    bound = F.col("tokens") / keep
    scale: dict[str, float] = {}
    while True:
        now = F.lit(0.0)
        for d, x in scale.items():
            now = F.when(F.col("dimension") == d, F.lit(x)).otherwise(now)
        full = (F.col("share") * now >= bound) & F.lit(bool(scale))
        told = margins.groupBy("dimension").agg(F.sum(F.when(full, bound).otherwise(0.0)).alias("bounded"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("free"))
        new = {x.dimension: (everything - x.bounded) / x.free if x.free > 0 else scale.get(x.dimension, 0.0) for x in told.collect()}
        same = new.keys() == scale.keys() and all(abs(x - scale[d]) <= SETTLED * abs(x) for d, x in new.items())
        scale = new
        if same:
            break
    factor = F.lit(0.0)
    for d, x in scale.items():
        factor = F.when(F.col("dimension") == d, F.lit(x)).otherwise(factor)
    return margins.withColumn("target", F.least(F.col("share") * factor, bound))


def raked_by(cells: DataFrame, dimension: str, keep: float) -> DataFrame:
    """One step: weights times what their value's target is over its sum; if it has to grow, weights at their bound stay and the others grow."""
    bound, target, weight = F.col("tokens") / keep, F.col(f"target_{dimension}"), F.col("weight")
    held = weight >= bound * NEAR
    sums = cells.groupBy(dimension).agg(F.sum(F.when(held, weight).otherwise(0.0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(weight)).alias("free"))
    now = F.col("held") + F.col("free")
    grown = F.when(held | (F.col("free") <= 0), weight).otherwise(F.least(bound, weight * (target - F.col("held")) / F.col("free")))
    new = F.when(now <= 0, 0.0).when(target < now, weight * target / now).otherwise(grown)
    return cells.join(sums, dimension).withColumn("weight", new).drop("held", "free")


def rake(stage: Stage, cells: DataFrame, everything: float, *, rounds: int, keep: float, tolerance: float) -> tuple[DataFrame, bool]:
    """Cells with ``weight``, the raked tokens, at most tokens / keep, and whether the last round moved no more than the tolerance."""
    cells = cells.withColumn("weight", F.col("tokens"))
    for k in range(rounds):
        new = cells.withColumn("before", F.col("weight"))
        for d in DIMENSIONS:
            new = raked_by(new, d, keep)
        new = stage.put("cells", new)
        if (new.agg(F.sum(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0) <= tolerance * everything:
            return new.drop("before"), True
        cells = new.drop("before")
    return cells, False


def chance(id_col: Column) -> Column:
    """A fixed number in [0, 1) for each id, from its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cell_odds(stage: Stage, each: DataFrame, *, keep: float, temper: float, rounds: int, tolerance: float, targets: DataFrame | None) -> tuple[DataFrame, DataFrame, bool]:
    """(source, lang, topic, tokens, weight, probability) of every cell, (dimension, value, tokens, share, target) of every value, and whether raking settled."""
    cells = stage.put("counts", each.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    everything = cells.agg(F.sum("tokens")).first()[0] or 0.0
    margins = stage.put("margins", margins_of(cells, temper, targets))
    margins = stage.put("targets", with_targets(margins, everything, keep))
    aimed = cells
    for d in DIMENSIONS:
        aimed = aimed.join(margins.filter(F.col("dimension") == d).select(F.col("value").alias(d), F.col("target").alias(f"target_{d}")), d)
    raked, settled = rake(stage, stage.put("aimed", aimed), everything, rounds=rounds, keep=keep, tolerance=tolerance)
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), keep * F.col("weight") / F.col("tokens"))).otherwise(keep)
    return stage.put("odds", raked.select(*DIMENSIONS, "tokens", "weight", probability.alias("probability"))), margins, settled


def calibrate(
    spark: SparkSession, docs: DataFrame, *, keep: float = 0.5, temper: float = 0.7, rounds: int = 15, tolerance: float = 1e-3, topic: Column | None = None, targets: DataFrame | None = None
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled, settled), one row per document; ``settled`` is false if the rounds ended before they moved little."""
    stage = Stage(spark, "mixing")
    each = stage.put("each", with_cells(docs, topic))  # narrow rows: the texts are read once
    odds, _, settled = cell_odds(stage, each, keep=keep, temper=temper, rounds=rounds, tolerance=tolerance, targets=targets)
    return each.join(odds.drop("tokens", "weight"), list(DIMENSIONS)).select("doc_id", *DIMENSIONS, F.col("tokens").cast("long").alias("tokens"), F.round("probability", 6).alias("probability"), (chance(F.col("doc_id")) < F.col("probability")).alias("sampled"), F.lit(settled).alias("settled"))


def marginals(
    spark: SparkSession, docs: DataFrame, *, keep: float = 0.5, temper: float = 0.7, rounds: int = 15, tolerance: float = 1e-3, topic: Column | None = None, targets: DataFrame | None = None
) -> DataFrame:
    """(dimension, value, tokens, target, reached): tokens that are there, aimed at and raked, of every source, language and topic."""
    odds, margins, _ = cell_odds(Stage(spark, "mixing"), with_cells(docs, topic), keep=keep, temper=temper, rounds=rounds, tolerance=tolerance, targets=targets)
    each = odds.select("weight", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("x"))
    reached = each.groupBy("x.dimension", "x.value").agg(F.sum("weight").alias("reached"))
    return margins.join(reached, ["dimension", "value"]).select("dimension", "value", "tokens", "target", "reached")


def sample(
    spark: SparkSession, docs: DataFrame, *, keep: float = 0.5, temper: float = 0.7, rounds: int = 15, tolerance: float = 1e-3, topic: Column | None = None, targets: DataFrame | None = None
) -> DataFrame:
    """The sampled documents; columns unchanged."""
    odds, _, _ = cell_odds(Stage(spark, "mixing"), with_cells(docs, topic), keep=keep, temper=temper, rounds=rounds, tolerance=tolerance, targets=targets)
    odds = odds.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("probability").alias("__probability"))
    form = topic_of(F.col("text")) if topic is None else topic
    own = docs.select("*", *(F.coalesce(c.cast("string"), F.lit("unknown")).alias(f"__{d}") for d, c in zip(DIMENSIONS, (F.col("source"), F.col("lang"), form))))
    return own.join(odds, [f"__{d}" for d in DIMENSIONS]).filter(chance(F.col("doc_id")) < F.col("__probability")).select(docs.columns)


def oracle_sql(*, keep: float = 0.5, temper: float = 0.7, rounds: int = 15, tolerance: float = 1e-3) -> str:
    """``calibrate`` over ``documents`` as SQL, with all rounds written out; a round after the last one changes nothing."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if x != "\n" else "chr(10)"
    form = " ".join(f"WHEN (length(t) - length(translate(t, {quoted(letters)}, ''))) * {n} > length(t) THEN '{name}'" for name, letters, n in REGISTERS)
    steps = []
    for d in DIMENSIONS:
        steps.append(f"f_{d}_0 AS (SELECT {d}, sum(tokens) / {keep} AS bound, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {temper}) ELSE 0 END AS share, CAST(NULL AS DOUBLE) AS scale FROM t GROUP BY {d})")
        for k in range(FILLS):
            full = "scale IS NOT NULL AND share * scale >= bound"
            free = f"sum(CASE WHEN {full} THEN 0 ELSE share END) OVER ()"
            rest = f"(SELECT sum(tokens) FROM t) - sum(CASE WHEN {full} THEN bound ELSE 0 END) OVER ()"
            steps.append(f"f_{d}_{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {free} > 0 THEN ({rest}) / {free} ELSE coalesce(scale, 0) END AS scale) FROM f_{d}_{k})")
    joined = " ".join(f"JOIN (SELECT {d}, least(share * scale, bound) AS target_{d} FROM f_{d}_{FILLS}) USING ({d})" for d in DIMENSIONS)
    steps.append(f"r0 AS MATERIALIZED (SELECT *, tokens AS weight, tokens AS before, false AS done FROM t {joined})")
    last = "r0"
    for k in range(rounds):
        for i, d in enumerate(DIMENSIONS):
            near = f"weight >= tokens / {keep} * {NEAR!r}"
            held, free = (f"sum(CASE WHEN {near} THEN {a} ELSE {b} END) OVER (PARTITION BY {d})" for a, b in (("weight", "0"), ("0", "weight")))
            steps.append(f"s{k}_{d} AS (SELECT *, {held} AS held, {free} AS free FROM {last})")
            grown = f"CASE WHEN {near} OR free <= 0 THEN weight ELSE least(tokens / {keep}, weight * (target_{d} - held) / free) END"
            new = f"CASE WHEN done THEN weight WHEN held + free <= 0 THEN 0 WHEN target_{d} < held + free THEN weight * target_{d} / (held + free) ELSE {grown} END AS weight"
            new += ", weight AS before" if i == 0 else ""
            steps.append(f"r{k}_{d} AS MATERIALIZED (SELECT * EXCLUDE (held, free) REPLACE ({new}) FROM s{k}_{d})")
            last = f"r{k}_{d}"
        steps.append(f"e{k} AS MATERIALIZED (SELECT * REPLACE (done OR sum(abs(weight - before)) OVER () <= {tolerance} * sum(tokens) OVER () AS done) FROM {last})")
        last = f"e{k}"
    return f"""
    WITH e AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE WHEN length(t) < {SHORT} THEN 'short' {form} ELSE 'prose' END AS topic,
        CAST(len(regexp_extract_all(t, '[^ \\t\\n\\r\\f\\x0B]+')) AS DOUBLE) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
    t AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM e GROUP BY ALL),
    {", ".join(steps)},
    odds AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, {keep} * weight / tokens) ELSE {keep} END AS probability, done AS settled FROM {last})
    SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(probability, 6) AS probability,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled, settled
    FROM e JOIN odds USING (source, lang, topic)"""
