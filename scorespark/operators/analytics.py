"""Error analytics over scored samples and token events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ranking

COMPONENTS = ("ned", "rhythm_ned", "pitch_ned", "lift_ned", "articulation_ned", "slur_ned")


def attach_predictions(truth: DataFrame, predictions: DataFrame, key: str, output: str) -> DataFrame:
    """Truth left-joined with predictions; a missing output becomes an error row instead of vanishing."""
    joined = truth.join(predictions, key, "left")
    return joined.withColumn("error", F.when(F.col(output).isNull(), F.lit("no output")))


def run_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def component_statistics(scored: DataFrame, metrics=COMPONENTS) -> DataFrame:
    """mean / median / min / max per component; NaN counts as absent."""
    long = scored.select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("component"), F.nanvl(F.col(m), F.lit(None)).alias("x")) for m in metrics])
        ).alias("_m")
    ).select("_m.*")
    # scores are dear: reduce them to value counts once, everything else reads that small table
    ensure_checkpoint_dir(scored.sparkSession)
    counts = ranking.value_counts(long, ["component"], "x").checkpoint()
    basic = counts.groupBy("component").agg(
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    middle = ranking.median_of_counts(counts, ["component"], F.floor(F.col("_v") * 4096))
    return basic.join(middle, "component", "left").select("component", "mean", "median", "min", "max")


def score_histogram(scored: DataFrame, score: Column, buckets: int = 10) -> DataFrame:
    """Counts per tenth plus one overflow bucket; empty buckets are listed too."""
    spark = scored.sparkSession
    every = spark.range(buckets + 1).select(F.col("id").cast("int").alias("bucket"))
    counted = scored.groupBy(F.least(F.floor(score * buckets), F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.count("*").alias("n")
    )
    label = F.when(F.col("bucket") == buckets, F.lit(">100%")).otherwise(
        F.concat((F.col("bucket") * 10).cast("string"), F.lit("-"), (F.col("bucket") * 10 + 10).cast("string"), F.lit("%"))
    )
    return every.join(F.broadcast(counted), "bucket", "left").select(
        "bucket", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n")
    )


def top_events(events: DataFrame, event_type: str, field: str, limit: int = 20) -> DataFrame:
    """Most frequent missing (delete, expected side) or hallucinated (insert, actual side) tokens."""
    token = F.col(f"exp_{field}" if event_type == "delete" else f"act_{field}")
    return (
        events.where((F.col("event_type") == event_type) & token.isNotNull())
        .groupBy(token.alias("token"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(limit)
    )


def top_substitutions(events: DataFrame, field: str, limit: int = 20) -> DataFrame:
    exp, act = F.col(f"exp_{field}"), F.col(f"act_{field}")
    return (
        events.where((F.col("event_type") == "substitute") & (exp != act))
        .groupBy(exp.alias("expected"), act.alias("actual"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "expected", "actual")
        .limit(limit)
    )


def error_rates(events: DataFrame, field: str, min_count: int = 20, limit: int = 20) -> DataFrame:
    token = F.col(f"exp_{field}")
    return (
        events.where(token.isNotNull())
        .groupBy(token.alias("token"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "match").alias("errors"))
        .where(F.col("total") >= min_count)
        .withColumn("rate", F.bround(F.col("errors") / F.col("total") * 100, 1))
        .orderBy(F.desc(F.col("errors") / F.col("total")), "token")
        .limit(limit)
    )


#: Sections of the report: event type (None: all), fields, sides that are counted.
SECTIONS = (
    ("event_breakdown", None, (None,), ()),
    ("missing", "delete", ("rhythm", "pitch", "lift"), ("exp",)),
    ("hallucinated", "insert", ("rhythm", "pitch", "lift"), ("act",)),
    ("substitutions", "substitute", ("rhythm", "pitch"), ("exp", "act")),
    ("error_rates", None, ("rhythm", "pitch"), ("exp",)),
)


def report_rows(events: DataFrame, min_count: int = 20, limit: int = 20) -> DataFrame:
    """All token tables of a report in one pass: section, field, rank, token, other, n, errors, rate.

    Every event says in which tables it counts; one aggregation, combined before its only shuffle, counts them all. The
    first ``limit`` of each table are taken by a ranked filter, which Spark applies in every partition before it brings the
    tables together. Order: most frequent first, error rates highest first, then by token. The rate is in percent.
    """

    def entries() -> list[Column]:
        found = []
        for section, kind, fields, sides in SECTIONS:
            for field in fields:
                values = [F.col(f"{side}_{field}") for side in sides] or [F.col("event_type")]
                fits = F.lit(True) if kind is None else F.col("event_type") == kind
                for value in values:
                    fits = fits & value.isNotNull()
                if len(values) == 2:
                    fits = fits & (values[0] != values[1])
                other = values[1] if len(values) == 2 else F.lit(None).cast("string")
                found.append(F.when(fits, F.struct(F.lit(section).alias("section"), F.lit(field).cast("string").alias("field"), values[0].alias("token"), other.alias("other"))))
        return found

    wrong = F.col("event_type") != "match"
    counted = (
        events.select(F.inline(F.transform(F.array_compact(F.array(*entries())), lambda e: F.struct(e["section"].alias("section"), e["field"].alias("field"), e["token"].alias("token"), e["other"].alias("other"), wrong.alias("wrong")))))
        .groupBy("section", "field", "token", "other")
        .agg(F.count("*").alias("n"), F.count_if("wrong").alias("errors"))
        .where((F.col("section") != "error_rates") | (F.col("n") >= min_count))
    )
    share = F.when(F.col("section") == "error_rates", F.col("errors") / F.col("n"))
    order = W.partitionBy("section", "field").orderBy(F.desc(F.coalesce(share, F.col("n").cast("double"))), "token", "other")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "section", "field", "rank", "token", "other", "n", "errors", F.bround(share * 100, 1).alias("rate")
    )


def report(events: DataFrame, **frames: DataFrame) -> DataFrame:
    """The report as one nested row: a list per table of ``report_rows``, and the small ``frames`` as lists beside them."""
    rows = report_rows(events)
    shown = {"event_breakdown": ("token", "n"), "substitutions": ("token", "other", "n"), "error_rates": ("token", "n", "errors", "rate")}
    lists = []
    for section, _, fields, _ in SECTIONS:
        for field in fields:
            own = (F.col("section") == section) & F.col("field").eqNullSafe(F.lit(field).cast("string"))
            row = F.when(own, F.struct("rank", *shown.get(section, ("token", "n"))))
            name = section if field is None else f"{section}_{field}"
            lists.append(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("rank")).alias(name))
    out = rows.agg(*lists).withColumn("_k", F.lit(0))
    for name, frame in frames.items():  # one-row frames side by side: a join on a constant, bounded by construction
        out = out.join(frame.agg(F.collect_list(F.struct(*frame.columns)).alias(name)).withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k").select(F.struct(*[c for c in out.columns if c != "_k"]).alias("report"))


def field_frequencies(tokens: DataFrame, fields) -> DataFrame:
    """Counts per value of each field in one pass: unpivot, then one aggregation with map-side combine."""
    long = tokens.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("token")) for f in fields])).alias("_f")
    )
    return long.groupBy("_f.field", "_f.token").agg(F.count("*").alias("n"))


def latest_rows(runs: DataFrame, key, order) -> DataFrame:
    """Upsert: the last written row per key wins. max_by combines map-side, so a key written often is no hot spot."""
    rest = [c for c in runs.columns if c not in key]
    return runs.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def side_by_side(events: DataFrame, fields) -> DataFrame:
    """Fixed-width diff line per event: expected left, actual right, with <, > and ! markers."""

    def padded(text: Column, width: int) -> Column:
        return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)

    def column(side: str) -> Column:
        shown = [F.coalesce(F.col(f"{side}_{f}"), F.lit(".")) for f in fields]
        widths = [22, 6, 4, 12]
        return F.concat_ws(" ", *[padded(c, w) for c, w in zip(shown, widths)], shown[-1])

    exp, act = padded(column("exp"), 47), column("act")
    line = (
        F.when(F.col("event_type") == "match", F.concat(F.lit("  "), exp, F.lit("  "), act))
        .when(F.col("event_type") == "delete", F.concat(F.lit("< "), exp))
        .when(F.col("event_type") == "insert", F.concat(F.lit("  "), F.lit(" " * 47), F.lit("> "), act))
        .otherwise(F.concat(F.lit("! "), exp, F.lit("! "), act))
    )
    return events.withColumn("line", line)
