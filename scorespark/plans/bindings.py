"""How the driver tables are read as score data.

Every sequence, page and sample is keyed by a block of a unique row id, so that no group can grow with the data: a
hot user or source never becomes a hot sequence. The SQL fragments say the same for the checks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BLOCK = 64

BASES = ["4", "8", "12", "16", "2", "20", "8.", "28", "1", "0"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def pick(values: list[str], index: Column) -> Column:
    """values[index] for a small constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def block(column: str) -> Column:
    return F.expr(f"{column} div {BLOCK}")


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a token table: one sequence per 64 consecutive event ids."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    k4 = F.floor(k / 4).cast("int")
    base = pick(BASES, k % 10)
    clef = pick(["clef_G2", "clef_F4", "clef_C3"], k4 % 3)
    rhythm = (
        F.when((kind == "error") & (k % 6 <= 1), F.lit("barline"))
        .when(kind == "error", pick(["doublebarline", "repeatStart", "repeatEnd", "repeatEndStart"], k % 6 - 2))
        .when((kind == "signup") & (k % 4 == 0), F.concat(F.lit("keySignature_"), (k4 % 15 - 7).cast("string")))
        .when((kind == "signup") & (k % 4 == 1), F.concat(F.lit("timeSignature/"), pick(["4", "8", "2"], k4 % 3)))
        .when((kind == "signup") & (k % 4 == 2), clef)
        .when(kind == "signup", F.lit("chord"))
        .when((kind == "click") & (k % 11 == 0), F.lit("rest_2m"))
        .when((kind == "click") & (k % 3 == 0), F.concat(F.lit("rest_"), base))
        .when((kind == "click") & (k % 7 == 0), F.lit("note_8G"))
        .otherwise(F.concat(F.lit("note_"), base))
    )
    # stated on the raw columns: the long rhythm expression is not repeated in every field
    resting = (kind == "click") & ((k % 11 == 0) | (k % 3 == 0))
    sounding = kind.isin("view", "purchase") | ((kind == "click") & ~resting)
    placed = sounding | resting | ((kind == "signup") & (k % 4 == 2))

    def note_field(values: list[str]) -> Column:
        return (
            F.when(sounding, pick(values, e % len(values))).when(placed, F.lit("_")).otherwise(F.lit("."))
        )

    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", "value", "props", "event_type")
        .withColumn("rhythm", rhythm)
        .withColumn(
            "pitch",
            F.when(sounding, F.concat(pick(list("CDEFGAB"), k % 7), F.floor(k / 12).cast("string")))
            .when(placed, F.lit("_"))
            .otherwise(F.lit(".")),
        )
        .withColumn("lift", note_field(["_", "#", "b", "N"]))
        .withColumn("articulation", note_field(["_", "staccato", "accent_staccato", "tenuto", "fermata_turn", "_"]))
        .withColumn("slur", note_field(["_", "slurStart", "slurStop", "slurStart_slurStop", "_"]))
        .withColumn("position", F.when(placed, pick(["upper", "lower"], e % 2)).otherwise(F.lit(".")))
        .select(
            block("event_id").alias("seq_id"),
            (e % BLOCK).cast("int").alias("pos"),
            "event_id",
            "user_id",
            "value",
            k.alias("k"),
            "rhythm",
            "pitch",
            "lift",
            "articulation",
            "slur",
            "position",
        )
    )


EVT = """
ev0 AS (
  SELECT event_id AS e, user_id, value, event_type AS kind,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev1 AS (
  SELECT *, CASE
    WHEN kind = 'error' AND k % 6 <= 1 THEN 'barline'
    WHEN kind = 'error' THEN ['doublebarline','repeatStart','repeatEnd','repeatEndStart'][k % 6 - 1]
    WHEN kind = 'signup' AND k % 4 = 0 THEN 'keySignature_' || CAST((k // 4) % 15 - 7 AS VARCHAR)
    WHEN kind = 'signup' AND k % 4 = 1 THEN 'timeSignature/' || ['4','8','2'][(k // 4) % 3 + 1]
    WHEN kind = 'signup' AND k % 4 = 2 THEN ['clef_G2','clef_F4','clef_C3'][(k // 4) % 3 + 1]
    WHEN kind = 'signup' THEN 'chord'
    WHEN kind = 'click' AND k % 11 = 0 THEN 'rest_2m'
    WHEN kind = 'click' AND k % 3 = 0 THEN 'rest_' || ['4','8','12','16','2','20','8.','28','1','0'][k % 10 + 1]
    WHEN kind = 'click' AND k % 7 = 0 THEN 'note_8G'
    ELSE 'note_' || ['4','8','12','16','2','20','8.','28','1','0'][k % 10 + 1] END AS rhythm FROM ev0),
ev2 AS (
  SELECT *, starts_with(rhythm, 'note') AS isn,
         (starts_with(rhythm, 'note') OR starts_with(rhythm, 'rest') OR starts_with(rhythm, 'clef')) AS pl FROM ev1),
evt AS (
  SELECT e // 64 AS seq_id, CAST(e % 64 AS INTEGER) AS pos, e AS event_id, user_id, value, k, rhythm,
    CASE WHEN isn THEN substr('CDEFGAB', k % 7 + 1, 1) || CAST(k // 12 AS VARCHAR) WHEN pl THEN '_' ELSE '.' END AS pitch,
    CASE WHEN isn THEN ['_','#','b','N'][e % 4 + 1] WHEN pl THEN '_' ELSE '.' END AS lift,
    CASE WHEN isn THEN ['_','staccato','accent_staccato','tenuto','fermata_turn','_'][e % 6 + 1]
         WHEN pl THEN '_' ELSE '.' END AS articulation,
    CASE WHEN isn THEN ['_','slurStart','slurStop','slurStart_slurStop','_'][e % 5 + 1]
         WHEN pl THEN '_' ELSE '.' END AS slur,
    CASE WHEN pl THEN ['upper','lower'][e % 2 + 1] ELSE '.' END AS position
  FROM ev2)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a token table: one row per blank-separated word, position counted from 0."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", " ")).alias("pos", "word")
    )


TOK = """
tok AS (
  SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word
  FROM (SELECT doc_id, lang, source, string_split(text, ' ') AS w FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) r)"""


def text_words(text: Column) -> Column:
    """The words of a text: its pieces between white space."""
    return F.split(text, r"\s+")


TEXT_WORDS = "regexp_split_to_array({text}, '\\s+')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as truth/prediction pairs: a user turn is the truth, the assistant turn after it the output.

    The join key (conv_id, turn) is unique, so a hot conversation spreads over all tasks.
    """
    c = table(spark, sf_dir, "conversations")
    truth = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("expected_text"))
    output = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual_text")
    )
    return truth.join(output, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.concat_ws("_", "conv_id", "turn").alias("sample_id"),
        "expected_text",
        "actual_text",
    )


TURN = """
turn_pairs AS (
  SELECT u.conv_id, u.turn, u.conv_id || '_' || u.turn AS sample_id, u.text AS expected_text, a.text AS actual_text
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as page boxes; a page holds 64 consecutive vector ids."""
    return table(spark, sf_dir, "embeddings").select(
        block("vec_id").alias("page"),
        F.col("vec_id").alias("box_id"),
        F.col("label").alias("kind"),
        F.round(F.element_at("embedding", 1).cast("double") * 1000, 3).alias("cx"),
        F.round(F.element_at("embedding", 2).cast("double") * 1000, 3).alias("cy"),
        (F.col("label") + 20).cast("double").alias("w"),
        (F.col("label") * 3 + 16).cast("double").alias("h"),
    )


BOX = """
box AS (
  SELECT vec_id // 64 AS page, vec_id AS box_id, label AS kind,
         round(CAST(embedding[1] AS DOUBLE) * 1000, 3) AS cx, round(CAST(embedding[2] AS DOUBLE) * 1000, 3) AS cy,
         CAST(label + 20 AS DOUBLE) AS w, CAST(label * 3 + 16 AS DOUBLE) AS h FROM embeddings)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as day intervals; a line of intervals holds 64 consecutive order keys."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(
        block("o_orderkey").alias("line"),
        F.col("o_orderkey").alias("iv_id"),
        day.alias("start"),
        (day + 10 + (F.col("o_orderkey") % 21).cast("int")).alias("stop"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("cust"),
    )


IV = """
iv AS (
  SELECT o_orderkey // 64 AS line, o_orderkey AS iv_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS start,
         date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 10 + CAST(o_orderkey % 21 AS INTEGER) AS stop,
         o_totalprice AS price, o_custkey AS cust FROM orders)"""
