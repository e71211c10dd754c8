"""The carried-state rules over long sequences: the whole event table as one sequence, or as a few."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from . import bindings as B
from .registry import query
from .sequence_queries import LEDGER
from .window_queries import KIND

#: Positions per block; small, so that the checks on small tables cross many blocks.
SIZE = 512

ONE = B.EVT + ", evl AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS seq_id, event_id AS pos) FROM evt)"


def one_sequence(spark, sf):
    """All events in order of their id: one sequence that grows with the table."""
    return B.evt(spark, sf).withColumns({"seq_id": F.lit(0).cast("bigint"), "pos": F.col("event_id")})


@query("wn05_long_accidentals", f"""WITH {ONE}, b AS (SELECT *, sum(CASE WHEN contains(rhythm, 'barline') THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS bar,
      CASE WHEN lift IN ('#', 'b', 'N') THEN lift END AS ex FROM evl),
    c AS (SELECT *, last_value(ex IGNORE NULLS) OVER (PARTITION BY bar, pitch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b)
    SELECT pos, pitch, CASE WHEN lift = '.' THEN '.' WHEN ex IS NOT NULL THEN ex WHEN held IN ('#', 'b') THEN held ELSE '_' END AS lift FROM c""")
def long_accidentals(spark, sf):
    return S.carry_accidentals(one_sequence(spark, sf), size=SIZE).select("pos", "pitch", "lift")


@query("wn03_long_signatures", f"""WITH {ONE}, s AS (SELECT *, CASE WHEN starts_with(rhythm, 'clef') AND position = 'upper' THEN 'cu' WHEN starts_with(rhythm, 'clef') THEN 'cl'
      WHEN starts_with(rhythm, 'keySignature') THEN 'k' WHEN starts_with(rhythm, 'timeSignature') THEN 't' END AS cls FROM evl),
    l AS (SELECT *, lag(rhythm) OVER (PARTITION BY cls ORDER BY pos) AS prev FROM s) SELECT pos, rhythm FROM l WHERE cls IS NULL OR prev IS DISTINCT FROM rhythm""")
def long_redundant_signatures(spark, sf):
    return S.drop_redundant_signatures(one_sequence(spark, sf), size=SIZE).select("pos", "rhythm")


@query("wn06_long_signature_carry", f"""WITH {ONE}, d AS (SELECT *, pos // 100 AS doc, {KIND} AS kind FROM evl),
    o AS (SELECT *, coalesce(pos < min(CASE WHEN regexp_matches(rhythm, '^(note|rest)') THEN pos END) OVER (PARTITION BY doc), true) AS opening FROM d),
    u AS (SELECT doc, pos, kind, rhythm, opening FROM o WHERE kind IS NOT NULL UNION ALL
      SELECT min(doc), -1, kk, rr, true FROM d, (VALUES ('clef', 'clef_G2'), ('key', 'keySignature_0'), ('time', 'timeSignature/4')) v(kk, rr) GROUP BY kk, rr),
    l AS (SELECT *, max(CASE WHEN opening THEN pos END) OVER (PARTITION BY doc, kind) AS lo FROM u),
    g AS (SELECT *, lag(rhythm) OVER (PARTITION BY kind ORDER BY pos) AS prev FROM l WHERE NOT opening OR pos = lo)
    SELECT doc, pos, kind, rhythm FROM g WHERE prev IS DISTINCT FROM rhythm""")
def long_signature_carry(spark, sf):
    """Documents of a hundred events, concatenated."""
    rows = one_sequence(spark, sf).withColumn("doc", F.expr("pos div 100"))
    return S.carry_signatures(rows, size=SIZE).select("doc", "pos", "kind", "rhythm")


@query("ag11_long_ledger_lines", "WITH " + ONE + LEDGER[len(B.EVT) :].replace("FROM evt)", "FROM evl)") + " SELECT pos, ledger FROM ledger")
def long_ledger_lines(spark, sf):
    return S.ledger_lines(one_sequence(spark, sf), size=SIZE).select("pos", "ledger")


@query("wn08_long_onsets", f"""WITH RECURSIVE {B.EVT}, r AS (SELECT user_id % 8 AS seq_id, event_id AS pos, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS i,
      CASE WHEN starts_with(rhythm, 'clef') THEN 'clef' WHEN contains(rhythm, 'barline') THEN 'bar' WHEN starts_with(rhythm, 'note') AND k % 4 = 0 THEN 'chord'
        WHEN starts_with(rhythm, 'note') THEN 'note' WHEN starts_with(rhythm, 'rest') THEN 'move' ELSE 'symbol' END AS kind,
      CASE WHEN starts_with(rhythm, 'rest') AND k % 2 = 0 THEN -k ELSE k END AS d, value >= 5 AS visible FROM evt),
    s AS (SELECT seq_id, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS onset FROM (SELECT DISTINCT seq_id FROM r) q
      UNION ALL
      SELECT r.seq_id, r.i, r.pos,
        CASE kind WHEN 'clef' THEN cur WHEN 'symbol' THEN cur + 1 WHEN 'bar' THEN cur + 1 WHEN 'chord' THEN coalesce(head, cur) + d ELSE cur + d END,
        CASE WHEN kind = 'clef' OR (kind = 'note' AND visible) THEN cur WHEN kind = 'symbol' THEN cur + 1 WHEN kind = 'bar' THEN cur + 2 ELSE head END,
        CASE kind WHEN 'symbol' THEN cur + 1 WHEN 'bar' THEN cur + 2 WHEN 'chord' THEN coalesce(head, cur) ELSE cur END
      FROM s JOIN r ON r.seq_id = s.seq_id AND r.i = s.i + 1)
    SELECT seq_id, pos, onset, min(cur) OVER (PARTITION BY seq_id) < 0 AS broken FROM s WHERE i >= 0""")
def long_onsets(spark, sf):
    """Eight sequences of all events, by user."""
    r, k = F.col("rhythm"), F.col("k")
    kind = (
        F.when(r.startswith("clef"), F.lit("clef")).when(r.contains("barline"), F.lit("bar"))
        .when(r.startswith("note") & (k % 4 == 0), F.lit("chord")).when(r.startswith("note"), F.lit("note"))
        .when(r.startswith("rest"), F.lit("move")).otherwise(F.lit("symbol"))
    )
    rows = B.evt(spark, sf).select((F.col("user_id") % 8).alias("seq_id"), F.col("event_id").alias("pos"), kind.alias("kind"), "k", (F.col("value") >= 5).alias("visible"))
    rows = rows.withColumn("duration", F.when((F.col("kind") == "move") & (F.col("k") % 2 == 0), -F.col("k")).otherwise(F.col("k")))
    return S.onsets(rows, size=SIZE).select("seq_id", "pos", F.col("onset").cast("bigint").alias("onset"), "broken")
