"""Corpus queries: scans, filters, projections, scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import durations as DU
from ..functions import text as X
from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import filters as P
from ..operators import vocab_table
from ..sources import datasets as D
from ..sources import token_lines
from . import bindings as B
from .registry import query
from .sequence_queries import LEDGER, no_tuplet_sql, step_sql

FIELDS = ", ".join(V.TOKEN_FIELDS)


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


# ---- tokens with faults: high values break the vocabulary, low ones the combination rule ---------------------------


def faulty(spark, sf):
    t = B.evt(spark, sf)
    return t.withColumn("articulation", F.when(F.col("value") > 330, F.lit("bogus")).otherwise(F.col("articulation"))).withColumn(
        "position", F.when(F.col("value") < 0.05, F.lit(".")).otherwise(F.col("position"))
    )


FAULTY = B.EVT + """,
faulty AS (SELECT * REPLACE (CASE WHEN value > 330 THEN 'bogus' ELSE articulation END AS articulation,
                             CASE WHEN value < 0.05 THEN '.' ELSE position END AS position) FROM evt)"""
_UNKNOWN = " || ".join(
    f"CASE WHEN {f} NOT IN {sql_list(t)} THEN '{f},' ELSE '' END" for f, t in V.branch_tokens().items()
)
_PLACED = "regexp_matches(rhythm, '^(note|rest|clef)')"
_VALID = " AND ".join(f"(({f} <> '.') = {_PLACED})" for f in V.TOKEN_FIELDS[1:])
REASON = f"CASE WHEN {_UNKNOWN} <> '' THEN 'invalid symbol' WHEN NOT ({_VALID}) THEN 'invalid combination' END"


@query("pf01_vocabulary_membership", f"""WITH {FAULTY}, u AS (SELECT seq_id, pos, {_UNKNOWN} AS unknown FROM faulty)
    SELECT seq_id, pos, rtrim(unknown, ',') AS unknown FROM u WHERE unknown <> ''""")
def vocabulary_membership(spark, sf):
    bad = faulty(spark, sf).where(~P.known_symbol())
    return bad.select("seq_id", "pos", P.unknown_fields().alias("unknown"))


@query("pf02_valid_combination", f"WITH {FAULTY} SELECT seq_id, pos, {_VALID} AS valid FROM faulty")
def valid_combination(spark, sf):
    return faulty(spark, sf).select("seq_id", "pos", T.is_valid_combination().alias("valid"))


@query("pf03_quarantine", f"""WITH {FAULTY}, r AS (SELECT *, {REASON} AS reason FROM faulty),
    bad AS (SELECT seq_id, arg_min(reason, pos) AS reason, count(*) AS bad_tokens FROM r WHERE reason IS NOT NULL GROUP BY 1)
    SELECT seq_id, 'rejected' AS state, reason, bad_tokens FROM bad
    UNION ALL SELECT seq_id, 'accepted', NULL, 0 FROM faulty WHERE seq_id NOT IN (SELECT seq_id FROM bad) GROUP BY 1""")
def quarantine(spark, sf):
    accepted, rejected = P.quarantine(faulty(spark, sf))
    good = accepted.select("seq_id").distinct().select(
        "seq_id", F.lit("accepted").alias("state"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("bad_tokens")
    )
    return rejected.select("seq_id", F.lit("rejected").alias("state"), "reason", "bad_tokens").unionByName(good)


@query("pf04_max_length", f"WITH {B.TOK} SELECT doc_id FROM tok GROUP BY 1 HAVING count(*) <= 606")
def max_length(spark, sf):
    return P.max_length(B.words(spark, sf), ("doc_id",))


@query("pf05_max_ledger_lines", f"""WITH {LEDGER.replace('PARTITION BY seq_id', 'PARTITION BY seq_id, user_id')}
    SELECT seq_id, user_id FROM ledger GROUP BY 1, 2 HAVING coalesce(max(ledger), 0) <= 5""")
def max_ledger(spark, sf):
    """A short window per voice: sequence and user."""
    return P.max_ledger(B.evt(spark, sf), ("seq_id", "user_id"))


@query("pf06_tuplet_ratio", f"""WITH {B.EVT} SELECT seq_id, avg(CASE WHEN {no_tuplet_sql('rhythm')} <> rhythm THEN 1 ELSE 0 END) AS ratio
    FROM evt GROUP BY 1 HAVING avg(CASE WHEN {no_tuplet_sql('rhythm')} <> rhythm THEN 1 ELSE 0 END) <= 0.2""")
def tuplet_ratio(spark, sf):
    return B.evt(spark, sf).groupBy("seq_id").agg(P.tuplet_ratio().alias("ratio")).where("ratio <= 0.2")


@query("pf07_unsupported_symbols", f"""WITH {B.EVT} SELECT seq_id, pos, rhythm FROM evt WHERE seq_id NOT IN
    (SELECT seq_id FROM evt WHERE starts_with(rhythm, 'clef_C3'))""")
def unsupported_symbols(spark, sf):
    kept = P.without_groups(B.evt(spark, sf), F.col("rhythm").startswith("clef_C3"), ["seq_id"])
    return kept.select("seq_id", "pos", "rhythm")


@query("pf08_balanced_slurs", f"""WITH {B.EVT} SELECT seq_id FROM evt GROUP BY 1
    HAVING count(*) FILTER (contains(slur, 'slurStart')) = count(*) FILTER (contains(slur, 'slurStop'))""")
def balanced_slurs(spark, sf):
    return P.keep_sequences(B.evt(spark, sf), P.balanced_slurs())


_DENY = ["src3", "src7"]


@query("pf09_deny_list_exact", "SELECT doc_id FROM documents WHERE source NOT IN ('src3', 'src7') AND NOT starts_with(source, '._')")
def deny_list_exact(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    return docs.where(~F.col("source").isin(_DENY) & ~F.col("source").startswith("._")).select("doc_id")


@query("pf10_deny_list_substring", "SELECT page_id, url FROM pages WHERE NOT (contains(url, '/fr/') OR contains(url, 'ref=x'))")
def deny_list_substring(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", "url").where(~P.contains_any(F.col("url"), ["/fr/", "ref=x"]))


@query("pf11_symbol_class_projection", f"""WITH {B.EVT} SELECT seq_id, pos, rhythm, pitch, lift, '.' AS articulation, '.' AS slur, '.' AS position
    FROM evt WHERE regexp_matches(rhythm, '^(note|rest|keySignature)')""")
def symbol_class_projection(spark, sf):
    kept = B.evt(spark, sf).where(F.col("rhythm").rlike("^(note|rest|keySignature)"))
    return kept.select("seq_id", "pos", "rhythm", "pitch", "lift", *[F.lit(".").alias(f) for f in V.TOKEN_FIELDS[3:]])


@query("pf12_drop_position", f"WITH {B.EVT} SELECT seq_id, pos, rhythm, pitch, lift, articulation, slur FROM evt")
def drop_position(spark, sf):
    return B.evt(spark, sf).select("seq_id", "pos", *V.SCORED_FIELDS)


@query("pf13_unreliable_components", f"""WITH {B.EVT}, s AS (SELECT seq_id, pos, articulation AS a,
      [x FOR x IN string_split(articulation, '_') IF x <> '' AND x NOT IN ('staccato', 'staccatissimo', 'turn')] AS kept FROM evt)
    SELECT seq_id, pos, CASE WHEN a IN ('.', '_') THEN a WHEN len(kept) = 0 THEN '_' ELSE array_to_string(kept, '_') END AS articulation FROM s""")
def unreliable_components(spark, sf):
    return B.evt(spark, sf).select("seq_id", "pos", T.without_unreliable(F.col("articulation")).alias("articulation"))


@query("pf14_strip_naturals", f"WITH {B.EVT} SELECT seq_id, pos, CASE WHEN lift = 'N' THEN '_' ELSE lift END AS lift FROM evt")
def strip_naturals(spark, sf):
    return B.evt(spark, sf).select("seq_id", "pos", T.without_natural(F.col("lift")).alias("lift"))


@query("pf15_upper_staff", f"WITH {B.EVT} SELECT seq_id, pos, CASE WHEN position = 'lower' THEN 'upper' ELSE position END AS position FROM evt")
def upper_staff(spark, sf):
    return B.evt(spark, sf).select("seq_id", "pos", T.to_upper_staff(F.col("position")).alias("position"))


@query("pf16_format_sniffing", """WITH t AS (SELECT page_id, regexp_replace(
      CASE page_id % 4 WHEN 0 THEN '  <?xml version="1.0"?>' WHEN 1 THEN '<!-- c --><score-partwise>' WHEN 2 THEN '**kern' ELSE '' END || html, '^\\s+', '') AS x FROM pages),
    u AS (SELECT *, regexp_replace(regexp_replace(x, '<!--.*?-->', '', 'gs'), '^\\s+', '') AS y,
      regexp_extract(x, '(?m)^([^!\\n][^\\n]*|!(?:[^!\\n][^\\n]*)?)$', 1) AS line FROM t)
    SELECT page_id, starts_with(x, '<?xml') OR (starts_with(y, '<') AND regexp_extract(y, '<([A-Za-z][^\\s/>]*)', 1) = 'score-partwise') AS is_xml,
      starts_with(line, '**') OR contains(line, chr(9) || '**kern') AS is_kern FROM u""")
def format_sniffing(spark, sf):
    head = B.pick(['  <?xml version="1.0"?>', "<!-- c --><score-partwise>", "**kern", ""], F.col("page_id") % 4)
    t = B.table(spark, sf, "pages").select("page_id", F.concat(head, "html").alias("x"))
    return t.select("page_id", X.is_xml(F.col("x")).alias("is_xml"), X.is_kern(F.col("x")).alias("is_kern"))


@query("pf21_tempo_text", f"""WITH {B.TOK} SELECT doc_id, count(*) FILTER (length(word) < 4 OR
    length(regexp_replace(word, '[^A-Za-z]', '', 'g')) < 4) AS tempo, count(*) AS words FROM tok GROUP BY 1""")
def tempo_text(spark, sf):
    return B.words(spark, sf).groupBy("doc_id").agg(
        F.count_if(X.is_tempo_marking(F.col("word"))).alias("tempo"), F.count("*").alias("words")
    )


@query("pf22_corpus_search", """SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS INTEGER) AS n FROM documents
    WHERE contains(text, 'tion')""")
def corpus_search(spark, sf):
    docs = B.table(spark, sf, "documents").where(F.col("text").contains("tion"))
    return docs.select("doc_id", X.occurrences(F.col("text"), "tion").alias("n"))


_KINDS = """CASE WHEN contains(rhythm, 'barline') OR contains(rhythm, 'repeat') THEN 'bar' WHEN starts_with(rhythm, 'clef') THEN 'clef'
    WHEN starts_with(rhythm, 'note') THEN 'note' ELSE 'other' END"""


@query("pf25_typed_subset", f"""WITH {B.EVT} SELECT seq_id, {_KINDS} AS kind, count(*) AS n, count(*) FILTER ({_KINDS} <> 'note') AS not_notes
    FROM evt GROUP BY 1, 2""")
def typed_subset(spark, sf):
    r = F.col("rhythm")
    kind = (
        F.when(T.is_measure_end(r), F.lit("bar")).when(r.startswith("clef"), F.lit("clef")).when(r.startswith("note"), F.lit("note"))
        .otherwise(F.lit("other"))
    )
    typed = B.evt(spark, sf).select("seq_id", kind.alias("kind"))
    return typed.groupBy("seq_id", "kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") != "note").alias("not_notes")
    )


@query("pf26_empty_page_drop", r"""WITH p AS (SELECT page_id, url, TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS INTEGER) AS number,
      (length(html) - length(replace(html, '<li', ''))) // 3 AS items FROM pages)
    SELECT page_id, number, items FROM p WHERE items > 0 ORDER BY number, page_id""")
def empty_page_drop(spark, sf):
    number = F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1).try_cast("int")
    items = F.floor((F.length("html") - F.length(F.replace("html", F.lit("<li"), F.lit("")))) / 3)
    pages = B.table(spark, sf, "pages").select("page_id", number.alias("number"), items.alias("items"))
    return pages.where("items > 0").orderBy("number", "page_id")


@query("pf27_reject_whole_group", f"""WITH {B.EVT} SELECT seq_id, pos, rhythm FROM evt WHERE value >= 1 AND seq_id NOT IN
    (SELECT seq_id FROM evt WHERE rhythm = 'keySignature_7' OR rhythm = 'timeSignature/2')""")
def reject_whole_group(spark, sf):
    """A faulty row rejects its file; an invisible one (low value) only itself."""
    bad = F.col("rhythm").isin("keySignature_7", "timeSignature/2")
    return P.without_groups(B.evt(spark, sf), bad, ["seq_id"]).where("value >= 1").select("seq_id", "pos", "rhythm")


# ---- scans and sinks -----------------------------------------------------------------------------------------------


@query("sc01_token_line_scan", r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, x[i] AS line FROM
        (SELECT doc_id, string_split(replace(text, ',', '&'), chr(10)) AS x FROM documents) d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) r),
      m AS (SELECT doc_id, line_no, i - 1 AS member_no, x[i] AS entry FROM
        (SELECT doc_id, line_no, string_split(line, '&') AS x FROM l) d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) r),
      p AS (SELECT *, [w FOR w IN regexp_split_to_array(entry, '[ \t\n\x0B\f\r]+') IF w <> ''] AS w FROM m WHERE NOT contains(entry, 'tieSlur'))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(member_no AS INTEGER) AS member_no,
      CASE WHEN len(w) BETWEEN 4 AND 6 THEN w[1] END AS rhythm,
      CASE WHEN len(w) = 4 THEN '.' WHEN len(w) BETWEEN 5 AND 6 THEN w[5] END AS slur,
      CASE WHEN len(w) BETWEEN 4 AND 5 THEN 'upper' WHEN len(w) = 6 THEN w[6] END AS position,
      CASE WHEN len(w) NOT BETWEEN 4 AND 6 THEN 'fields: ' || len(w) END AS error FROM p""")
def token_line_scan(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(","), F.lit("&")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parsed = token_lines.parse_lines(lines, ["doc_id"])
    return parsed.select("doc_id", "line_no", "member_no", "rhythm", "slur", "position", "error")


@query("sc07_index_scan", """SELECT doc_id, source || '/' || doc_id || '.jpg' AS image, lang || '/' || doc_id || '.tokens' AS tokens FROM documents""")
def index_scan(spark, sf):
    key = F.col("doc_id").cast("string")
    line = F.concat("source", F.lit("/"), key, F.lit(".jpg,"), "lang", F.lit("/"), key, F.lit(".tokens"))
    return B.table(spark, sf, "documents").select("doc_id", D.parse_index(line).alias("_i")).select("doc_id", "_i.*")


_META = r"""meta AS (SELECT page_id, split_part(url, '/', -1) AS n_tracks, CAST(page_id % 7 AS VARCHAR) AS complexity,
    CASE WHEN page_id % 5 = 0 THEN 'False' ELSE 'True' END AS valid, CASE WHEN page_id % 3 = 0 THEN 'False' ELSE 'True' END AS free FROM pages)"""


def metadata(spark, sf):
    """pages as corpus metadata: the last path element is the number of tracks, often not a number."""

    def flag(n: int):
        return F.when(F.col("page_id") % n == 0, F.lit("False")).otherwise(F.lit("True"))

    return B.table(spark, sf, "pages").select(
        "page_id",
        F.element_at(F.split("url", "/"), -1).alias("n_tracks"),
        (F.col("page_id") % 7).cast("string").alias("complexity"),
        flag(5).alias("subset:all_valid"),
        flag(3).alias("subset:no_license_conflict"),
    )


@query("sc08_metadata_scan", f"""WITH {_META} SELECT page_id, TRY_CAST(n_tracks AS INTEGER) AS n_tracks, TRY_CAST(complexity AS INTEGER) AS complexity
    FROM meta WHERE valid = 'True' AND free = 'True' AND TRY_CAST(n_tracks AS INTEGER) <= 600 AND TRY_CAST(complexity AS INTEGER) <= 3""")
def metadata_scan(spark, sf):
    """Written as CSV with a header and scanned."""
    folder = B.work_folder(spark, "metadata")
    metadata(spark, sf).write.option("header", True).csv(folder)
    return D.read_metadata(spark, folder, 600, 3).select(F.col("page_id").cast("long").alias("page_id"), "n_tracks", "complexity")


@query("sc09_image_listing", """WITH p AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) ||
      ['', '_debug', '_staff', '', '_teaser'][page_id % 5 + 1] || ['.jpg', '.PNG', '.txt', '.jpeg'][page_id % 4 + 1] AS path FROM pages)
    SELECT path FROM p WHERE regexp_matches(path, '[.](jpg|jpeg|png|pdf|JPG|JPEG|PNG|PDF)$') AND NOT
      regexp_matches(split_part(path, '/', -1), '_teaser|_debug|_staff|_tesseract') ORDER BY path""")
def image_listing(spark, sf):
    i = F.col("page_id")
    clean = F.regexp_extract("url", r"^([^?#]*)", 1)
    path = F.concat(clean, B.pick(["", "_debug", "_staff", "", "_teaser"], i % 5), B.pick([".jpg", ".PNG", ".txt", ".jpeg"], i % 4))
    return B.table(spark, sf, "pages").select(path.alias("path")).where(D.is_input_image(F.col("path"))).orderBy("path")


@query("sc10_benchmark_scan", """WITH r AS (SELECT conv_id, turn // 4 AS page, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS kern
      FROM conversations GROUP BY 1, 2),
    l AS (SELECT *, [x FOR x IN string_split(kern, chr(10)) IF trim(x) <> '' AND NOT starts_with(trim(x), '!')][1] AS head FROM r)
    SELECT conv_id, page, CASE WHEN head IS NOT NULL AND NOT starts_with(trim(head), '**')
      THEN array_to_string([ '**kern' FOR x IN string_split(head, chr(9))], chr(9)) || chr(10) || kern ELSE kern END AS kern FROM l""")
def benchmark_scan(spark, sf):
    """Regions (up to four turns) joined to one text, empty ones dropped, with a header where it is missing."""
    c = B.table(spark, sf, "conversations").withColumn("page", F.expr("turn div 4"))
    regions = F.array_sort(F.collect_list(F.struct("turn", "text"))).getField("text")
    joined = c.groupBy("conv_id", "page").agg(D.joined_regions(regions).alias("kern"))
    return joined.select("conv_id", "page", D.with_kern_header(F.col("kern")).alias("kern"))


@query("sc12_index_sink", f"""WITH {FAULTY}, r AS (SELECT *, {REASON} AS reason FROM faulty)
    SELECT 'img/' || seq_id || '.png,tok/' || seq_id || '.tokens' AS line FROM r GROUP BY seq_id HAVING count(reason) = 0""")
def index_sink(spark, sf):
    accepted, _ = P.quarantine(faulty(spark, sf))
    key = F.col("seq_id").cast("string")
    samples = accepted.select("seq_id").distinct().select(
        F.concat(F.lit("img/"), key, F.lit(".png")).alias("image"), F.concat(F.lit("tok/"), key, F.lit(".tokens")).alias("tokens")
    )
    folder = B.work_folder(spark, "index")
    D.write_index(samples, folder)
    return D.read_index_bundle(spark, folder).select(F.concat_ws(",", "image", "tokens").alias("line"))


_VOC = " UNION ALL ".join(
    [
        "SELECT 'rhythm' AS branch, t AS token, 0 AS g, CAST(i AS INTEGER) AS o FROM (SELECT unnest(["
        + ", ".join(f"'{t}'" for t in V.CONTROL_TOKENS + V.BARLINE_TOKENS + V.REPEAT_TOKENS + V.VOLTA_TOKENS + V.CLEF_TOKENS)
        + "]) AS t, generate_subscripts(["
        + ", ".join(f"'{t}'" for t in V.CONTROL_TOKENS + V.BARLINE_TOKENS + V.REPEAT_TOKENS + V.VOLTA_TOKENS + V.CLEF_TOKENS)
        + "], 1) AS i) x",
        "SELECT 'rhythm', 'keySignature_' || i, 1, CAST(i AS INTEGER) FROM range(-7, 8) r(i)",
        "SELECT 'rhythm', 'timeSignature/' || d, 2, d FROM (VALUES (1),(2),(3),(4),(6),(8),(12),(16),(32),(48)) r(d)",
        "SELECT 'rhythm', 'rest_' || i || 'm', 3, CAST(i AS INTEGER) FROM range(2, 11) r(i)",
    ]
    + [
        f"SELECT 'rhythm', '{kind}_' || b || s, {g}, b * 10 + k FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(8),(10),(12),(16),(32),(64),(128)) r(b), "
        f"(VALUES ('', 0), ('.', 1), ('..', 2), ('G', 3), ('G.', 4), ('G..', 5)) q(s, k) "
        f"UNION ALL SELECT 'rhythm', '{kind}_' || b, {g + 1}, b FROM (VALUES (7),(11),(13),(18),(20),(21),(22),(24),(26),(28),(30),(34),(36),(40),(48),(56),(96)) r(b)"
        for kind, g in (("note", 4), ("rest", 6))
    ]
    + [
        "SELECT 'pitch', '.', 0, 0 UNION ALL SELECT 'pitch', '_', 0, 1",
        "SELECT 'pitch', substr('CDEFGAB', CAST(s AS INTEGER) + 1, 1) || o, 1, CAST(-(o * 7 + s) AS INTEGER) FROM range(10) a(o), range(7) b(s)",
    ]
    + [
        f"SELECT '{b}', t, 0, CAST(i AS INTEGER) FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(V.branch_tokens()[b])) + ") x(t, i)"
        for b in ("lift", "articulation", "slur", "position")
    ]
)


# Not registered as a query: it reads no table. The join below uses it on the data.
VOCABULARY_SQL = f"voc AS (SELECT branch, token, row_number() OVER (PARTITION BY branch ORDER BY g, o) - 1 AS id FROM ({_VOC}) v)"


@query("sc17_vocabulary_usage", f"""WITH {B.EVT}, {VOCABULARY_SQL},
    used AS ({" UNION ALL ".join(f"SELECT '{f}' AS branch, {f} AS token FROM evt" for f in V.TOKEN_FIELDS)}),
    n AS (SELECT branch, token, count(*) AS n FROM used GROUP BY 1, 2)
    SELECT voc.branch, voc.token, CAST(id AS INTEGER) AS id, coalesce(n, 0) AS n FROM voc LEFT JOIN n USING (branch, token)""")
def vocabulary_usage(spark, sf):
    """The full vocabulary with ids, and how often the corpus uses each entry."""
    from ..operators import analytics as A

    used = A.field_frequencies(B.evt(spark, sf), V.TOKEN_FIELDS).withColumnRenamed("field", "branch")
    joined = vocab_table.vocabulary(spark).join(used, ["branch", "token"], "left")
    return joined.select("branch", "token", "id", F.coalesce("n", F.lit(0)).alias("n"))


# ---- scalar functions ----------------------------------------------------------------------------------------------

LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate"


@query("sf01_kern_duration", """WITH k AS (SELECT l_quantity, l_linenumber, l_tax,
      CASE WHEN CAST(l_quantity AS INTEGER) % 10 = 9 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) - 1 AS VARCHAR) END
      || CASE WHEN round(l_tax * 100) = 3 THEN 'G' ELSE '' END || repeat('.', CAST(l_linenumber % 3 AS INTEGER)) AS kern FROM lineitem),
    b AS (SELECT kern, CASE WHEN regexp_matches(kern, '^[0-9]') THEN CAST(regexp_extract(kern, '^[0-9]+') AS BIGINT) ELSE 4 END AS base,
      CAST(length(kern) - length(replace(kern, '.', '')) AS INTEGER) AS dots, contains(kern, 'G') AS grace FROM k),
    c AS (SELECT *, CASE WHEN base < 1 THEN 1 ELSE CAST(pow(2, floor(log2(base))) AS BIGINT) END AS p2 FROM b),
    d AS (SELECT *, CASE WHEN grace OR base = 0 OR base = p2 THEN 1 ELSE base END AS an, CASE WHEN grace OR base = 0 OR base = p2 THEN 1 ELSE p2 END AS nn,
      CASE WHEN grace THEN 0 ELSE CAST(pow(2, dots + 1) AS BIGINT) - 1 END AS num,
      CASE WHEN grace THEN 1 ELSE greatest(base, 1) * CAST(pow(2, dots) AS BIGINT) END AS den FROM c)
    SELECT DISTINCT kern, base, dots, an // gcd(an, nn) AS actual, nn // gcd(an, nn) AS normal, num // gcd(num, den) AS num, den // gcd(num, den) AS den FROM d""")
def kern_duration(spark, sf):
    q = F.col("l_quantity").cast("int")
    kern = F.concat(
        F.when(q % 10 == 9, F.lit("")).otherwise((q - 1).cast("string")),
        F.when(F.round(F.col("l_tax") * 100) == 3, F.lit("G")).otherwise(F.lit("")),
        F.expr("repeat('.', l_linenumber % 3)"),
    )
    texts = B.table(spark, sf, "lineitem").select(kern.alias("kern")).distinct()
    return texts.select("kern", DU.duration(F.col("kern")).alias("d")).select("kern", "d.*")


@query("sf02_prior_power_of_two", """SELECT DISTINCT CAST(l_quantity AS BIGINT) - 2 AS n, CASE WHEN l_quantity - 2 < 1 THEN 1
    ELSE CAST(pow(2, floor(log2(l_quantity - 2))) AS BIGINT) END AS power FROM lineitem""")
def prior_power_of_two(spark, sf):
    n = B.table(spark, sf, "lineitem").select((F.col("l_quantity").cast("bigint") - 2).alias("n")).distinct()
    return n.select("n", T.prior_power_of_two(F.col("n")).alias("power"))


_SF3 = "CASE WHEN l_linenumber % 2 = 0 THEN 'note_' ELSE 'rest_' END || CAST(CAST(l_quantity AS INTEGER) - 1 AS VARCHAR) || repeat('.', CAST(l_linenumber % 3 AS INTEGER))"


@query("sf03_remove_tuplet", f"""SELECT r AS rhythm, {no_tuplet_sql('r')} AS plain, {no_tuplet_sql('r')} <> r AS is_tuplet, count(*) AS n
    FROM (SELECT {_SF3} AS r FROM lineitem) x GROUP BY 1""")
def remove_tuplet(spark, sf):
    kind = F.when(F.col("l_linenumber") % 2 == 0, F.lit("note_")).otherwise(F.lit("rest_"))
    r = F.concat(kind, (F.col("l_quantity").cast("int") - 1).cast("string"), F.expr("repeat('.', l_linenumber % 3)"))
    counted = B.table(spark, sf, "lineitem").groupBy(r.alias("rhythm")).agg(F.count("*").alias("n"))
    plain = T.without_tuplet(F.col("rhythm"))
    return counted.select("rhythm", plain.alias("plain"), T.is_tuplet(F.col("rhythm")).alias("is_tuplet"), "n")


@query("sf04_diatonic_step", f"WITH {B.EVT} SELECT seq_id, pos, {step_sql('pitch')} AS step FROM evt")
def diatonic_step(spark, sf):
    return B.evt(spark, sf).select("seq_id", "pos", T.diatonic_step(F.col("pitch")).cast("bigint").alias("step"))


_KEYS = list(V.KEY_FIFTHS) + ["HM"]


@query("sf05_key_fifths", f"""WITH {B.EVT}, k AS (SELECT event_id, [{", ".join(repr(k) for k in _KEYS)}][k % 16 + 1] AS name FROM evt)
    SELECT event_id, name, CASE name {" ".join(f"WHEN '{k}' THEN {v}" for k, v in V.KEY_FIFTHS.items())} ELSE 0 END AS fifths FROM k""")
def key_fifths(spark, sf):
    named = B.evt(spark, sf).select("event_id", B.pick(_KEYS, F.col("k") % 16).alias("name"))
    return named.select("event_id", "name", T.key_fifths(F.col("name")).alias("fifths"))


@query("sf06_compound_marks", f"""WITH {B.EVT}, s AS (SELECT seq_id, pos, [x FOR x IN string_split(articulation, '_') IF x <> ''] AS own FROM evt)
    SELECT seq_id, pos, array_to_string(list_sort(list_concat(['accent', 'fermata'], own)), '_') AS added,
      CASE WHEN len([x FOR x IN own IF x NOT IN ('staccato', 'turn')]) = 0 THEN '_' ELSE array_to_string([x FOR x IN own IF x NOT IN ('staccato', 'turn')], '_') END AS stripped FROM s""")
def compound_marks(spark, sf):
    a = F.col("articulation")
    added = T.add_marks(a, F.array(F.lit("accent"), F.lit("fermata")))
    return B.evt(spark, sf).select("seq_id", "pos", added.alias("added"), T.strip_marks(a, ["staccato", "turn"]).alias("stripped"))


@query("sf08_rest_length", """WITH r AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS duration, CAST(l_linenumber AS INTEGER) * 4 - 4 AS divisions FROM lineitem)
    SELECT duration, divisions, CASE WHEN divisions <= 0 THEN 'rest_1' WHEN abs(duration / divisions - 4) < 0.01 THEN 'rest_1'
      WHEN abs(duration / divisions - 3) < 0.01 THEN 'rest_2.' WHEN abs(duration / divisions - 2) < 0.01 THEN 'rest_2'
      WHEN abs(duration / divisions - 1.5) < 0.01 THEN 'rest_4.' WHEN abs(duration / divisions - 1) < 0.01 THEN 'rest_4'
      WHEN abs(duration / divisions - 0.75) < 0.01 THEN 'rest_8.' WHEN abs(duration / divisions - 0.5) < 0.01 THEN 'rest_8' ELSE 'rest_1' END AS rest FROM r""")
def rest_length(spark, sf):
    pairs = B.table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("int").alias("duration"), (F.col("l_linenumber") * 4 - 4).cast("int").alias("divisions")
    ).distinct()
    return pairs.select("duration", "divisions", DU.measure_rest(F.col("duration"), F.col("divisions")).alias("rest"))


@query("sf15_name_normalisation", r"""WITH n AS (SELECT DISTINCT lower(replace(p_type, ' ', '-')) AS name FROM part
      UNION SELECT unnest(['strong-accent', 'trill-mark', 'inverted-turn', 'accidental-mark', 'wavy-line', 'staccato'])),
    c AS (SELECT name, string_split(name, '-') AS p FROM n),
    d AS (SELECT name, p[1] || array_to_string([upper(substr(x, 1, 1)) || substr(x, 2) FOR x IN p[2:]], '') AS camel FROM c)
    SELECT name, camel, CASE camel WHEN 'strongAccent' THEN 'accent' WHEN 'softAccent' THEN 'accent' WHEN 'invertedTurn' THEN 'turn' WHEN 'trillMark' THEN 'trill'
      WHEN 'wavyLine' THEN 'trill' WHEN 'invertedMordent' THEN 'trill' WHEN 'accidentalMark' THEN NULL ELSE camel END AS mark FROM d""")
def name_normalisation(spark, sf):
    names = B.table(spark, sf, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("name")).distinct()
    extra = ["strong-accent", "trill-mark", "inverted-turn", "accidental-mark", "wavy-line", "staccato"]
    more = spark.createDataFrame([(x,) for x in extra], "name string")
    camel = names.union(more).distinct().select("name", X.camel_case(F.col("name")).alias("camel"))
    return camel.select("name", "camel", DU.articulation_name(F.col("camel")).alias("mark"))


@query("sf16_title_clean_up", """SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS title FROM documents""")
def title_clean_up(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.clean_title(F.col("text")).alias("title"))


@query("sf17_voice_number", """SELECT l_linenumber AS staff, CAST(l_quantity AS INTEGER) % 4 AS layer, (l_linenumber - 1) * 4 + CAST(l_quantity AS INTEGER) % 4 + 1 AS voice,
    count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def voice_number(spark, sf):
    layer = (F.col("l_quantity").cast("int") % 4).alias("layer")
    rows = B.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("staff"), layer)
    return rows.groupBy("staff", "layer", DU.voice_number(F.col("staff"), F.col("layer")).alias("voice")).agg(F.count("*").alias("n"))


@query("sf23_aspect_fit", """WITH s AS (SELECT DISTINCT p_size + 1 AS h, CAST(floor(p_retailprice) AS INTEGER) AS w FROM part)
    SELECT w, h, CASE WHEN h / w > 256.0 / 1280 THEN CAST(trunc(w / h * 256) AS INTEGER) ELSE 1280 END AS fit_w,
      CASE WHEN h / w > 256.0 / 1280 THEN 256 ELSE CAST(trunc(h / w * 1280) AS INTEGER) END AS fit_h,
      1920 AS page_w, CASE WHEN w = 1920 THEN h ELSE CAST(round_even(h * (1920 / w), 0) AS INTEGER) END AS page_h FROM s""")
def aspect_fit(spark, sf):
    sizes = B.table(spark, sf, "part").select((F.col("p_size") + 1).alias("h"), F.floor("p_retailprice").cast("int").alias("w")).distinct()
    fit_w, fit_h = DU.canvas_size(F.col("w"), F.col("h"))
    page_w, page_h = DU.page_size(F.col("w"), F.col("h"))
    return sizes.select("w", "h", fit_w.alias("fit_w"), fit_h.alias("fit_h"), page_w.alias("page_w"), page_h.alias("page_h"))


@query("sf24_class_predicates", f"""WITH {B.EVT} SELECT seq_id, pos, rhythm IN ('BOS', 'EOS', 'PAD') AS control, {_PLACED} AS placed,
    contains(rhythm, 'barline') OR contains(rhythm, 'repeat') AS measure_end FROM evt""")
def class_predicates(spark, sf):
    r = F.col("rhythm")
    return B.evt(spark, sf).select(
        "seq_id", "pos", T.is_control(r).alias("control"), T.has_position(r).alias("placed"), T.is_measure_end(r).alias("measure_end")
    )


@query("sf26_probability_decay", "SELECT event_id, greatest(0.1e0, 0.9e0 - (0.9e0 - 0.1e0) * event_id / 5000) AS p FROM events")
def probability_decay(spark, sf):
    p = F.greatest(F.lit(0.1), F.lit(0.9) - F.lit(0.9 - 0.1) * F.col("event_id") / F.lit(5000))
    return B.table(spark, sf, "events").select("event_id", p.alias("p"))


@query("sf27_path_rewrite", r"""WITH p AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) || ['.jpg', '_distorted.jpg', '.jpeg', '.png'][page_id % 4 + 1] AS path FROM pages)
    SELECT page_id, CASE WHEN contains(path, '_distorted.jpg') THEN replace(path, '_distorted.jpg', '.semantic') WHEN contains(path, '.jpg') THEN replace(path, '.jpg', '.semantic')
      WHEN contains(path, '.jpeg') THEN replace(path, '.jpeg', '.semantic') ELSE replace(path, '.png', '.semantic') END AS semantic,
      CASE WHEN contains(path, '.jpg') THEN replace(path, '.jpg', '-pre.jpg') WHEN contains(path, '.jpeg') THEN replace(path, '.jpeg', '-pre.jpg')
      ELSE replace(path, '.png', '-pre.jpg') END AS prepared FROM p""")
def path_rewrite(spark, sf):
    path = F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), B.pick([".jpg", "_distorted.jpg", ".jpeg", ".png"], F.col("page_id") % 4))
    rows = B.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return rows.select(
        "page_id",
        DU.replace_suffix(F.col("path"), ".semantic").alias("semantic"),
        DU.replace_suffix(F.col("path"), "-pre.jpg").alias("prepared"),
    )


@query("sf30_rhythm_token", """WITH r AS (SELECT DISTINCT l_linenumber AS dots, CAST(l_quantity AS INTEGER) AS number, round(l_tax * 100) = 3 AS grace FROM lineitem)
    SELECT dots, number, grace, 'note_' || CAST(CAST(round_even(number * 1.5, 0) AS INTEGER) AS VARCHAR) || CASE WHEN grace THEN 'G' ELSE '' END || repeat('.', least(dots, 2)) AS token,
      'rest_' || least(number, 10) || 'm' AS multirest FROM r""")
def rhythm_token(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("dots"),
        F.col("l_quantity").cast("int").alias("number"),
        (F.round(F.col("l_tax") * 100) == 3).alias("grace"),
    ).distinct()
    token = DU.rhythm_token("note", F.col("number"), F.lit(1.5), F.col("dots"), F.col("grace"))
    return rows.select("dots", "number", "grace", token.alias("token"), DU.multirest_token(F.col("number")).alias("multirest"))


_VIS = ["hideEmptyStaves", "hideWhenEmpty", "cutaway"]


@query("sf32_bulk_text_rewrite", r"""WITH p AS (SELECT page_id, replace(replace(html, '<p>', '<Note> <pos x="1"/> <p>'), '<li>', '<cutaway>1</cutaway>') AS x FROM pages)
    SELECT page_id, regexp_replace(replace(replace(replace(x, '<hideEmptyStaves>1<', '<hideEmptyStaves>0<'), '<hideWhenEmpty>1<', '<hideWhenEmpty>0<'),
      '<cutaway>1<', '<cutaway>0<'), '(<Note>\s*)<pos\b[^>]*(?:/>|>\s*</pos>)\s*', '\1', 'g') AS text FROM p""")
def bulk_text_rewrite(spark, sf):
    x = F.replace(F.replace("html", F.lit("<p>"), F.lit('<Note> <pos x="1"/> <p>')), F.lit("<li>"), F.lit("<cutaway>1</cutaway>"))
    pages = B.table(spark, sf, "pages").select("page_id", x.alias("x"))
    return pages.select("page_id", DU.reset_note_positions(DU.make_staves_visible(F.col("x"))).alias("text"))


@query("sl03_top_by_score", f"""WITH {B.TOK}, t AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM
    (SELECT *, length(word) AS n, n_chars / length(word) AS score FROM tok JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE length(word) > 0) x)
    SELECT doc_id, word FROM t WHERE r = 1""")
def top_by_score(spark, sf):
    """Best scored text per page: box height over text length, the first on ties."""
    def rated(word: Column, pos: Column) -> Column:
        return F.when(F.length(word) > 0, F.struct((F.col("n_chars") / F.length(word)).alias("score"), (-pos).alias("at"), word.alias("word")))

    # best inside each row first: one word of a text is shuffled, not all
    best = B.table(spark, sf, "documents").select("doc_id", F.array_max(F.transform(F.split("text", " "), rated)).alias("best"))
    return best.where("best is not null").groupBy("doc_id").agg(F.max("best").getField("word").alias("word"))
