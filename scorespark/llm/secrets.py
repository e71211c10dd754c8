"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression implies a Boolean query over trigrams: any of some alternatives, each of which needs all
its trigrams. Postings (trigram, text key) are kept for the trigrams that some rule needs, intersected per rule, and only
candidate texts are verified with the expression; a rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import let
from .common import free_name


@dataclass(frozen=True)
class Rule:
    """``words``: literals, one of which every match contains (lower case if ``any_case``); none: scan fully.

    ``least`` characters are needed in the match, or in what ``pattern`` group ``group`` takes. ``enough``: an expression that
    finds just those matches of ``pattern`` (never others, nor parts of the short ones); none: all are found and measured.
    """

    kind: str
    pattern: str
    words: tuple[str, ...]
    group: int
    least: int
    any_case: bool = False
    enough: str = ""

    def trigrams(self) -> list[list[str]]:
        """One list of mandatory trigrams per alternative, each of them once."""
        return [list(dict.fromkeys(w[i : i + 3] for i in range(len(w) - 2))) for w in self.words]


# A private key from its BEGIN line to its END line. Where the END line is missing: the header lines of an encrypted key and
# the base64 runs that follow, the last of them shorter. Possessive throughout, so that long keys need no deep stack.
_GAP = r"(?:\s|\\[nr])"
_KEY_LINES = (
    rf"(?:{_GAP}*+(?:Proc-Type:\x20?\S++|DEK-Info:\x20?\S++|[A-Za-z0-9+/]{{20,}}+={{0,2}}+))++"
    rf"(?:(?:\r\n|{_GAP})(?=[A-Za-z0-9+/]*+=|[A-Za-z]*+[0-9+/]|[A-Za-z]*?[a-z][A-Z])[A-Za-z0-9+/]++={{0,2}}+)?+"
)
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----|{_KEY_LINES})?+"
)

# Fixed values of the base rules, then further token shapes.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 12, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 18),
    # Single letters of prose match here, so the least length is part of the scan; a listed class is tested faster than ranges.
    Rule("hex", r"[0-9a-f]+", (), 0, 16, enough=r"[0123456789abcdef]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 0, 24),
    Rule("pem", PRIVATE_KEY, ("-----BEGIN ", "PRIVATE KEY-----"), 0, 27),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), 0, 16),
)
BASE_KINDS = ("assign", "access", "hex")


def text_key(id_col: str, text_col: str) -> Column:
    """Key of a text in the index. Rows that share it share postings, which can only add candidates."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (folded boolean, trigram string, key long) for the trigrams that the rules need.

    The postings of a text for an alternative end before the first trigram that it lacks: it cannot fulfil the rest.
    """
    # Folded once here: inside the conditions below, it would be folded again for each of them.
    texts = docs.select(text_key(id_col, text_col).alias("key"), F.col(text_col).alias("plain"), F.lower(text_col).alias("lower"))
    none = F.array().cast("array<struct<folded:boolean,trigram:string>>")

    def held(folded: bool, alternatives: list[list[str]]) -> Column:
        """Postings of the first trigrams that the text has, each with those of what follows it; equal beginnings are tested once."""
        behind: dict[str, list[list[str]]] = {}
        for first, *rest in filter(None, alternatives):
            behind.setdefault(first, []).append(rest)
        own = {t: F.array(F.struct(F.lit(folded).alias("folded"), F.lit(t).alias("trigram"))) for t in behind}
        text = F.col("lower" if folded else "plain")
        return F.concat(none, *[
            F.when(F.contains(text, F.lit(t)), F.concat(own[t], held(folded, rest))).otherwise(none) for t, rest in behind.items()
        ])

    # Not as a column first: Spark would derive a filter from it that does all tests twice.
    found = F.array_distinct(F.concat(none, *[held(r.any_case, r.trigrams()) for r in rules]))
    return texts.select("key", F.explode(found).alias("t")).select("t.folded", "t.trigram", "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules array<string>): per text the indexed rules whose trigram query it fulfils."""
    wanted = {t: n for n, t in enumerate(sorted({(r.any_case, t) for r in rules for a in r.trigrams() for t in a}))}
    if len(wanted) > 126:
        raise ValueError("split the rules: at most 126 distinct trigrams per index")
    number = F.create_map(*[x for (folded, t), n in wanted.items() for x in (F.lit(f"{int(folded)}{t}"), F.lit(n))])
    numbered = index.select("key", number[F.concat(F.col("folded").cast("int").cast("string"), "trigram")].alias("n"))
    masks = numbered.groupBy("key").agg(
        F.expr("bit_or(CASE WHEN n < 63 THEN shiftleft(1L, n) ELSE 0L END)").alias("low"),
        F.expr("bit_or(CASE WHEN n >= 63 THEN shiftleft(1L, n - 63) ELSE 0L END)").alias("high"),
    )

    def has(terms: list[tuple[bool, str]]) -> Column:
        low = sum(1 << wanted[t] for t in terms if wanted[t] < 63)
        high = sum(1 << wanted[t] - 63 for t in terms if wanted[t] >= 63)
        return (F.col("low").bitwiseAND(low) == low) & (F.col("high").bitwiseAND(high) == high)

    def query(rule: Rule) -> Column:
        parts = [has([(rule.any_case, t) for t in alternative]) for alternative in rule.trigrams()]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    named = F.array_compact(F.array(*[F.when(query(r), F.lit(r.kind)) for r in rules if r.words]))
    return masks.select("key", named.alias("rules")).where(F.size("rules") > 0)


def _spans_of(rule: Rule, order: int, text: Column) -> Column:
    """Leftmost non-overlapping matches as structs (start, order, kind, end), without those too short.

    The text between matches, from a split by the same expression, gives the offsets.
    """
    searched = rule.enough or rule.pattern
    matches = F.regexp_extract_all(text, F.lit(searched), F.lit(0))
    between = F.transform(F.split(text, searched, -1), F.length)
    sized = F.transform(matches, lambda m: F.struct(
        F.length(m).alias("size"),
        (F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)).alias("body"),
    ))
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["m"]["size"]
        grown = F.concat(acc["spans"], F.array(span(start, end)))
        return F.struct(end.alias("at"), F.when(x["m"]["body"] >= rule.least, grown).otherwise(acc["spans"]).alias("spans"))

    def over(acc: Column, chunk: Column) -> Column:
        """Spans of a chunk, counted from its own start, moved behind the chunks before it."""
        moved = F.transform(chunk["spans"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["end"]))
        grown = F.when(F.size(chunk["spans"]) > 0, F.concat(acc["out"], F.array(moved))).otherwise(acc["out"])
        return F.struct((acc["at"] + chunk["at"]).alias("at"), grown.alias("out"))

    paired = F.zip_with(F.slice(between, 1, F.size(sized)), sized, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    all_chunks = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind_order:int,kind:string,end:int>>>").alias("out"))
    spans = let(paired, lambda steps: F.aggregate(
        F.transform(chunks_of(steps), lambda c: F.aggregate(c, start, step)), all_chunks, over, lambda acc: F.flatten(acc["out"])
    ))
    return F.when(F.regexp_like(text, F.lit(searched)), spans).otherwise(none)


#: Elements that are worked on together where each step copies what the steps before it made.
CHUNK = 256


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination (a sum, a maximum) of whole numbers from 0: inside chunks, then over the chunks' last values."""
    ints = F.array().cast("array<int>")

    def inside(chunk: Column) -> Column:
        return F.aggregate(chunk, ints, lambda acc, x: F.concat(acc, F.array(combine(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x))))

    def over(acc: Column, chunk: Column) -> Column:
        moved = F.transform(chunk, lambda x: combine(acc["at"], x))
        return F.struct(F.element_at(moved, -1).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return let(values, lambda v: F.aggregate(F.transform(chunks_of(v), inside), start, over, lambda acc: F.flatten(acc["out"])))


def chunks_of(array: Column) -> Column:
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(array, at, CHUNK))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``_spans``: array of (start, kind_order, kind, end) in characters, by start, then kind as listed.

    Null texts have no spans. Rows may repeat and ids be null: each row is scanned on its own. Columns of any other name
    are passed through. An empty table gives no rows.
    """
    return _scanned(docs, "_spans", rules, id_col, text_col)


def _scanned(docs: DataFrame, name: str, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the spans as column ``name``."""
    found = candidates(postings(docs, rules, id_col, text_col), rules)
    key, hits = free_name(docs, "key_of_text"), free_name(docs, "rules_of_text")
    keyed = docs.withColumn(key, text_key(id_col, text_col))
    marked = keyed.join(found.select(F.col("key").alias(key), F.col("rules").alias(hits)), key, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")
    per_rule = [
        F.when(F.coalesce(F.array_contains(hits, r.kind), F.lit(False)), _spans_of(r, n, text)).otherwise(empty)
        if r.words else _spans_of(r, n, text)
        for n, r in enumerate(rules)
    ]
    return marked.withColumn(name, F.sort_array(F.concat(*per_rule))).drop(key, hits)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, spans that overlap by one mark; columns stay as they are."""
    spans = free_name(docs, "spans")
    found = _scanned(docs, spans, rules, id_col, text_col)
    text = F.col(text_col)

    def pieces(furthest: Column) -> Column:
        """Text kept before each span that begins at or after the end of all before it: where it starts and stops."""
        ends = lambda i: F.coalesce(F.get(furthest, i - 1), F.lit(0))
        cuts = F.transform(spans, lambda s, i: F.when(s["start"] >= ends(i), F.struct(ends(i).alias("at"), s["start"].alias("stop"))))
        return F.array_compact(cuts)

    def kept(own: Column) -> Column:
        """A chunk of pieces, cut out of its own stretch of the text."""
        base = own[0]["at"]
        stretch = F.substring(text, base + 1, F.element_at(own, -1)["stop"] - base)
        return let(stretch, lambda part: F.array_join(F.transform(own, lambda x: F.concat(F.substring(part, x["at"] - base + 1, x["stop"] - x["at"]), F.lit(mark))), ""))

    rest = let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), lambda furthest: F.concat(
        let(pieces(furthest), lambda cuts: F.array_join(F.transform(chunks_of(cuts), kept), "")),
        F.substring(text, F.element_at(furthest, -1) + 1, F.length(text)),
    ))
    clean = F.when(F.size(spans) > 0, rest).otherwise(F.col(text_col))
    return found.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with its length column, if it has one, set to the characters of the text."""
    if length_col not in docs.columns:
        return docs
    kind = docs.schema[length_col].dataType
    return docs.withColumn(length_col, F.length(text_col).cast(kind))
