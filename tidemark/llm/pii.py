"""Personal data: base patterns, plus bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seed entities. Every token that holds a digit or an at
sign is an instance, and so is every run of two or more such tokens. An instance is seen in two patterns:
its lexical context (the words before and after it, whatever its shape), and the word before it with its
own shape (digits and runs of letters folded). Patterns and instances form a graph. Starting from the
seeds, patterns are scored by the mean score of their instances and instances by the mean score of their
patterns of either sort, the better one, a few rounds long; contexts carry scores from shape to shape.
Patterns of high confidence that enough different seeds support then discover unseen instances, contexts
also those of unseen shapes.

All steps are DataFrame expressions. The regular expressions are forms of the documented ones that find
the same matches without quadratic backtracking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

KINDS = ["email", "ip", "card", "phone"]
# Equivalents of the documented base patterns, with atomic runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
RUN = INSTANCE + r"(?:[\x20\t]++[^\s0-9@]*+[0-9@]\S*+)++"
_BLOCK = 256


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, r"[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.char_length(F.regexp_replace(match, r"[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _fold(frame: DataFrame, text: str, pattern: str, matches: str, kind: str, make, *, after: bool = False) -> DataFrame:
    """Replaces the column ``matches`` by an array of ``make(start, end, item)``; an item has the gap before the
    match, its text and, if ``after`` is set, the first word after it: "$" at the end, empty if a match follows.

    Positions come from the lengths of the gaps that splitting at the pattern leaves and of the matches.
    Work goes block by block, each stage a column of its own: growing an array one by one, or looking
    into one from a lambda, then stays cheap for any number of matches.
    """
    step = lambda x: F.char_length(x["gap"]) + F.char_length(x["text"])
    item = "array<struct<gap:string,text:string" + (",after:string>>" if after else ">>")
    out = frame.withColumn("_parts", F.when(F.size(matches) > 0, F.split(text, F.lit(pattern), -1)))
    fields = [F.slice("_parts", F.lit(1), F.size(matches)).alias("gap"), F.col(matches).alias("text")]
    if after:
        word = lambda p, i: F.regexp_extract(F.concat(p, F.when(i == F.size(matches), " $").otherwise("")), r"^\s*+(\S*+)", 1)
        out = out.withColumn("_after", F.transform("_parts", word))
        fields.append(F.slice("_after", F.lit(2), F.size(matches)).alias("after"))
    out = out.withColumn("_items", F.coalesce(F.arrays_zip(*fields), F.array().cast(item))).drop("_parts", "_after")
    numbers = F.sequence(F.lit(0), F.floor((F.size("_items") - 1) / _BLOCK).cast("int"))
    chunks = F.transform(numbers, lambda j: F.slice("_items", j * _BLOCK + 1, F.lit(_BLOCK)))
    out = out.withColumn("_chunks", F.when(F.size("_items") > 0, chunks).otherwise(F.array().cast(f"array<{item}>"))).drop("_items")
    out = out.withColumn("_sums", F.transform("_chunks", lambda c: F.aggregate(c, F.lit(0), lambda t, x: t + step(x))))
    starts = F.transform("_sums", lambda _, j: F.aggregate(F.slice("_sums", F.lit(1), j), F.lit(0), lambda t, x: t + x))

    def block(c: Column, start: Column) -> Column:
        def grown(t: Column, x: Column) -> Column:
            begin = t["at"] + F.char_length(x["gap"])
            end = begin + F.char_length(x["text"])
            return F.struct(end.alias("at"), F.concat(t["out"], F.array(make(begin, end, x))).alias("out"))

        return F.aggregate(c, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), grown, lambda t: t["out"])

    return out.withColumn(matches, F.flatten(F.zip_with("_chunks", starts, block))).drop("_chunks", "_sums")


_SPAN = "array<struct<kind:int,start:int,end:int>>"
_TOKEN = "array<struct<start:int,end:int,token:string,left:string,context:string>>"
_MARKED = "array<struct<start:int,end:int,token:string,left:string,context:string,kind:int>>"


def _shape(token: Column) -> Column:
    """Runs of letters folded to one, every digit to 9: the number of digits matters."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), r"[0-9]", "9"), r"\p{L}+", "a")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (hash of the text), base (spans of all kinds), tokens (instances with their left word and context)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    needs = {"email": "@", "phone": "+"}
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    out = out.select("*", F.regexp_extract_all("text", F.lit(INSTANCE), F.lit(0)).alias("m_token"))
    out = out.withColumn("m_run", F.when(F.size("m_token") > 1, F.regexp_extract_all("text", F.lit(RUN), F.lit(0))))
    for kind in KINDS:  # a base match holds a digit or an at sign, so texts without instances have none
        asked = F.size("m_token") > 0
        if kind in needs:
            asked &= F.contains("text", F.lit(needs[kind]))
        out = out.withColumn(f"m_{kind}", F.when(asked, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))))
    for i, kind in enumerate(KINDS):

        def make(start: Column, end: Column, x: Column, i: int = i, kind: str = kind) -> Column:
            return F.struct(F.when(_valid(kind, x["text"]), F.lit(i)).otherwise(-1).alias("kind"), start.alias("start"), end.alias("end"))

        out = _fold(out, "text", PATTERNS[kind], f"m_{kind}", _SPAN, make)

    def instance(start: Column, end: Column, x: Column) -> Column:
        left = F.reverse(F.regexp_extract(F.reverse(x["gap"]), r"^\s*+(\S*+)", 1))  # the last word, however long the gap
        before = F.when((left == "") & (start == F.char_length(x["gap"])), "^").otherwise(left)
        # Beside another instance there is no word; the run of both has a context.
        context = F.when((before != "") & (x["after"] != "") & ((before != "^") | (x["after"] != "$")), F.concat_ws(" ", before, x["after"]))
        return F.struct(start.alias("start"), end.alias("end"), x["text"].alias("token"), left.alias("left"), context.alias("context"))

    for pattern, name in ((INSTANCE, "m_token"), (RUN, "m_run")):
        out = _fold(out, "text", pattern, name, _TOKEN, instance, after=True)
    spans = F.concat(*(F.filter(f"m_{kind}", lambda s: s["kind"] >= 0) for kind in KINDS))
    return _marked(out.select("doc_id", F.xxhash64("text").alias("key"), spans.alias("base"), F.array_sort(F.concat("m_token", "m_run")).alias("tokens")))


def _marked(found: DataFrame) -> DataFrame:
    """Gives each token the kind of the first base span that it overlaps, or null. Spans are sought block by block."""
    numbers = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / _BLOCK).cast("int"))
    chunks = F.transform(numbers, lambda j: F.slice("tokens", j * _BLOCK + 1, F.lit(_BLOCK)))
    out = found.withColumn("_chunks", F.when(F.size("tokens") > 0, chunks).otherwise(F.array().cast(f"array<{_TOKEN}>")))
    touches = lambda s, start, end: (s["start"] < end) & (s["end"] > start)
    near = F.transform("_chunks", lambda c: F.filter("base", lambda s: touches(s, c[0]["start"], F.array_max(F.transform(c, lambda t: t["end"])))))
    out = out.withColumn("_near", near)

    def kind(t: Column, spans: Column) -> Column:
        return F.try_element_at(F.filter(spans, lambda s: touches(s, t["start"], t["end"])), F.lit(1))["kind"]

    def mark(c: Column, spans: Column) -> Column:
        return F.transform(c, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), t["left"].alias("left"), t["context"].alias("context"), kind(t, spans).alias("kind")))

    tokens = F.flatten(F.zip_with("_chunks", "_near", mark))
    return out.select("doc_id", "key", "base", F.when(F.size("tokens") > 0, tokens).otherwise(F.array().cast(_MARKED)).alias("tokens"))


def discover(found: DataFrame, *, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """rid and more (spans): instances outside the base spans that a confident pattern names."""
    digits = lambda c: F.regexp_replace(F.lower(c), r"[0-9]", "9")
    shaped = F.concat_ws(" ", F.lit("s"), digits(F.col("t.left")), _shape(F.col("t.token")))
    lexical = F.when(F.col("t.context").isNotNull(), F.concat_ws(" ", F.lit("c"), digits(F.col("t.context"))))
    seen = materialize(
        found.where(F.size("tokens") > 0)
        .select("rid", F.explode("tokens").alias("t"))
        .select(
            "rid",
            F.col("t.start").alias("start"),
            F.col("t.end").alias("end"),
            F.col("t.kind").alias("kind"),
            F.lower("t.token").alias("instance"),
            F.explode(F.array_compact(F.array(shaped, lexical))).alias("pattern"),
        ),
        "instances",
    )
    rows = seen.count()
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges", rows=rows)
    seeds = F.col("kind").isNotNull().cast("double")
    # Each instance's score: 1 for seeds; else the mean score of its patterns of one sort, the greater.
    sorts = F.greatest(*(F.avg(F.when(F.startswith("pattern", F.lit(x)), F.col("mean"))) for x in ("s ", "c ")))
    # Scores are tables of their own, one row a node: joins with the edges can then split hot nodes.
    scored = edges.select("pattern", "instance", "kind", seeds.alias("score"))
    for i in range(rounds):
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("mean"), F.count("kind").alias("seeds"), F.mode("kind", True).alias("of")
        )
        if i == rounds - 1:
            break
        means = materialize(patterns.select("pattern", "mean"), "patterns", rows=rows)
        instances = edges.join(means, "pattern").groupBy("instance").agg(F.when(F.max("kind").isNotNull(), 1.0).otherwise(sorts).alias("score"))
        scored = edges.join(materialize(instances, "scores", rows=rows), "instance")
    trusted = patterns.where((F.col("mean") >= confidence) & (F.col("seeds") >= support)).select("pattern", "of", "seeds")
    trusted = materialize(trusted, "trusted", rows=rows)
    return (
        seen.where("kind is null")
        .join(trusted, "pattern")
        .groupBy("rid", "start", "end")
        .agg(F.max(F.struct("seeds", "of"))["of"].alias("of"))  # if patterns disagree, the one with more seeds names the kind
        .groupBy("rid")
        .agg(F.collect_set(F.struct(F.col("of").alias("kind"), "start", "end")).alias("more"))
    )


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, key, base and spans (arrays of (kind, start, end), by kind, then start).

    Positions are code points, ends exclusive; kind counts in KINDS. A null or empty text has no spans.
    Each row is treated apart, so repeated and null doc_ids keep their rows. Extra columns are ignored.
    An empty table gives an empty result.
    """
    found = materialize(base_spans(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "base_spans")
    more = discover(found, **options)
    joined = found.join(more, "rid", "left")
    return joined.select("doc_id", "key", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def count_of(spans: Column, kind: int) -> Column:
    """How many spans are of a kind. The test takes one parameter only: of two, the second would be the position."""
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with every span replaced by its kind in brackets; other columns stay as they are."""
    found = spans(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0)
    found = found.groupBy("doc_id", "key").agg(F.first("spans").alias("spans")).select(F.col("doc_id").alias("_pii_id"), F.col("key").alias("_pii_key"), F.col("spans").alias("_pii_spans"))
    text = F.col(text_col)
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("_pii_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_pii_key")), "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform("_pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # Block by block, each with its own stretch of the text, so that finding positions stays cheap.
    out = joined.withColumn("_pii_spans", by_start)
    numbers = F.sequence(F.lit(0), F.floor((F.size("_pii_spans") - 1) / _BLOCK).cast("int"))
    out = out.withColumn("_pii_chunks", F.when(F.size("_pii_spans") > 0, F.transform(numbers, lambda j: F.slice("_pii_spans", j * _BLOCK + 1, F.lit(_BLOCK)))))
    out = out.withColumn("_pii_ends", F.transform("_pii_chunks", lambda c: F.array_max(F.transform(c, lambda s: s["end"]))))
    begins = F.transform("_pii_ends", lambda _, j: F.aggregate(F.slice("_pii_ends", F.lit(1), j), F.lit(0), lambda t, x: F.greatest(t, x)))
    out = out.withColumn("_pii_begins", begins)
    pieces = F.zip_with("_pii_begins", "_pii_ends", lambda b, e: F.struct(b.alias("begin"), F.substring(text, b + 1, F.greatest(e - b, F.lit(0))).alias("part")))

    def block(c: Column, piece: Column) -> Column:
        def step(t: Column, s: Column) -> Column:
            gap = F.substring(piece["part"], t["at"] - piece["begin"] + 1, s["start"] - t["at"])
            found = F.when(s["start"] >= t["at"], F.concat(gap, F.element_at(names, s["kind"] + 1))).otherwise("")
            return F.struct(F.greatest(t["at"], s["end"]).alias("at"), F.concat(t["out"], F.array(found)).alias("out"))

        zero = F.struct(piece["begin"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(c, zero, step, lambda t: F.array_join(t["out"], ""))

    rest = F.substring(text, F.array_max("_pii_ends") + 1, F.char_length(text))
    clean = F.concat(F.array_join(F.zip_with("_pii_chunks", pieces, block), ""), rest)
    return out.withColumn(text_col, F.when(F.col("_pii_chunks").isNotNull(), clean).otherwise(text)).select(*docs.columns)
