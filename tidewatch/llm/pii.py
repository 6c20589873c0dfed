"""Personal data: format rules, and bootstrapped contextual extraction on top, with DataFrame functions only.

1. One narrow pass finds, per text, the matches of each format rule and candidates - whole tokens with a digit or a mark
   inside, whatever they look like otherwise - with the two whole words on either side. No text leaves this pass, only its digest. Copies of a text are looked at once from here on.
2. Offsets are prefix sums over a text's own matches; invalid matches and candidates inside valid ones go.
3. Seeds (valid matches) and candidates form a bipartite graph with lexical patterns: the word or the two words before
   them, the word after, and the words on both sides. Spark scores it in rounds: a pattern is as good as the share of its
   instances that are known to be of a kind; an instance gets the noisy-or of its good patterns; good instances are known
   from the next round on, as seeds are. What is known only grows, and rounds end when nothing is added.
4. Candidates that high-confidence patterns reach are added to the spans of the format rules, which always stay.

Offsets count code points, ends are exclusive. The rules' patterns are written with possessive runs and a look-behind, so
no text takes quadratic time or deep recursion; they match what the plain ones in RULES' comments match.

Defined cases: a null text counts as empty (no spans); a very long text is searched whole, and its words of context are
whole however long; repeated rows get equal spans and count once as evidence; of equal confidences for two kinds of an
instance the kind that sorts last wins; a discovered span is a whole token, without the punctuation around it; spans that overlap all count, and are redacted as one; an empty table gives an
empty result; common patterns are aggregated before they are shuffled; only the named columns are read, so others never
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

KINDS = ("email", "ip", "card", "phone")
#: Fixed forms, as (?:not inside a run | right after a match) and then:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card  [0-9]([\x20-]?[0-9])+
#: phone \+[0-9][\x20().0-9-]+[0-9]
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the rule to be tried.
MARKED = r"[0-9@_/+=~]|[\p{L}][.:][\p{L}]"
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "candidate": MARKED}
#: Candidates: tokens between white space that hold a digit, one of @ _ / + = ~, or a full stop or colon between letters.
#: Words of letters alone are none, as every word of every text would be one.
CANDIDATE = rf"(?<!\S)(?=\S*?(?:{MARKED}))\S++"
#: Punctuation around a token that is no part of it.
BEFORE, AFTER = r"^[\[({<\"'*#|]+", r"[\])}>\"'*#|.,;:!?]+$"
#: The two nearest words of context at the start of a text.
CONTEXT = r"\A\s*+(\S++(?:\s++\S++)?)"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    place = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(x == "", 0).otherwise(x.cast("int") * (i % 2 + 1)))
    return F.aggregate(place, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match holds; no other part of it is tried."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, i, gap, value, left, right>> of a pattern's matches in order. The text between two matches
    gives their distance (gap) and, from its ends, the whole words around them."""
    words = lambda x: F.regexp_extract(x, CONTEXT, 1)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), words(x).alias("head"), F.reverse(words(F.reverse(x))).alias("tail")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("a"), found.alias("v"), F.slice(gaps, 2, F.size(found)).alias("b")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["a"]["n"].alias("gap"), x["v"].alias("value"), x["a"]["tail"].alias("left"), x["b"]["head"].alias("right")),
    )
    none = F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,value:string,left:string,right:string>>)")
    return F.when(text.rlike(NEEDS[kind]) & (F.size(found) > 0), zipped).otherwise(none)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key: the text's digest, kind, start, end, value, left, right) of every valid match and of every candidate that
    touches none, once per distinct text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text_key(F.col(text_col)).alias("key"), text.alias("text")).where(F.col("text").rlike(MARKED))
    hits = F.concat(*(_matches(F.col("text"), k, p) for k, p in [*RULES.items(), ("candidate", CANDIDATE)]))
    rows = rows.select("key", hits.alias("hits")).where(F.size("hits") > 0)
    rows = workspace.materialize(rows, "matches").groupBy("key").agg(F.first("hits").alias("hits"))
    rows = rows.select("key", F.inline("hits"))
    # everything below is within one text and one kind of match
    order = Window.partitionBy("key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(order).cast("long")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).where(_valid(F.col("kind"), F.col("value")))
    base = F.col("kind") != "candidate"
    # a candidate without the punctuation around it
    bare = F.regexp_replace(F.regexp_replace("value", BEFORE, ""), AFTER, "")
    rows = rows.withColumn("start", F.when(base, F.col("start")).otherwise(F.col("start") + F.length("value") - F.length(F.regexp_replace("value", BEFORE, ""))))
    rows = rows.withColumn("value", F.when(base, F.col("value")).otherwise(bare)).where(base | F.col("value").rlike(r"[\p{L}0-9]"))
    rows = rows.withColumn("end", F.col("start") + F.length("value"))
    before = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    rows = rows.where(base | free)
    return workspace.materialize(rows.select("key", "kind", "start", "end", "value", "left", "right"), "occurrences")


def _words(side: str) -> tuple[Column, Column]:
    """The nearest word, and the two nearest, of a context; the case and digits of words don't count."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(side, r"\s+", " "))), "[0-9]", "0")
    parts = F.split(plain, " ")
    if side == "left":
        return F.element_at(parts, -1), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " ")
    return F.element_at(parts, 1), F.array_join(F.slice(parts, 1, 2), " ")


def graph(found: DataFrame) -> DataFrame:
    """Edges (pattern, instance, kind: the seed's or null) between lexical patterns and instances, each once. Patterns are
    L1|word and L2|word word before, R1|word after, and B|before|after."""
    left, left2 = _words("left")
    right, _ = _words("right")
    patterns = F.array(
        F.when(left != "", F.concat(F.lit("L1|"), left)),
        F.when(left2 != left, F.concat(F.lit("L2|"), left2)),
        F.when(right != "", F.concat(F.lit("R1|"), right)),
        F.when((left != "") | (right != ""), F.concat(F.lit("B|"), left, F.lit("|"), right)),
    )
    kind = F.when(F.col("kind") != "candidate", F.col("kind"))
    edges = found.select(F.explode(patterns).alias("pattern"), F.lower("value").alias("instance"), kind.alias("kind")).where("pattern is not null")
    return workspace.materialize(edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "edges")


def bootstrap(edges: DataFrame, min_known: int = 3, good_pattern: float = 0.6, good_instance: float = 0.7) -> DataFrame:
    """(instance, kind, confidence) of the candidates that high-confidence patterns discover. A pattern needs min_known known
    instances of a kind, and a share of at least good_pattern of all it has (one more counted against it)."""
    # only patterns with enough instances, some of them open, can discover anything; more may come into reach later
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"), F.count_if(F.col("kind").isNull()).alias("open"))
    totals = workspace.materialize(totals.where((F.col("total") > min_known) & (F.col("open") > 0)).select("pattern", "total"), "patterns")
    live = workspace.materialize(edges.join(totals, "pattern"), "live-edges")
    seeds = live.where("kind is not null").select("pattern", "total", F.col("kind").alias("k"))
    open_ = live.where("kind is null").select("pattern", "total", "instance")
    known, count = None, 0
    while True:
        sure = seeds if known is None else seeds.unionByName(open_.join(known.select("instance", "k"), "instance").select("pattern", "total", "k"))
        scored = sure.groupBy("pattern", "total", "k").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_known)
        scored = scored.withColumn("p", F.col("hits") / (F.col("total") + 1)).where(F.col("p") >= good_pattern)
        reached = open_.select("pattern", "instance").join(scored.select("pattern", "k", "p"), "pattern")
        # in whole millionths, so that sums don't depend on their order
        doubt = F.sum(F.round(F.log1p(-F.least("p", F.lit(0.999))) * 1_000_000).cast("long")) / 1_000_000
        reached = reached.groupBy("instance", "k").agg((1 - F.exp(doubt)).alias("confidence")).where(F.col("confidence") >= good_instance)
        best = F.max_by(F.struct("k", "confidence"), F.struct("confidence", "k"))
        now = workspace.materialize(reached.groupBy("instance").agg(best.alias("b")).select("instance", "b.*"), "known")
        if known is not None:  # what was known stays, under the kind it had
            old = known.select("instance", F.col("k").alias("k0"), F.col("confidence").alias("c0"))
            now = now.join(old, "instance", "full").select("instance", F.coalesce("k0", "k").alias("k"), F.greatest("confidence", "c0").alias("confidence"))
            now = workspace.materialize(now, "known")
        known, last, count = now, count, now.count()
        if count == last:
            return known.select("instance", F.col("k").alias("kind"), "confidence")


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, base, all): per distinct text with any, the spans of the format rules and those with the discovered ones,
    as sorted arrays of struct<rank of the kind, start, end>."""
    found = occurrences(docs, text_col)
    new = bootstrap(graph(found))
    extra = found.where("kind = 'candidate'").withColumn("instance", F.lower("value")).drop("kind").join(new, "instance")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    both = found.where("kind != 'candidate'").select("key", rank.alias("kind"), "start", "end", F.lit(True).alias("is_base"))
    both = both.unionByName(extra.select("key", rank.alias("kind"), "start", "end", F.lit(False).alias("is_base")))
    span = F.struct("kind", "start", "end")
    grouped = both.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("all"))
    return workspace.materialize(grouped, "spans")


def as_text(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.coalesce(F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are replaced as one, to the
    greatest end, under the kind of the longest of them."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.lit(0).cast("long")
    # out ends before the open union, which reaches to at; size and kind are those of its longest span
    begin = F.struct(F.lit("").alias("out"), zero.alias("at"), zero.alias("size"), F.lit(0).alias("kind"))
    name = lambda kind: F.element_at(F.array(F.lit(""), *(F.lit(f"<{k.upper()}>") for k in KINDS)), kind + 1)

    def step(done: Column, x: Column) -> Column:
        size = x["end"] - x["start"]
        gap = text.substr((done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        taken = F.struct(F.concat(done["out"], name(done["kind"]), gap).alias("out"), x["end"].alias("at"), size.alias("size"), x["kind"].alias("kind"))
        kind = F.when(size > done["size"], x["kind"]).otherwise(done["kind"])
        wider = F.struct(done["out"].alias("out"), F.greatest(done["at"], x["end"]).alias("at"), F.greatest(done["size"], size).alias("size"), kind.alias("kind"))
        return F.when(x["start"] < done["at"], wider).otherwise(taken)

    whole = F.aggregate(ordered, begin, step, lambda done: F.concat(done["out"], name(done["kind"]), text.substr((done["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; all columns and rows stay. Texts without a digit or a mark hold none, and
    go past the join."""
    key, marks = workspace.fresh(docs, "pii_key"), workspace.fresh(docs, "pii_spans")
    found = spans(docs, text_col).select(F.col("key").alias(key), F.col("all").alias(marks))
    some = F.coalesce(F.col(text_col).rlike(MARKED), F.lit(False))
    joined = docs.where(some).withColumn(key, text_key(F.col(text_col))).join(found.hint("merge"), key, "left")
    changed = joined.withColumn(text_col, redacted(F.col(text_col), F.col(marks))).select(*docs.columns)
    return changed.unionByName(docs.where(~some))
