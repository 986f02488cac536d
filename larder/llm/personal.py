"""Personal data in texts: fixed patterns, and identifiers that their contexts give away, in DataFrame functions only.

What the fixed patterns find are seeds. The words right before and right after a seed are lexical patterns of its kind.
Patterns and instances (strings of a looser form) make a graph over all documents that is scored in rounds: a pattern is
as good as the share of its word's places that known instances fill, counting an instance by its own score, and an
instance is as good as its best pattern. Places of the looser form beside a pattern that is good enough, and where
enough different instances were seen, are identifiers too. Scores are whole parts of SCALE, so no order of sums matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Of the local part of an address.
_LOCAL = "[A-Za-z0-9._%+-]"
#: The fixed patterns. They match what plain greedy ones match, but never step back or start inside a run that failed,
#: so long runs cost no more than their length.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: The looser forms in which unseen identifiers are sought: something with an @, and a run of digits with marks between.
LOOSE = {"at": r"""(?:\G|(?<![^\s@<>()\[\]{},;:"']))[^\s@<>()\[\]{},;:"']++@[^\s@<>()\[\]{},;:"'.]++(?:\.[^\s@<>()\[\]{},;:"'.]++)*+""", "digits": r"[0-9](?:[ ().:/-]{0,2}+[0-9])++"}
#: Parts of a whole score; the score at which a pattern is trusted, and the different instances that it takes; rounds of scoring.
SCALE, TRUSTED, SUPPORT, ROUNDS = 1000, 800, 3, 3
#: Code points looked at on either side for the next word, and of the longest word that is a pattern.
SIGHT, WORD = 80, 40


def _places(text: Column, pattern: str) -> Column:
    """An array of (value, gap, before, after) of all matches: the code points since the match before, and the text around."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    around = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(SIGHT)).alias("before"), F.left(g, F.lit(SIGHT)).alias("after")))
    zipped = F.arrays_zip(found.alias("value"), around.alias("own"), F.slice(around, F.lit(2), F.size(found)).alias("next"))
    return F.when(F.size(found) > 0, F.slice(zipped, F.lit(1), F.size(found)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid() -> Column:
    """Whether a match of a fixed pattern is of its kind."""
    digits = _digits(F.col("value"))
    card = F.length(digits).between(12, 19) & F.expr("luhn_check(regexp_replace(value, '[^0-9]', ''))")
    return F.when(F.col("form") == "ip", F.col("value").rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")).when(F.col("form") == "card", card).when(F.col("form") == "phone", F.length(digits).between(9, 15)).otherwise(True)


def _loose_kinds() -> Column:
    """The kinds that a match of a looser form may be."""
    digits = F.length(_digits(F.col("value")))
    may = [(F.col("form") == "at", "email"), ((F.col("form") == "digits") & F.col("value").rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip"), ((F.col("form") == "digits") & digits.between(12, 19), "card"), ((F.col("form") == "digits") & digits.between(7, 15), "phone")]
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in may)))


def spans(docs: DataFrame) -> DataFrame:
    """Per match of a fixed pattern or looser form: row, form, value, start, end (code points, end exclusive), left and right word.

    left and right are the lower-case words beside the match if only white space stands between, else null. docs has row
    and text.
    """
    forms = BASE | LOOSE
    rows = docs.select("row", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.when(F.contains("text", F.lit("@")) if "@" in p else F.col("text").rlike("[0-9]"), _places(F.col("text"), p)).alias("places")) for k, p in forms.items()))).alias("f"))
    rows = rows.select("row", "f.form", F.posexplode("f.places").alias("at", "p")).select("row", "form", "at", "p.value", "p.own.gap", "p.own.before", "p.next.after")
    own = Window.partitionBy("row", "form").orderBy("at")
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(own).cast("int")
    cues = [F.lower(F.regexp_extract("before", rf"(?:^|\s)(\S{{1,{WORD}}})\s+$", 1)), F.lower(F.regexp_extract("after", rf"^\s+(\S{{1,{WORD}}})(?:\s|$)", 1))]
    return rows.select("row", "form", "value", (end - size).alias("start"), end.alias("end"), *(F.nullif(c, F.lit("")).alias(n) for c, n in zip(cues, ("left", "right"), strict=True)))


def _apart(known: DataFrame, loose: DataFrame) -> DataFrame:
    """The loose spans that overlap no known one of their row, nor an earlier loose one."""
    both = known.select("row", "start", "end", F.lit(True).alias("seed"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    both = both.unionByName(loose.select("row", "start", "end", F.lit(False).alias("seed"), "value", "form", "left", "right"))
    order = Window.partitionBy("row").orderBy("start", "seed", "form")
    before = F.max(F.when(F.col("seed"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("seed").desc(), F.col("form").desc()).rowsBetween(Window.unboundedPreceding, -1)
    next_start = F.min(F.when(F.col("seed"), F.col("start"))).over(after)
    free = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(next_start >= F.col("end"), F.lit(True))
    return both.select("*", free.alias("free")).where("NOT seed AND free").drop("seed", "free")


def score_graph(occurrences: DataFrame, places: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, side, cue, score and support of all patterns.

    occurrences has kind, value, seed and the two words left and right; places has the number of places n of each word.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("cue")) for s in ("left", "right"))))
    edges = occurrences.select("kind", "value", "seed", sides.alias("p")).select("kind", "value", "seed", "p.side", "p.cue").where("cue IS NOT NULL")
    edges = edges.groupBy("kind", "value", "side", "cue").agg(F.bool_or("seed").alias("seed"), F.count("*").alias("times"))
    seeded = edges.where("seed").select("kind", "side", "cue").distinct()
    edges = materialize(edges.join(seeded, ["kind", "side", "cue"]), "edges")
    places = materialize(places.join(seeded.select("cue").distinct(), "cue"), "places")
    instances = edges.groupBy("kind", "value").agg(F.bool_or("seed").alias("known"), F.when(F.bool_or("seed"), SCALE).otherwise(0).alias("s"))
    for k in range(rounds):
        held = edges.join(instances, ["kind", "value"])
        patterns = held.groupBy("kind", "side", "cue").agg(F.sum(F.col("times") * F.col("s")).alias("filled"), F.count_if(F.col("s") >= TRUSTED).alias("support"))
        score = F.least(F.lit(SCALE).cast("long"), F.expr("filled div n"))
        patterns = materialize(patterns.join(places, "cue").select("kind", "side", "cue", score.alias("score"), "support"), f"patterns{k}")
        best = edges.join(patterns.where(F.col("support") >= SUPPORT), ["kind", "side", "cue"]).groupBy("kind", "value").agg(F.max("score").alias("best"))
        instances = instances.join(best, ["kind", "value"], "left").select("kind", "value", "known", F.when(F.col("known"), SCALE).otherwise(F.coalesce("best", F.lit(0))).cast("int").alias("s"))
    return patterns


def find_personal(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id and spans, an array of (start, kind number, end, base) in order, of every row of docs (doc_id, text); null if there are none.

    base tells spans of the fixed patterns from those that contexts gave away; the latter overlap no base span. Null and
    empty texts have none, repeated rows are searched each, an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    raw = spans(rows)
    found = materialize(raw.where(F.col("form").isin(*LOOSE) | _valid()), "spans")
    seeds = found.where(F.col("form").isin(*KINDS)).withColumn("kind", F.col("form"))
    unseen = _apart(seeds, found.where(F.col("form").isin(*LOOSE))).withColumn("kind", F.explode(_loose_kinds()))
    unseen = materialize(unseen, "unseen")
    occurrences = seeds.select("kind", "value", F.lit(True).alias("seed"), "left", "right").unionByName(unseen.select("kind", "value", F.lit(False).alias("seed"), "left", "right"))
    words = rows.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("cue")).where(F.length("cue").between(1, WORD))
    patterns = score_graph(occurrences, words.groupBy("cue").agg(F.count("*").alias("n")), rounds)
    good = patterns.where((F.col("score") >= TRUSTED) & (F.col("support") >= SUPPORT)).select("kind", "side", "cue", "score")
    hit = unseen.select("row", "kind", "start", "end", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("cue")) for s in ("left", "right")))).alias("p"))
    hit = hit.select("row", "kind", "start", "end", "p.side", "p.cue").join(good, ["kind", "side", "cue"])
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    hit = hit.groupBy("row", "start", "end").agg(F.min(F.struct(-F.col("score"), number.alias("kind"))).alias("b"))
    every = seeds.select("row", "start", number.alias("kind"), "end", F.lit(True).alias("base")).unionByName(hit.select("row", "start", F.col("b.kind").alias("kind"), "end", F.lit(False).alias("base")))
    whole = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    return rows.select("row", "doc_id").join(whole, "row", "left")


def personal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card and n_phone of the fixed patterns, base_sha256 and spans; see find_personal."""
    found = find_personal(docs).withColumn("spans", F.coalesce("spans", F.array()))
    base = F.filter("spans", lambda s: s.base)
    names = F.array(*map(F.lit, KINDS))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat(F.element_at(names, s.kind), F.lit(":"), s.start, F.lit(":"), s.end)), ",")
    counted = lambda i: F.size(F.filter(base, lambda s: s.kind == i)).cast("long")
    counts = [counted(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
