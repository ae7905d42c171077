"""Personal data by fixed forms and by bootstrapped contextual extraction, in DataFrame operations alone.

Base entities have fixed forms (mail and IP addresses, payment cards, phone numbers). They and keys (long words of letters and digits)
are the seeds: each is an instance as a whole, and the words beside it with its own shape are its patterns (the word before, the two
words before, the word after, both neighbours), as are its own first letters. The other instances are tokens, with and without the
punctuation around them, what stands behind a name and = or : in a token, with the name as the word before, and runs of as many words as a
seed has; tokens that hold a whole base entity are seeds too. Every seed has a digit or an @, and only
numbers have several words, so nothing else can be of a seed's shape. Scores then pass along the graph of patterns and
instances: a pattern is as reliable as its instances are on average, an instance as its patterns are (those of one instance alone say
nothing, nor do those without a seed). What has a base form but fails its test (a card's check digit, say) speaks against its patterns.
Patterns that enough different seeds support and that end with high reliability extract their instances as identifiers
(kind `id`). What they extract becomes a seed unless it failed such a test, and patterns are induced and scored anew,
until nothing is added.

Positions come from the gaps between matches: the text is split by an expression and the lengths of the pieces and
matches are summed. The expressions are possessive and start only where a match can start, so that time is linear. A context word
is looked for in the last characters first, and in the whole text since the match before if they hold no whole word.

Defined cases: a null or empty text has no spans; repeated rows get the same spans but support patterns once; null ids stay;
an empty table gives an empty table; other columns, of whatever names, are ignored or kept as they are; texts without a digit or an
@ skip the expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

KINDS = ("email", "ip", "card", "phone", "id")
#: A match's leftmost start is the start of a run of its first characters or the end of the match before.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Instances of the method: words with a digit or an @ in them, and several words of numbers.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
RUN = r"(?<![\p{L}0-9+().-])[0-9+().-]++(?:\x20++[0-9+().-]++(?!\p{L}))++"
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: A key is a word of 16 or more ASCII letters and digits, three digits and a letter among them.
KEY = r"^(?=(?:[^0-9]*+[0-9]){3})(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}$"
#: What names a value within a token, and the first letters of a token that count as a pattern.
NAMED = r"^[\p{L}_][\p{L}\p{N}_.-]*+[=:]++"
LETTERS = "^[A-Za-z]{4}"
#: Characters beside a match in which its context words are looked for first.
BESIDE = 48
ROUNDS = 3
SUPPORT = 5
RELIABLE = 0.8


def last_words(text: Column, n: int = 2) -> Column:
    """The last n words in lower case, without the punctuation after them; fewer if there are fewer."""

    def words(t: Column) -> Column:
        back = F.regexp_replace(F.reverse(t), r"^[^\p{L}\p{N}]++", "")
        return F.rtrim(F.regexp_replace(back, r"\s++", " "))

    back = words(F.substring(text, -BESIDE, BESIDE))
    whole = (F.length(text) > BESIDE) & (F.size(F.split(back, " ")) <= n)
    return F.lower(F.reverse(F.substring_index(F.when(whole, words(text)).otherwise(back), " ", n)))


def first_word(text: Column) -> Column:
    """The first word in lower case, without the punctuation before it."""

    def words(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}\p{N}]++", ""), r"\s++", " ")

    near = words(F.substring(text, 1, BESIDE))
    whole = (F.length(text) > BESIDE) & ~F.contains(near, F.lit(" "))
    return F.lower(F.substring_index(F.when(whole, words(text)).otherwise(near), " ", 1))


def found(text: Column, kind: int, form: str) -> Column:
    """Matches in order: kind, at (their number), gap (characters since the match before), match, left and right (words beside)."""
    gaps, hits = F.split(text, form), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    rows = F.arrays_zip(
        gaps.alias("gap"), hits.alias("match"), F.slice(gaps, 2, 1 << 30).alias("next"), F.concat(F.array(F.lit("")), hits).alias("before"), F.slice(hits, 2, 1 << 30).alias("after")
    )
    left = lambda x: last_words(F.concat(x["before"], x["gap"]))
    right = lambda x: first_word(F.concat(x["next"], F.coalesce(x["after"], F.lit(""))))
    made = F.transform(
        rows,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"), left(x).alias("left"), right(x).alias("right")
        ),
    )
    return F.filter(made, lambda x: x["match"].isNotNull())


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda t, i: t + worth(i)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.when(kind == 1, match.rlike(IP_PARTS)).when(kind == 2, card).when(kind == 3, F.length(digits).between(9, 15)).otherwise(True)


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, matches for every row of docs, written once so that row numbers stay fixed."""
    text = F.col("text")
    kinds = [found(text, k, FORMS[name]) for k, name in enumerate(KINDS[:4])] + [found(text, 4, TOKEN), found(text, 5, RUN)]
    worth = F.when(text.rlike("[0-9@]"), F.concat(*kinds))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), worth.alias("matches")), "pii-matches")


def placed(found_matches: DataFrame) -> DataFrame:
    """row, kind, start, end, match, left, right of every match that is valid."""
    rows = found_matches.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", end - F.length("match"))
    return rows.filter(valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end", "match", "left", "right")


def fails(match: Column) -> Column:
    """Whether a token that is no base entity has the form of an IP address, of a phone number, or of a card with as many digits."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    whole = lambda name: match.rlike(f"^(?:{FORMS[name]})$")
    return whole("ip") | whole("phone") | (whole("card") & digits.between(13, 19))


def shape(token: Column) -> Column:
    """Runs of letters as a, of digits as 9, 99 or 999 by their length, three or more of both as x, other characters as they are."""
    letters = F.regexp_replace(token, r"\p{L}+", "a")
    digits = F.regexp_replace(F.regexp_replace(letters, "[0-9]{13,}+", "\u0003"), "[0-9]{5,}+", "\u0002")
    digits = F.regexp_replace(digits, "[0-9]++", "\u0001")
    mixed = F.regexp_replace(digits, "(?:a[\u0001-\u0003]){2,}+a?+|a[\u0001-\u0003]a|(?:[\u0001-\u0003]a){2,}+[\u0001-\u0003]?+|[\u0001-\u0003]a[\u0001-\u0003]", "x")
    return F.replace(F.replace(F.replace(mixed, F.lit("\u0001"), F.lit("9")), F.lit("\u0002"), F.lit("99")), F.lit("\u0003"), F.lit("999"))


def reliable_patterns(edges: DataFrame, n: int, rounds: int = ROUNDS, support: int = SUPPORT, least: float = RELIABLE) -> DataFrame:
    """edges: pattern, instance, seed, failed (distinct), about n rows. The patterns to extract by: pattern.

    Instances score 1 if they are seeds, 0 if they failed a test, else 0 at first and then the mean of their patterns;
    patterns score the mean of their instances.
    """
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    older = None
    for turn in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("trust"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        if turn == rounds - 1:
            good = stored(patterns.filter((F.col("seeds") >= support) & (F.col("trust") >= least)).select("pattern"), "pii-patterns", n)
            discard(older)
            return good
        trusted = edges.join(patterns.filter("trust > 0").select("pattern", "trust"), "pattern", "left")
        instances = trusted.groupBy("instance").agg(F.avg(F.coalesce("trust", F.lit(0.0))).alias("mean"), F.max("seed").alias("is_seed"), F.max("failed").alias("is_failed"))
        score = F.when(F.col("is_seed"), 1.0).when(F.col("is_failed"), 0.0).otherwise(F.col("mean")).alias("score")
        scored = stored(edges.join(instances.select("instance", score), "instance"), "pii-scores", n)
        discard(older)
        older = scored
    raise ValueError("rounds must be positive")


def bootstrapped(tokens: DataFrame) -> DataFrame:
    """tokens: row, start, end, base, seed, failed, instance, pattern. row, start, end of what reliable patterns extract beside the base entities.

    What they extract is a seed in the next turn, until a turn adds none; seeds only grow, so that there is a last one.
    """
    each = tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("failed").alias("failed"))
    several = each.groupBy("pattern").agg(F.count("*").alias("_n")).filter("_n > 1").select("pattern")
    n = tokens.count()
    edges = stored(each.join(several, "pattern"), "pii-edges", n)
    new = None
    while True:
        # of the patterns of this turn's seeds: a promoted instance brings its own along
        live = stored(edges.join(edges.filter("seed").select("pattern").distinct(), "pattern", "left_semi"), "pii-live", n)
        good = reliable_patterns(live, n)
        took = stored(tokens.filter("NOT base").join(good, "pattern").select("row", "start", "end", "instance", "failed").distinct(), "pii-extracted", n)
        discard(good, new, live)
        new = took
        added = took.filter("NOT failed").select("instance").distinct().withColumn("_took", F.lit(True))
        grown = stored(edges.join(added, "instance", "left").select("pattern", "instance", "seed", "failed", (F.col("seed") | F.coalesce("_took", F.lit(False))).alias("now")), "pii-edges", n)
        discard(edges)
        edges = grown.select("pattern", "instance", F.col("now").alias("seed"), "failed")
        edges._stored_path = grown._stored_path  # type: ignore[attr-defined]
        if grown.filter("now <> seed").isEmpty():
            break
    discard(edges)
    return new.select("row", "start", "end").distinct()


def cores(tokens: DataFrame) -> DataFrame:
    """Tokens without the punctuation around them, where there is some."""
    before = F.length(F.regexp_extract("match", r"^[^\p{L}0-9+]*+", 0))
    after = F.length(F.regexp_extract(F.reverse("match"), r"^[^\p{L}0-9]*+", 0))
    cut = tokens.withColumn("_before", before).withColumn("_after", after).filter("_before + _after > 0 AND _before + _after < length(match)")
    cut = cut.withColumn("match", F.expr("substring(match, _before + 1, length(match) - _before - _after)"))
    return cut.withColumn("start", F.col("start") + F.col("_before")).withColumn("end", F.col("end") - F.col("_after")).drop("_before", "_after")


def named_values(tokens: DataFrame) -> DataFrame:
    """What stands behind a name and = or : in a token, with the name as the last word before it."""
    name = F.regexp_extract("match", NAMED, 0)
    cut = tokens.withColumn("_name", name).filter("_name <> '' AND length(match) > length(_name)")
    cut = cut.withColumn("match", F.expr("substring(match, length(_name) + 1)")).withColumn("start", F.col("start") + F.length("_name"))
    word = F.lower(F.regexp_replace("_name", "[=:]++$", ""))
    before = F.substring_index("left", " ", -1)
    return cut.withColumn("left", F.when(before == "", word).otherwise(F.concat_ws(" ", before, word))).drop("_name")


def runs(numbers: DataFrame, lengths: list[int]) -> DataFrame:
    """All runs of as many words as lengths has, without the punctuation around them: row, start, end, match, left, right."""
    words = F.split("match", r"(?<=[^\x20])(?=\x20)")  # all but the first with the spaces before them
    each = numbers.select("row", F.col("start").alias("from"), F.col("left").alias("_left"), F.col("right").alias("_right"), F.posexplode(words).alias("i", "word"))
    order = Window.partitionBy("row", "from").orderBy("i")
    upto = F.col("from") + F.sum(F.length("word")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("upto", upto).withColumn("left", F.coalesce(last_words(F.lag("word").over(order)), "_left"))
    out = None
    for n in lengths:
        run = F.array_join(F.collect_list("word").over(order.rowsBetween(0, n - 1)), "")
        right = F.coalesce(first_word(F.lead("word", n).over(order)), "_right")
        one = each.select("row", "left", right.alias("right"), run.alias("match"), F.lead("upto", n - 1).over(order).alias("end")).filter("end IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("start", F.col("end") - F.length("match"))
    return cores(out).unionByName(out.filter(~F.col("match").rlike(r"^\x20"))).select("row", "start", "end", "match", "left", "right")


def beside_base(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """tokens with overlaps (a base span has characters of it) and holds (a base span lies in it), by running extremes within a row."""
    events = tokens.withColumn("_reach", F.lit(None).cast("long")).withColumn("_token", F.lit(True))
    spans_ = base.select("row", "start", "end", F.col("end").alias("_reach"), F.lit(False).alias("_token"))
    events = events.unionByName(spans_, allowMissingColumns=True)
    before = Window.partitionBy("row").orderBy(F.when(F.col("_token"), F.col("end")).otherwise(F.col("start")), ~F.col("_token")).rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("overlaps", F.coalesce(F.max("_reach").over(before) > F.col("start"), F.lit(False)))
    behind = Window.partitionBy("row").orderBy(F.col("start").desc(), "_token").rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("holds", F.coalesce(F.min("_reach").over(behind) <= F.col("end"), F.lit(False)))
    return events.filter("_token").drop("_reach", "_token")


def spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, base and spans (arrays of kind, start, end in order) for every row of docs (doc_id, text)."""
    seen = matches(docs)
    all_found = stored(placed(seen), "pii-found")
    seeds = all_found.filter("kind < 4")
    base = seeds.select("row", "kind", "start", "end")
    columns = ["row", "start", "end", "match", "left", "right"]
    single = all_found.filter("kind = 4").select(columns)
    values = named_values(single)
    others = single.unionByName(cores(single)).unionByName(values).unionByName(cores(values)).withColumn("word", F.lit(True))
    n_words = F.size(F.split("match", r"\x20++")).alias("n")
    lengths = sorted(r["n"] for r in seeds.select(n_words).filter("n > 1").distinct().collect())  # a few small numbers
    if lengths:
        others = others.unionByName(runs(all_found.filter("kind = 5"), lengths).withColumn("word", F.lit(False)))
    others = beside_base(others, base).withColumn("based", F.col("word") & F.col("holds")).filter(F.col("based") | ~F.col("overlaps"))
    others = others.select(*columns, F.col("based").alias("base"), (F.col("based") | F.col("match").rlike(KEY)).alias("seed"), (~F.col("based") & fails(F.col("match"))).alias("failed"))
    tokens = seeds.select(*columns, F.lit(True).alias("base"), F.lit(True).alias("seed"), F.lit(False).alias("failed")).unionByName(others)
    near = F.substring_index("left", " ", -1)
    sides = F.array(
        F.when(near != "", F.concat(F.lit("L:"), near)),
        F.when(F.contains(F.col("left"), F.lit(" ")), F.concat(F.lit("L:"), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("R:"), "right")),
        F.when((near != "") & (F.col("right") != ""), F.concat(F.lit("B:"), near, F.lit(" "), "right")),
        F.when(F.col("match").rlike(LETTERS), F.concat(F.lit("P:"), F.substring("match", 1, 4))),
    )
    pattern = F.xxhash64("side", "shape").alias("pattern")
    tokens = tokens.select("row", "start", "end", "base", "seed", "failed", F.xxhash64("match").alias("instance"), shape(F.col("match")).alias("shape"), F.explode(F.array_compact(sides)).alias("side"))
    tokens = stored(tokens.select("row", "start", "end", "base", "seed", "failed", "instance", pattern), "pii-tokens")
    new = bootstrapped(tokens).withColumn("kind", F.lit(4))
    discard(tokens)
    longer = Window.partitionBy("row").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("_until", F.max("end").over(longer)).filter("_until IS NULL OR end > _until").drop("_until")  # none within another
    every = base.unionByName(new).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.expr("cast(array() AS array<struct<kind:int,start:bigint,end:bigint>>)")
    out = seen.select("row", "doc_id", "text_hash").join(every, "row", "left").withColumn("spans", F.coalesce("spans", none))
    return out.withColumn("base", F.filter("spans", lambda s: s["kind"] < 4))


def listed(array: str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans for every row of docs."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return spans(docs).select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def merged(found_spans: DataFrame) -> DataFrame:
    """doc_id, text_hash, marks (start, end, kind of the first; in order) with spans that overlap made one."""
    each = found_spans.select("row", "doc_id", "text_hash", F.explode("spans").alias("s")).select("row", "doc_id", "text_hash", "s.*")
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_new", F.coalesce(upto <= F.col("start"), F.lit(True)).cast("long"))
    each = each.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "end", "kind"))
    runs_ = each.groupBy("row", "doc_id", "text_hash", "_run").agg(first["start"].alias("start"), F.max("end").alias("end"), first["kind"].alias("kind"))
    marks = F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("marks")
    return runs_.groupBy("row", "doc_id", "text_hash").agg(marks).drop("row")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    marks = merged(spans(docs)).dropDuplicates(["doc_id", "text_hash"]).toDF("_d", "_h", "_s")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    both = rows.join(marks, F.col("_th").eqNullSafe(F.col("_h")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    until = lambda i: F.coalesce(F.get("_s", i - 1)["end"], F.lit(0).cast("long"))
    piece = lambda s, i: F.concat(F.substring(F.col("_row.text"), (until(i) + 1).cast("int"), (s["start"] - until(i)).cast("int")), F.get(name, s["kind"]))
    rest = F.substring(F.col("_row.text"), (F.element_at("_s", -1)["end"] + 1).cast("int"), F.lit(2147483647))
    text = F.when(F.col("_s").isNull(), F.col("_row.text")).otherwise(F.concat(F.array_join(F.transform("_s", piece), ""), rest))
    both = both.withColumn("_text", text)
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return both.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
