"""Operator 9, PII: bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four fixed patterns (email, ip, card, phone). Around every seed and every
other identifier-like token, or run of digit groups with spaces, the words to the left and right make lexical patterns: the word
before, the two words before, the word after, and both sides. Spark then scores the bipartite
graph of patterns and instances in rounds: a pattern's precision for a kind is the share of its
distinct instances known as that kind among those of any known kind or of another shape; precise
patterns with enough support pass their weight to the unknown instances of a fitting shape, and
instances of high confidence join the known ones for the next round, until a round adds none. The unseen identifiers found
so are added to the spans; the seeds always stay.

Edge cases: a null text counts as empty and has no spans; a null doc_id keeps its row; rows of
equal id and text get equal results; ties (equal confidence) go to the kind listed first; a
found span that overlaps a seed is no span; an empty table gives an empty table; only doc_id and
text are read. Patterns are possessive, so very long texts take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values. The possessive forms match what the plain ones match; a run of the class before `@`, or of
#: digits, that fails from its start fails from within too, so a match starts at a run or where the last ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Tokens that may be identifiers: a run without white space that has a digit or an @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Digit groups joined by spaces, dots, hyphens or brackets, of as many digits as the kinds allow.
RUN = r"(?<![A-Za-z0-9])\(?[0-9](?:[ ().-]{0,3}[0-9]){6,18}+(?![A-Za-z0-9])"

BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often and deep in lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(lengths: Column) -> Column:
    """The sum of the earlier entries, for each entry; in two levels, so that many matches stay cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = lambda xs: F.transform(F.sequence(F.lit(0), block(F.size(xs) - 1)), lambda b: total(F.slice(xs, b * BLOCK + 1, BLOCK)))
    each = lambda xs, bs: F.transform(xs, lambda _, i: total(F.slice(bs, F.lit(1), block(i))) + total(F.slice(xs, block(i) * BLOCK + 1, i % BLOCK)))
    return _let(lengths, lambda xs: _let(sums(xs), lambda bs: each(xs, bs)))


def _matches(df: DataFrame, text: str, pattern: str, trigger: Column, out: str) -> DataFrame:
    """`df` with out: array of (start, stop, value, left, right), in code points; the contexts are up to 60 code points."""
    kind = "array<struct<start:int,stop:int,value:string,left:string,right:string>>"
    df = df.withColumn("_m", F.when(trigger, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_b", F.when(F.size("_m") > 0, _before(F.zip_with("_m", F.slice("_p", F.lit(1), F.size("_m")), lambda m, p: F.length(m) + F.length(p)))))
    at = lambda i: F.get("_b", i) + F.length(F.get("_p", i))
    # contexts run on through the neighbouring matches, two to the left and one to the right
    part = lambda c, i, cut: F.when(i >= 0, F.coalesce(cut(F.get(c, i), F.lit(60)), F.lit(""))).otherwise(F.lit(""))
    before = lambda i: F.right(F.concat(*[part(c, i - d, F.right) for d in (2, 1) for c in ("_p", "_m")], part("_p", i, F.right)), F.lit(60))
    after = lambda i: F.left(F.concat(part("_p", i + 1, F.left), part("_m", i + 1, F.left), part("_p", i + 2, F.left)), F.lit(60))
    found = F.transform(
        "_m",
        lambda m, i: F.struct(
            at(i).alias("start"),
            (at(i) + F.length(m)).alias("stop"),
            m.alias("value"),
            before(i).alias("left"),
            after(i).alias("right"),
        ),
    )
    return df.withColumn(out, F.when(F.size("_m") > 0, found).otherwise(F.array().cast(kind))).drop("_m", "_p", "_b")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    doubled = lambda d, i: F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2)
    add = lambda d, i: _let(doubled(d, i), lambda x: x - F.when(x > 9, 9).otherwise(0))
    return _let(F.reverse(_digits(value)), lambda d: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, i: a + add(d, i))) % 10 == 0


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("00"), F.ltrim(p, F.lit("0"))), F.lit(3)) <= "255"), F.lit(False)))


#: What a document is joined by: its id and a hash of its text, so that a hash shared by chance joins nothing.
KEY = ["id", "key"]


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("key")]


def _tagged(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "stop", "value", "left", "right")]))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spot(docs: DataFrame) -> DataFrame:
    """(doc_id, id, key, base, tokens): the seeds of each kind in listed order, and the other identifier-like tokens and spaced runs of digit groups.

    base: array of (kind int, start, stop, value, left, right), tokens: the same without kind.
    """
    has_digit = F.col("t").rlike("[0-9]")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    df = _matches(df, "t", EMAIL, F.contains("t", F.lit("@")), "email")
    df = _matches(df, "t", IP, has_digit, "ip")
    df = _matches(df, "t", CARD, has_digit, "card")
    df = _matches(df, "t", PHONE, F.contains("t", F.lit("+")), "phone")
    df = _matches(df, "t", TOKEN, has_digit | F.contains("t", F.lit("@")), "tokens")
    df = _matches(df, "t", RUN, has_digit, "runs")
    df = df.withColumn("ip", F.filter("ip", lambda s: _small_parts(s["value"])))
    df = df.withColumn("card", F.filter("card", lambda s: _luhn(s["value"])))
    df = df.withColumn("phone", F.filter("phone", lambda s: F.length(_digits(s["value"])).between(9, 15)))
    df = df.withColumn("base", F.concat(*[_tagged(k, n) for n, k in enumerate(KINDS)]))
    # surrounding punctuation belongs to the context, and tokens that touch a seed are no candidates
    head = lambda s: F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^A-Za-z0-9]+", ""))
    trimmed = F.transform(
        "tokens",
        lambda s: F.struct(
            (s["start"] + head(s)).alias("start"),
            (s["start"] + head(s) + F.length(F.regexp_replace(s["value"], r"^[^A-Za-z0-9]+|[^A-Za-z0-9]++$", ""))).alias("stop"),
            F.regexp_replace(s["value"], r"^[^A-Za-z0-9]+|[^A-Za-z0-9]++$", "").alias("value"),
            s["left"].alias("left"),
            s["right"].alias("right"),
        ),
    )
    # runs without a space are tokens
    spaced = F.filter("runs", lambda s: F.contains(s["value"], F.lit(" ")))
    none = F.array().cast("array<struct<start:int,stop:int,value:string,left:string,right:string>>")
    candidates = F.concat(F.filter(trimmed, lambda s: F.length(s["value"]) >= 6), spaced)
    free = F.filter(candidates, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return df.select("doc_id", *_keys(F.col("doc_id"), F.col("t")), "base", F.when(F.size("tokens") > 0, free).otherwise(none).alias("tokens"))


def _shape(value: Column) -> Column:
    """The kind that a token looks like, or -1."""
    digits = F.length(_digits(value))
    return (
        F.when(value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$"), 0)
        .when(value.rlike(r"^[0-9]+([.:][0-9]+){3,7}$"), 1)
        .when(value.rlike(r"^[0-9]+([-. ]+[0-9]+)*$") & digits.between(13, 19), 2)
        .when(value.rlike(r"^[0-9(][0-9(). -]*[0-9]$") & digits.between(7, 12), 3)
        .otherwise(-1)
    )


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: words next to it, lower-cased, digits as #, without punctuation."""
    plain = lambda x: F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "#"), r"[^\p{L}#=:]+", " "), " "), lambda w: w != "")
    before, after = plain(left), plain(right)
    one, two, next_ = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.try_element_at(after, F.lit(1))
    return F.filter(
        F.array(F.concat(F.lit("L:"), one), F.concat(F.lit("LL:"), two, F.lit(" "), one), F.concat(F.lit("R:"), next_), F.concat(F.lit("LR:"), one, F.lit(" _ "), next_)),
        lambda p: p.isNotNull(),
    )


def discover(spotted: DataFrame, rounds: int | None = None, support: int = 5, precision: float = 0.8, confidence: float = 0.9) -> DataFrame:
    """(kind, value) of the identifiers that high-confidence patterns find among the tokens of `spotted`.

    Rounds go on until one adds no instance, or for `rounds`, if given.
    """
    seed = spotted.select(F.explode("base").alias("s")).select("s.*").withColumn("shape", F.col("kind"))
    other = spotted.select(F.explode("tokens").alias("s")).select(F.lit(-1).alias("kind"), "s.*").withColumn("shape", _shape(F.col("value")))
    places = seed.unionByName(other).select("kind", "shape", F.lower("value").alias("value"), F.explode(_contexts(F.col("left"), F.col("right"))).alias("pattern"))
    graph = common.checkpoint(places.groupBy("pattern", "shape", "value").agg(F.max("kind").alias("kind")))
    before, done = -1, 0
    # each round but the last adds instances, so the loop ends
    while done != rounds and (now := graph.where("kind >= 0").count()) != before:
        before, done = now, done + 1
        # an unknown token counts against a pattern only through its shape
        known = graph.groupBy("pattern", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.when(F.col("shape") < 0, -1).otherwise(-2)).alias("k")).agg(F.count("*").alias("n"))
        total = known.groupBy("pattern").agg(F.sum(F.when(F.col("k") >= -1, F.col("n")).otherwise(0)).alias("all"), F.max(F.when(F.col("k") >= 0, F.struct("n", (-F.col("k")).alias("k")))).alias("best"))
        good = total.where("best is not null").select("pattern", (-F.col("best.k")).alias("k"), F.col("best.n").alias("n"), (F.col("best.n") / F.col("all")).alias("p")).where((F.col("n") >= support) & (F.col("p") >= precision))
        weight = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p") * F.log2(F.col("n")) / (F.log2(F.col("n")) + 1), F.lit(1e-6)))))
        found = (
            graph.where("kind < 0 and shape >= 0")
            .join(good, (graph["pattern"] == good["pattern"]) & (F.col("shape") == F.col("k")))
            .groupBy("shape", "value")
            .agg(weight.alias("c"))
            .where(F.col("c") >= confidence)
            .select("shape", "value", F.lit(True).alias("new"))
        )
        graph = common.checkpoint(graph.join(found, ["shape", "value"], "left").select("pattern", "shape", "value", F.when(F.col("new"), F.greatest("kind", "shape")).otherwise(F.col("kind")).alias("kind")))
    return graph.where("kind >= 0").select("kind", "value").distinct()


def find(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, id, key, base, spans): base and all spans as sorted arrays of (kind int, start, stop)."""
    spotted = common.checkpoint(spot(docs))
    unseen = discover(spotted, **limits)
    narrow = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    more = (
        spotted.where(F.size("tokens") > 0)
        .select(*KEY, F.explode("tokens").alias("s"))
        .select(*KEY, "s.start", "s.stop", F.lower("s.value").alias("value"), _shape(F.col("s.value")).alias("kind"))
        .where("kind >= 0")
        .join(unseen, ["kind", "value"])
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more"))
    )
    # of nested ones the outermost counts
    more = more.withColumn("more", F.filter("more", lambda s: ~F.exists("more", lambda o: (o["start"] <= s["start"]) & (s["stop"] <= o["stop"]) & (o["stop"] - o["start"] > s["stop"] - s["start"]))))
    spans = F.array_sort(F.concat(narrow("base"), F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))))
    return spotted.join(more, KEY, "left").select("doc_id", *KEY, narrow("base").alias("base"), spans.alias("spans"))


def written(spans: str) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [_count("base", n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span of `found` replaced by its kind in brackets; overlapping spans become one of the first kind.

    Columns of any names are carried.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of `docs` clashes
    t, doc_id = (F.col(own[docs.columns.index(c)]) for c in (text, "doc_id"))
    spans = found.where(F.size("spans") > 0).groupBy(*KEY).agg(F.first("spans").alias("spans"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda a, s: F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(t.substr(a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).otherwise(F.lit("")))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(F.greatest(a["at"], s["stop"]).alias("at"), piece(a, s).alias("out")),
        lambda a: F.concat(a["out"], t.substr(a["at"] + 1, F.length(t))),
    )
    joined = docs.toDF(*own).select("*", *_keys(doc_id, F.coalesce(t, F.lit("")))).join(spans, KEY, "left")
    shown = F.when(F.col("spans").isNotNull(), done).otherwise(t)
    return joined.select(*[shown.alias(c) if n == text else F.col(c) for c, n in zip(own, docs.columns, strict=True)]).toDF(*docs.columns)
