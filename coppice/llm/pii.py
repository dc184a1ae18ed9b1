"""PII (3): bootstrapped contextual extraction.

Base finders (email, ip, card, phone) and secrets of known shape are the seed
entities.  Every identifier-like token stands in a lexical pattern: the two
words before it and the token's shape.  Patterns and instances form a graph,
scored in turns: a pattern's confidence is the smoothed share of confident
instances, an instance's the confidence of its best pattern.  Instances that are
believed support patterns like seeds do, and rounds go on until none adds a
pattern.  Patterns of high confidence and support add the tokens that no finder
knew (kind `id`); a secret of known shape is one of them in any context.

Texts are read once, in a narrow pass; only identifiers, patterns and spans are
shuffled.  All is done in DataFrame functions.

Defined results: a null or empty text has no spans; a null doc_id stays null;
repeated rows are each found alike; an empty table gives an empty one; columns
other than doc_id and text are ignored.  Rows of one doc_id with different
texts are told apart by a hash of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_key, spread_join, text_of
from .spans import SPAN, let, match_spans, running

# The kinds in order, and their patterns.  Possessive repeats and
# the guards at run starts change no match; they keep long runs linear.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A token of 8 or more with a digit, or one of known shape without; and secrets of known shape.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|(?:AKIA[A-Z]{16}|ghp_[A-Za-z]{36}|xox[abpr]-[A-Za-z-]{10,}+|sk-[A-Za-z_-]{20,}+)(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{8,}+"
SECRET = r"^(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"


@dataclass(frozen=True)
class Bootstrap:
    #: Rounds at least.
    rounds: int = 3
    #: Added to a pattern's count of instances: rare patterns are not trusted.
    smoothing: float = 1.0
    min_confidence: float = 0.6
    min_seeds: int = 3


def _luhn(digits: Column) -> Column:
    """Whether an array of digits, from the last, has a sum of Luhn divisible by 10."""
    doubled = F.transform(digits, lambda d, k: F.when(k % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the array of (start, end, gap, text) of its valid matches."""
    ip_ok = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
    none = F.array().cast(SPAN)

    def card_ok(s):
        digits = _digits(s["text"])
        n = F.char_length(digits)
        return F.when(n.between(12, 19), _luhn(F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))))).otherwise(False)

    return {
        "email": F.when(F.contains(text, F.lit("@")), match_spans(text, EMAIL)).otherwise(none),
        "ip": F.filter(match_spans(text, IP), lambda s: s["text"].rlike(ip_ok)),
        "card": F.filter(match_spans(text, CARD), card_ok),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(match_spans(text, PHONE), lambda s: F.char_length(_digits(s["text"])).between(9, 15))).otherwise(none),
    }


def _shape(token: Column) -> Column:
    """Class of a token: digits, hex, upper-case or mixed, with its length."""
    kind = F.when(token.rlike("^[0-9]+$"), "9").when(token.rlike("^[0-9a-f]+$"), "f").when(token.rlike("^[0-9A-Z]+$"), "A").otherwise("x")
    return F.concat(kind, F.char_length(token).cast("string"))


def _pattern(gap: Column, token: Column) -> Column:
    """The two words before a token, as far as the token before it, lowered, digits as 0, and its shape."""
    # from the end, so that only these words are read
    before = F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*+\S*+(?:\s++\S++)?+", 0))
    return F.concat(F.regexp_replace(F.lower(F.regexp_replace(before, r"\s+", " ")), "[0-9]", "0"), F.lit("\t"), _shape(token))


def _flagged(tokens: Column, base: Column) -> Column:
    """The tokens, each with `known`: whether a base span overlaps it.

    Both are sorted together; a base span that starts before a token overlaps it if
    the furthest end of these does, one that starts after if the next start does.
    """
    far = 2**62
    marks = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("token"), s["end"].alias("end"), F.lit("").alias("text"), F.lit("").alias("pattern")))
    items = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("token"), t["end"].alias("end"), t["text"].alias("text"), t["pattern"].alias("pattern")))

    def judged(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(F.lit(0).cast("bigint")))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["token"] == 0, x["start"]).otherwise(F.lit(far)))
        reach = F.arrays_zip(running(ends, F.greatest).alias("end"), F.reverse(running(starts, F.least, far)).alias("start"))
        flag = F.zip_with(both, reach, lambda x, r: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["pattern"].alias("pattern"), (x["token"] == 1).alias("token"), ((r["end"] > x["start"]) | (r["start"] < x["end"])).alias("known")))
        return F.filter(flag, lambda x: x["token"])

    return let(F.array_sort(F.concat(marks, items)), judged)


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans by kind (start, end) and identifier-like tokens (known: within a base span), without texts."""
    body = docs.select("doc_id", text_of().alias("text"))
    spans = body.select("doc_id", row_key(F.col("text")).alias("key"), *(c.alias(k) for k, c in base_spans(F.col("text")).items()), match_spans(F.col("text"), TOKEN).alias("tokens"))
    slim = {k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS[:4]}
    tokens = F.transform("tokens", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _pattern(s["gap"], s["text"]).alias("pattern")))
    found = spans.select("doc_id", "key", *(c.alias(k) for k, c in slim.items()), tokens.alias("tokens"))
    return found.withColumn("tokens", F.when(F.size("tokens") > 0, _flagged(F.col("tokens"), F.concat(*KINDS[:4]))))


def _scored_patterns(tokens: DataFrame, how: Bootstrap) -> DataFrame:
    """The patterns that are trusted once a round adds none; a believed instance supports them like a seed.

    In the first rounds all patterns of enough support raise beliefs, then trusted ones only.  Beliefs never fall.
    A pattern may hold most instances and an instance most patterns: joins are spread.
    """
    edges = tokens.groupBy("pattern", F.xxhash64("text").alias("instance")).agg(F.max("seed").cast("double").alias("belief"))
    instance, known, k = checkpointed(edges), -1, 0
    while True:
        support = F.sum((F.col("belief") >= how.min_confidence).cast("bigint"))
        scored = instance.groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + how.smoothing)).alias("confidence"), support.alias("support"))
        able = checkpointed(scored.where(F.col("support") >= how.min_seeds).select("pattern", "confidence"))
        trusted = able.where(F.col("confidence") >= how.min_confidence)
        count, k = trusted.count(), k + 1
        if k >= how.rounds and count == known:
            return trusted.select("pattern")
        known = count if k >= how.rounds else -1
        likely = spread_join(instance, able if k < how.rounds else trusted, "pattern", "instance", "left")
        raised = likely.groupBy("instance").agg(F.max(F.greatest("belief", "confidence")).alias("raised"), F.min("belief").alias("low")).where("raised > low").drop("low")
        instance = checkpointed(spread_join(instance, raised, "instance", "pattern", "left").select("pattern", "instance", F.greatest("belief", "raised").alias("belief")))


def find(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id and, for each kind, its spans; `id` are those that the bootstrap adds."""
    found = checkpointed(_found(docs))
    tokens = found.where(F.size("tokens") > 0).select("doc_id", "key", F.explode("tokens").alias("x")).select("doc_id", "key", "x.start", "x.end", "x.text", "x.pattern", "x.known")
    tokens = tokens.withColumn("secret", F.col("text").rlike(SECRET)).withColumn("seed", (F.col("known") | F.col("secret")).cast("int"))
    trusted = _scored_patterns(tokens, how)
    judged = spread_join(tokens.where("not known"), trusted.withColumn("trusted", F.lit(True)), "pattern", "key", "left")
    added = judged.where("secret or trusted").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("id"))
    joined = found.alias("f").join(added.alias("a"), F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.key.a") == F.col("a.key.a")) & (F.col("f.key.b") == F.col("a.key.b")), "left")
    return joined.select("f.doc_id", *(f"f.{k}" for k in KINDS[:4]), F.coalesce("a.id", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("id"))


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind, comma-joined."""

    def tagged(n: int) -> Column:
        return F.transform(kinds[n], lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    all_spans = F.concat(*map(tagged, range(len(kinds))))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """The contract's columns, then n_id (spans that the method adds) and n_found (all spans)."""
    found = find(docs, how)
    sizes = [F.size(k).cast("bigint") for k in KINDS]
    return found.select("doc_id", *(n.alias(f"n_{k}") for k, n in zip(KINDS[:4], sizes)), F.sha2(_listed(KINDS[:4]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), sizes[4].alias("n_id"), (sizes[0] + sizes[1] + sizes[2] + sizes[3] + sizes[4]).alias("n_found"))
