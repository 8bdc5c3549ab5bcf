"""Personal data by rules and bootstrapped contexts (DataFrame functions only).

Base spans come from fixed expressions.  They, and tokens with the shape of a key, are the seeds
of a search for more.  A pattern is two words before a token, or the word before and the word
after, with the token's kind of shape; in these words, base spans stand as their kind.  Patterns
and instances (tokens) form a graph.  Spark scores it in rounds: a pattern is trusted by the share
of seeds and of instances found so far among what stands in it, an instance scores by the trust
of the patterns that it stands in.  Tokens of high score in a trusted pattern are added; those
with the shape of a key too, so one that stands in no such pattern is left alone.

Scale: expressions run map-side where a character that they need occurs, in time proportional to
the text.  Only tokens with a digit or an at sign are shuffled, as counted (pattern, instance)
links; texts never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import scratch
from tidewell.llm.arrays import let, pieces, replaced, starts

#: Kinds of base spans, and those of all spans.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
# The look-behinds and possessive forms match the same spans as the plain expressions, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = r"[^\x20\x09-\x0D]++"
#: Shape of a key: letters and digits that change places four times at least.
KEY = r"^(?=.{20})[A-Za-z0-9+/_=-]*+$"
CHANGES = r"(?:[A-Za-z+/_=-]++[0-9]++){4}"
#: Characters that stand for base spans in a text, by kind.
MASKS = "\ue000\ue001\ue002\ue003"
#: Rounds of scoring; the score an added token needs; what a pattern must have of seeds and found instances, and its prior count of others.
ROUNDS, ACCEPT, SEEDS, PRIOR = 3, 0.8, 5, 1.0
#: At most so many bytes of identifiers and spans are broadcast; beyond that a shuffled join is used.
BROADCAST_BYTES = 4 << 20
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if scratch.size(table) <= BROADCAST_BYTES else table


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, word>> of all matches, by code points."""

    def found(words: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(words)), F.char_length)

        def placed(before: Column) -> Column:
            both = F.zip_with(words, before, lambda w, g: F.char_length(w) + g)
            return let(starts(both), lambda at: F.transform(words, lambda w, k: F.struct((at[k] + before[k]).alias("start"), (at[k] + before[k] + F.char_length(w)).alias("end"), w.alias("word"))))

        return F.when(F.size(words) > 0, let(gaps, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,word:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of base spans, by start, then kind; kind is its place in KINDS."""
    octets = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

    def n(w: Column) -> Column:
        return F.char_length(_digits(w))

    rules = (
        (EMAIL, F.contains(text, F.lit("@")), lambda w: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda w: w.rlike(octets)),
        (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda w: F.when(n(w).between(12, 19), luhn(_digits(w))).otherwise(False)),
        (PHONE, F.contains(text, F.lit("+")), lambda w: n(w).between(9, 15)),
    )

    def found(k: int, pattern: str, may: Column, ok) -> Column:
        good = F.filter(matches(text, pattern), lambda m: ok(m["word"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
        return F.when(may, spans).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*[found(k, *rule) for k, rule in enumerate(rules)]))


def _shape(word: Column) -> Column:
    """What a token is made of and, in powers of two, how long it is."""
    kind = (
        F.when(F.contains(word, F.lit("@")), "at")
        .when(word.rlike("^[0-9]+$"), "digits")
        .when(~word.rlike("[A-Za-z]"), "number")
        .when(word.rlike(KEY) & word.rlike(CHANGES), "key")
        .otherwise("mixed")
    )
    return F.concat(kind, F.floor(F.log2(F.char_length(word))).cast("string"))


def _plain(word: Column) -> Column:
    """A context's word: lower case, digits alike, marks about it gone unless there's nothing else."""
    word = F.regexp_replace(F.regexp_replace(F.lower(word), "[0-9]++", "0"), rf"[{MASKS}]++", "")
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}=:]++|[^\p{L}\p{N}=:]++$", "")
    return F.substring(F.when(bare != "", bare).otherwise(word), 1, 40)


def _with_tokens(rows: DataFrame) -> DataFrame:
    """Add tokens to rows with text and base: array<struct<start, end, before, about, instance, kind>> of
    those with a digit, an at sign or a base span, by their patterns, and the kind if the token is a seed
    (a base span's, or that of keys), else -1."""
    text, words = F.col("text"), F.col("__words")
    masks = F.array(*[F.lit(c) for c in MASKS])
    masked = replaced(F.translate(text, MASKS, "\ufffd" * len(MASKS)), F.col("base"), lambda s: F.repeat(masks[s["kind"]], s["end"] - s["start"]))
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")

    def core(w: Column, k: Column) -> Column:
        whole = F.regexp_extract(w["word"], rf"[{MASKS}]++", 0)
        inner = F.when(whole != "", whole).otherwise(F.regexp_extract(w["word"], r"[A-Za-z0-9+](?:.*[A-Za-z0-9=])?+", 0))
        at = w["start"] + F.instr(w["word"], inner) - 1
        return F.when(w["word"].rlike(f"[0-9@{MASKS}]") & (inner != ""), F.struct(at.alias("a"), (at + F.char_length(inner)).alias("b"), whole.alias("whole"), k.alias("k")))

    def near(k: Column) -> Column:
        return F.when((k >= 0) & (k < F.size(words)), _plain(words[k]["word"])).otherwise("^")

    def token(c: Column, word: Column) -> Column:
        shape, k = _shape(word), c["k"]
        kind = F.when(c["whole"] != "", F.instr(F.lit(MASKS), F.substring(c["whole"], 1, 1)) - 1).when(shape.startswith("key"), len(KINDS)).otherwise(-1)
        return F.struct(
            c["a"].alias("start"),
            c["b"].alias("end"),
            F.concat_ws(" ", near(k - 2), near(k - 1), F.lit("_"), shape).alias("before"),
            F.concat_ws(" ", near(k - 1), F.lit("_"), near(k + 1), shape).alias("about"),
            F.xxhash64(F.lower(word)).alias("instance"),
            kind.cast("int").alias("kind"),
        )

    # A column of one step is computed once, and a later step refers to it.
    rows = rows.withColumn("__masked", F.when(text.rlike("[0-9@]"), masked))
    rows = rows.withColumn("__words", F.when(F.col("__masked").isNotNull(), matches(F.col("__masked"), WORD)).otherwise(none))
    rows = rows.withColumn("__cores", F.filter(F.transform(words, core), lambda c: c.isNotNull()))
    rows = rows.withColumn("__own", pieces(text, F.col("__cores")))
    return rows.withColumn("tokens", F.zip_with("__cores", "__own", token)).drop("__masked", "__words", "__cores", "__own")


def _accepted(tokens: DataFrame) -> DataFrame:
    """Score the graph of patterns and instances; return pattern, instance and kind of tokens to add.

    Tokens with the shape of a key are both seeds of their kind and tokens to judge.
    """
    both = tokens.select(F.explode(F.array(F.struct("before", F.lit(0).alias("side")), F.struct(F.col("about").alias("before"), F.lit(1).alias("side")))).alias("p"), "instance", "kind")
    edges = both.groupBy(F.col("p.before").alias("pattern"), F.col("p.side").alias("side"), "instance", "kind").agg(F.count(F.lit(1)).alias("n"))
    edges = scratch.written(edges, "pii-links")
    seeds = edges.where("kind >= 0").select("pattern", F.col("kind").alias("as"), F.col("n").cast("double").alias("mass"))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    new = edges.where(F.col("kind").isin(-1, len(KINDS)))
    each = new.groupBy("instance", "side").agg(F.sum("n").alias("all"))
    mass = seeds
    for _ in range(ROUNDS):
        trust = mass.groupBy("pattern", "as").agg(F.sum("mass").alias("mass")).where(F.col("mass") >= SEEDS)
        trust = trust.join(totals, "pattern").select("pattern", "as", (F.col("mass") / (F.col("total") + PRIOR)).alias("trust"))
        trust = scratch.written(trust.where(F.col("trust") >= ACCEPT / 2), "pii-trust")
        # An instance's score is the mean trust of where it stands, on the side where that is more.
        linked = new.join(few(trust), "pattern").groupBy("instance", "side", "as").agg(F.sum(F.col("n") * F.col("trust")).alias("sum"))
        scores = linked.join(each, ["instance", "side"]).groupBy("instance", "as").agg(F.max(F.col("sum") / F.col("all")).alias("score"))
        scores = scratch.written(scores.where(F.col("score") >= ACCEPT), "pii-scores")
        found = new.where("kind = -1").join(few(scores), "instance").select("pattern", "as", (F.col("n") * F.col("score")).alias("mass"))
        mass = seeds.unionByName(found)
    fits = new.join(few(trust), "pattern").join(few(scores), ["instance", "as"])
    # A token with the shape of a key is one of those or nothing.
    fits = fits.where((F.col("kind") == -1) | (F.col("kind") == F.col("as")))
    return fits.groupBy("pattern", "instance").agg(F.max_by("as", F.struct("score", -F.col("as"))).alias("as"))


def find(docs: DataFrame) -> DataFrame:
    """Return doc_id, mark (a hash of the text), base and spans for each row of `docs`.

    Spans are array<struct<start, kind, end>> in code points, end exclusive, by start, then
    kind.  Null and empty texts have none; a null doc_id stays null; repeated rows are judged
    alike.  No rows: an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = _with_tokens(rows).select("doc_id", "mark", "base", "tokens", F.monotonically_increasing_id().alias("row"))
    rows = scratch.written(rows, "pii-rows")
    tokens = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    accepted = scratch.written(_accepted(tokens), "pii-accepted")
    new = tokens.where(F.col("kind").isin(-1, len(KINDS)))
    hits = [new.join(few(accepted), (F.col(side) == F.col("pattern")) & (new["instance"] == accepted["instance"])).select("row", "start", "end", "as") for side in ("before", "about")]
    added = hits[0].unionByName(hits[1]).groupBy("row", "start", "end").agg(F.min("as").cast("int").alias("kind"))
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    added = scratch.written(added, "pii-added")
    more = F.coalesce("more", F.array().cast(_SPANS))
    return rows.join(few(added), "row", "left").select("doc_id", "mark", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Return all rows and columns of `docs` with each span's text replaced by its kind in brackets."""
    found = find(docs).where(F.size("spans") > F.size("base")).select("doc_id", "mark", "spans").distinct()
    found = scratch.written(found.withColumnsRenamed({"doc_id": "__id", "mark": "__mark", "spans": "__spans"}), "pii-more")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    text = F.col("__doc.text").cast("string")
    known = F.col("__doc.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__mark"))
    rows = rows.join(few(found), known, "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL])
    clean = replaced(text, F.coalesce("__spans", base_spans(F.coalesce(text, F.lit("")))), lambda s: names[s["kind"]])
    return rows.select(*[clean.alias("text") if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
