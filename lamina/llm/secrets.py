"""Secret scans in DataFrame functions alone: fixed patterns, and character Markov models of random strings and identifiers.

Spans of a pattern come from its matches and the pieces of text between them: their lengths, summed up, are the places.
Two first-order Markov models over the characters of tokens, one trained from strings labelled random and one from
strings labelled ordinary, give each long token a log-likelihood ratio; tokens above the thresholds are spans too.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own

# The kinds, their patterns and the least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12

#: Characters of tokens; a token is a run of at least ``TOKEN_LEAST`` of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}"
#: A token is a secret if its log-likelihood ratio, in nats, is at least this for each character pair and in all, and
#: if it has that many different characters (rulers and padding are neither random nor ordinary).
PER_PAIR, IN_ALL, VARIED = 1.0, 25.0, 8

#: Words of ordinary identifiers, for the labelled samples that come with the operator.
WORDS = (
    "get set user name password file path index count value list map data node tree table column row key hash buffer stream reader "
    "writer config option default handler request response client server session connection thread process queue message event "
    "listener factory builder manager service controller model view template render parse format string number integer double "
    "boolean array object class method function module package import export version release update create delete insert select "
    "where order group limit offset page search filter sort merge split join append remove contains start stop begin end first last "
    "next previous current total average minimum maximum width height color image video audio download upload token secret access "
    "document language international organization administration communication environment implementation"
).split()

Spans = Column


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def before(steps: Column, join: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each place of an array of longs, what ``join`` (a sum or a maximum of numbers from 0 on) makes of all that stands before.

    By blocks of about the root of the array's length, so no place looks at all others.
    """

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: join(a, x))

    def within(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda b: total(F.slice(xs, b * width + 1, width)))

        def place(blocks: Column) -> Column:
            bases = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
            return let(bases, lambda base: F.transform(xs, lambda _, i: join(F.get(base, F.floor(i / width).cast("int")), total(F.slice(xs, F.floor(i / width).cast("int") * width + 1, i % width)))))

        return let(blocks, place)

    return F.when(F.size(steps) > 0, let(steps, within)).otherwise(F.array().cast("array<bigint>"))


NONE = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"


def matches(text: Column, pattern: str, kind: int) -> Spans:
    """Leftmost non-overlapping matches as (start, kind, end, found), in code points."""

    def place(found: Column) -> Column:
        def among(between: Column) -> Column:
            steps = F.transform(found, lambda x, i: (F.length(x) + F.length(F.get(between, i))).cast("long"))

            def span(ahead: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    start = F.get(ahead, i) + F.length(F.get(between, i))
                    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x)).alias("end"), x.alias("found"))

                return F.transform(found, one)

            return let(before(steps), span)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), among)).otherwise(F.array().cast(NONE))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> Spans:
    """Spans of the three patterns. The value of an assignment has a least length; a match with less goes, and isn't tried anew."""
    assign = F.filter(matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= LEAST_VALUE)
    return F.concat(assign, F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, 1)).otherwise(F.slice(assign, 1, 0)), matches(text, HEX, 2))


# ---------------------------------------------------------------- the models


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, random): labelled strings made by rule: digests in three spellings, and words joined as identifiers are."""
    words = F.split(F.lit(" ".join(WORDS)), " ")

    def word(k: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))

    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    plain = F.base64(F.unhex(digest))
    spelled = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, plain).otherwise(F.regexp_replace(plain, "[^A-Za-z0-9]", ""))
    style = F.col("id") % 5
    joined = (
        F.when(style == 0, F.concat_ws("_", word(1), word(2), word(3), word(4)))
        .when(style == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4))))
        .when(style == 2, F.concat_ws("-", word(1), word(2), word(3), F.lit("v"), (F.col("id") % 10).cast("string")))
        .when(style == 3, F.concat_ws("/", word(1), word(2), word(3), word(4)))
        .otherwise(F.upper(F.concat_ws("_", word(1), word(2), word(3))))
    )
    joined = F.when(F.col("id") % 7 == 0, F.concat(word(5), word(6), word(7))).otherwise(joined)
    return ids.select(spelled.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(joined.alias("text"), F.lit(False).alias("random")))


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, from (text, random); a table of the alphabet squared.

    Pairs with other characters, null texts and null labels count for nothing.
    """
    chars = F.split("text", "")
    pairs = labelled.where("text is not null and random is not null and length(text) > 1").select("random", F.explode(F.arrays_zip(F.slice(chars, 1, F.length("text") - 1).alias("a"), F.slice(chars, F.lit(2), F.length("text") - 1).alias("b"))).alias("p"))
    place = [F.instr(F.lit(ALPHABET), F.col(f"p.{x}")) for x in "ab"]
    found = pairs.select("random", place[0].alias("i"), place[1].alias("j")).where("i > 0 and j > 0").groupBy("random", "i", "j").count().collect()
    k = len(ALPHABET)
    counts = {r: [[smooth] * k for _ in range(k)] for r in (True, False)}
    for row in found:  # two tables of the alphabet squared
        counts[row["random"]][row["i"] - 1][row["j"] - 1] += row["count"]
    sums = {r: [sum(x) for x in counts[r]] for r in counts}
    return [log(counts[True][i][j] / sums[True][i]) - log(counts[False][i][j] / sums[False][i]) for i in range(k) for j in range(k)]


def ratio(token: Column, table: Column) -> Column:
    """The token's log-likelihood ratio; ``table`` as an array column."""
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def score(at: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(at, i - 1) * len(ALPHABET) + F.get(at, i)))

    return let(places, score)


def random_spans(text: Column, model: list[float]) -> Spans:
    """Tokens that the model calls random."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")

    def judged(found: Column) -> Column:
        def keep(table: Column) -> Column:
            return F.filter(found, lambda s: (F.size(F.array_distinct(F.split(s["found"], ""))) >= VARIED) & let(ratio(s["found"], table), lambda r: (r >= IN_ALL) & (r >= PER_PAIR * (F.length(s["found"]) - 1))))

        return F.when(F.size(found) > 0, let(table, keep)).otherwise(found)

    return let(matches(text, TOKEN, 3), judged)


def clear(base: Column, more: Column) -> Spans:
    """``base`` and those of ``more`` that meet none of ``base``, in order of start, then kind; ``more`` doesn't overlap itself.

    In that order a span of ``more`` meets an earlier base span if it begins before the farthest end so far, and a later
    one only if that is the very next.
    """

    def judged(every: Column) -> Column:
        ends = F.transform(every, lambda s: F.when(s["kind"] < len(KINDS) - 1, s["end"]).otherwise(F.lit(0).cast("long")))

        def keep(reach: Column) -> Column:
            def stays(s: Column, i: Column) -> Column:
                after = F.get(every, i + 1)
                meets = (F.get(reach, i) > s["start"]) | F.coalesce((after["kind"] < len(KINDS) - 1) & (after["start"] < s["end"]), F.lit(False))
                return (s["kind"] < len(KINDS) - 1) | ~meets

            return F.filter(every, stays)

        return let(before(ends, F.greatest), keep)

    return F.when(F.size(more) > 0, let(F.array_sort(F.concat(base, more)), judged)).otherwise(base)


def spans(text: Column, model: list[float]) -> Column:
    """A struct (base, spans) of spans in order of start, then kind; a null text is empty. A random token that meets a base span adds nothing."""

    def found(text: Column) -> Column:
        return let(F.array_sort(base_spans(text)), lambda base: F.struct(base.alias("base"), let(random_spans(text, model), lambda more: clear(base, more)).alias("spans")))

    return let(F.coalesce(text, F.lit("")), found)


def spelled(found: Spans) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: list[float] | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end, found) for each row of ``docs``.

    Null and empty texts have no spans; whole texts are scanned whatever their length; repeated rows give repeated rows,
    an empty table an empty one; other columns play no part.
    """
    model = train(samples(docs.sparkSession)) if model is None else model
    rows = docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text), model).alias("found"))
    return rows.select("doc_id", "found.base", "found.spans")


#: Characters of one piece of a text that is cut for masking; a place is sought within its piece alone.
PIECE = 4096


def masked(text: Column, found: Spans, mark: str = "[REDACTED]") -> Column:
    """The text with every span replaced; spans that meet are replaced as one. ``found`` isn't empty and in order of start."""

    def piece(cut: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        here, there = (a - i.cast("long") * PIECE).cast("int"), (b - j.cast("long") * PIECE).cast("int")
        head = F.coalesce(F.substr(F.get(cut, i), here + 1), F.lit(""))
        tail = F.coalesce(F.substr(F.get(cut, j), F.lit(1), there), F.lit(""))
        within = F.substr(F.get(cut, i), here + 1, (b - a).cast("int"))
        return F.when(a >= b, F.lit("")).when(i == j, within).otherwise(F.concat(head, F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), tail))

    def build(cut: Column) -> Column:
        def parts(reach: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                at = F.get(reach, i)
                return F.when((i == 0) | (s["start"] > at), F.concat(piece(cut, at, s["start"]), F.lit(mark))).otherwise(F.lit(""))

            return F.array_join(F.transform(found, part), "")

        last = F.aggregate(found, F.lit(0).cast("long"), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(let(before(F.transform(found, lambda s: s["end"]), F.greatest), parts), piece(cut, last, F.length(text).cast("long")))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), build)


def mask(docs: DataFrame, text: str = "text", model: list[float] | None = None) -> DataFrame:
    """``docs`` with the secrets of each text replaced by a mark; texts without any, and null ones, stay as they are.

    A column ``n_chars``, where there is one, follows the new text. An empty table stays empty; repeated rows stay.
    """
    model = train(samples(docs.sparkSession)) if model is None else model
    held, new = f"{own(docs)}spans", f"{own(docs)}masked"
    rows = docs.withColumn(held, spans(F.col(text), model)["spans"])
    rows = rows.withColumn(new, F.when(F.size(held) > 0, masked(F.col(text), F.col(held))))
    out = {text: F.coalesce(new, text)}
    if "n_chars" in docs.columns and text != "n_chars":
        out["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(out).select(docs.columns)
