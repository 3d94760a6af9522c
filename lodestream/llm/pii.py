"""Personal data by bootstrapped contextual extraction (operator 1), DataFrame functions only.

Seeds are the spans of the four base kinds (email, ip, card, phone) and tokens of the shape of a
key or secret (SECRET). Every other identifier-like token is a candidate instance. What stands
around an instance gives its lexical patterns: the word before it; that word with what separates
the two (quotes, colons, equals signs); and these with what follows, a separator and the next word.
Pattern
and instance scores are computed on the graph between them, in rounds: a pattern's confidence is
the score of what it holds over all its occurrences in the corpus, an instance's score is the
chance that one of its patterns is right, so that instances found by one pattern lend support to
others. Candidates in a pattern of high confidence become spans of kind "id".

Base spans stay whatever the method finds. A null or empty text has none; repeated rows get
the same spans; extra columns are ignored; an empty table gives an empty result. Positions are
code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table, whole_text

# The base expressions, written so that a failing run of characters is scanned once: the
# look-behind (or \G, right after a match) forbids starts inside a run, whose outcome is that
# of the run's first character, and possessive runs have nothing to give back.
_USER = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_USER})|\G){_USER}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_ID = "[A-Za-z0-9._%+@#/-]"
CANDIDATE = rf"(?<!{_ID})(?=[A-Za-z._%+@#/-]*+[0-9]){_ID}{{4,}}+"
#: Tokens that are seeds by their shape alone: hexadecimal keys, and keys with a fixed prefix.
SECRET = r"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,}|AKIA[A-Z0-9]{16}|gh[a-z]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9-]{20,})$"
# Words end at white space and at what encloses or introduces a value; outer punctuation is not part of them.
_BREAK = r"\s\"()\[\]{}<>=:|"
_OUTER = r"\s.,;:!?\"'()\[\]{}<>=|*#&%$"
_WORD = rf"[^{_BREAK}]*[^{_OUTER}]"
_LAST = rf"({_WORD})([{_OUTER}]*)$"
_NEXT = rf"^([{_OUTER}]*)({_WORD})"
_TRIM = ".,;:!?\"'()[]{}<>=|*#&%$"
_TOKEN = rf"{_WORD}[{_OUTER}]*"  # a word and what separates it from the next

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "id"
SPAN = "array<struct<k:int,s:int,e:int>>"

# A long text is treated in segments of about SEGMENT characters, so that the work on it grows
# with its length and not with the square of its matches. A segment ends after a character that
# no span can hold, or after a space that follows a letter or the like (spans that hold spaces
# hold none of those). A stretch without either is one segment.
SEGMENT = 1 << 13
BEFORE = 64  # characters that are searched for the word before a span, and for that after it
_SEGMENTS = rf"(?s).{{1,{SEGMENT}}}+(?:.*?(?:[^A-Za-z0-9._%+@#/()\x20-]|(?<=[A-Za-z_%@#/])\x20)|.*)"


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    min_confidence: float = 0.5
    min_support: int = 3  # different instances, by score, that must follow a pattern
    min_digits: int = 4  # of a discovered identifier
    bits: int = 1 << 24  # of each table that sifts words or patterns before they are shuffled; broadcast, 64 bits a row


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def _luhn(m: Column) -> Column:
    d = F.reverse(F.translate(m, " -", ""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit((2 * x) // 10 + (2 * x) % 10) for x in range(10)]), F.substr(d, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


_VALID = (
    lambda m: F.lit(True),
    lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    lambda m: _digits(m).between(16, 19) & _luhn(m),
    lambda m: _digits(m).between(8, 15),
)
# a cheap test of the whole text before the full expression
_GUARD = (
    lambda t: F.contains(t, F.lit("@")),
    lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    lambda t: t.rlike(r"\+[0-9]"),
)


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _located(t: Column, pattern: str, kind: int) -> Column:
    """All matches as (k, s, e, m): what lies between matches gives their positions."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(t, pattern, -1), lambda x: F.length(x))
    empty = F.expr("cast(array() as array<struct<k:int,s:int,e:int,m:string>>)")
    return F.aggregate(
        F.arrays_zip(found.alias("m"), gaps.alias("g")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.when(x["m"].isNull(), a).otherwise(F.struct(
            (a["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                F.lit(kind).alias("k"), (a["at"] + x["g"]).alias("s"),
                (a["at"] + x["g"] + F.length(x["m"])).alias("e"), x["m"].alias("m"),
            ))).alias("out"),
        )),
    )["out"]


def _spans(t: Column, kind: int, pattern: str) -> Column:
    good = F.filter(_located(t, pattern, kind), lambda x: _VALID[kind](x["m"]))
    return F.when(
        _GUARD[kind](t),
        F.transform(good, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))),
    ).otherwise(_none())


def _segments(t: Column) -> Column:
    """(at, seg, left): where each segment begins, its text, and the characters before it."""
    cut_up = F.aggregate(
        F.regexp_extract_all(t, F.lit(_SEGMENTS), F.lit(0)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("left"), F.expr("cast(array() as array<struct<at:int,seg:string,left:string>>)").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x)).alias("at"), F.right(x, F.lit(BEFORE)).alias("left"),
            F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), x.alias("seg"), a["left"].alias("left")))).alias("out"),
        ),
    )["out"]
    whole = F.array(F.struct(F.lit(0).alias("at"), t.alias("seg"), F.lit("").alias("left")))
    return F.when(F.length(t) <= SEGMENT, whole).otherwise(cut_up)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __p_base, the valid base spans by kind and start, and __p_seg, the segments with
    their own base spans."""
    df = docs.withColumn("__p_t", whole_text(text))
    df = df.withColumn("__p_seg", F.transform(_segments(F.col("__p_t")), lambda g: F.struct(
        g["at"].alias("at"), g["seg"].alias("seg"), g["left"].alias("left"),
        F.concat(*[_spans(g["seg"], k, p) for k, p in enumerate((EMAIL, IP, CARD, PHONE))]).alias("base"),
    )))
    return df.withColumn("__p_base", F.array_sort(F.flatten(F.transform("__p_seg", lambda g: F.transform(g["base"], lambda b: F.struct(
        b["k"].alias("k"), (b["s"] + g["at"]).alias("s"), (b["e"] + g["at"]).alias("e")))))))


def _lexical(word: Column, gap: Column, after_gap: Column, after: Column) -> Column:
    """The patterns of what stands between word + gap and after_gap + after; empty ones say nothing."""
    def sep(x: Column) -> Column:
        return F.regexp_replace(x, r"\s+", " ")

    word, after = F.ltrim(F.lower(word), F.lit(_TRIM)), F.ltrim(F.lower(after), F.lit(_TRIM))
    return F.array(
        F.when(word != "", F.concat(F.lit("w"), word)).otherwise(""),
        F.when((word != "") & (F.trim(gap) != ""), F.concat(F.lit("l"), word, F.lit("\u0001"), sep(gap))).otherwise(""),
        F.when((word != "") & (after != ""), F.concat(F.lit("b"), word, F.lit("\u0001"), sep(gap), F.lit("\u0001"), sep(after_gap), F.lit("\u0001"), after)).otherwise(""),
    )


def _around(g: Column, s: Column, e: Column) -> Column:
    """The patterns of a span of a segment."""
    end = s + F.length(g["left"])
    left = F.substr(F.concat(g["left"], g["seg"]), F.greatest(end - (BEFORE - 1), F.lit(1)), F.least(end, F.lit(BEFORE)))
    right = F.substr(g["seg"], e + 1, F.lit(BEFORE))
    return _lexical(F.regexp_extract(left, _LAST, 1), F.regexp_extract(left, _LAST, 2), F.regexp_extract(right, _NEXT, 1), F.regexp_extract(right, _NEXT, 2))


def _ends(token: Column) -> tuple[Column, Column]:
    """The word of a _TOKEN, and what separates it from the next."""
    word = F.rtrim(token, F.lit(_TRIM + " \t\n\u000b\f\r"))
    return word, F.substr(token, F.length(word) + 1)


def _word(p: Column) -> Column:
    """The word before the span, which every pattern begins with after its kind."""
    return F.substring_index(F.substr(p, F.lit(2)), "\u0001", 1)


def _bit(x: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(bits))


def _sifted(df: DataFrame, x: Column, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows of df whose x may be a value of wanted's one column: all that are, and those
    others that share a bit with one. The table of bits is broadcast; it has at most bits / 64
    rows of two longs, however many values there are."""
    set_bits = wanted.select(_bit(F.col(wanted.columns[0]), bits).alias("__b"))
    sieve = set_bits.groupBy(F.shiftright("__b", 6).alias("__row")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b").bitwiseAND(63).cast("int"))).alias("__bits"))
    return df.withColumn("__b", _bit(x, bits)).withColumn("__row", F.shiftright("__b", 6)).join(F.broadcast(sieve), "__row").filter(
        F.bit_get("__bits", F.col("__b").bitwiseAND(63).cast("int")) == 1).drop("__b", "__row", "__bits")


def corpus_patterns(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """p: a row for each pattern of `wanted` that the corpus's words would have if each were a
    span (and for the few others that pass the tables of bits). Words are sifted by the word
    before their patterns are made, and patterns again before they are counted."""
    listed = docs.select(F.regexp_extract_all(whole_text(), F.lit(_TOKEN), F.lit(0)).alias("all"))

    def later(k: int) -> Column:
        return F.slice("all", k + 1, F.size("all")).alias(f"t{k}")

    one = listed.select(F.explode(F.arrays_zip(F.col("all").alias("t0"), later(1), later(2))).alias("x")).select(
        "x.t0", *[F.coalesce(f"x.t{k}", F.lit("")).alias(f"t{k}") for k in (1, 2)])
    word, gap = _ends(F.col("t0"))
    one = one.select(word.alias("word"), "t0", "t1", "t2")
    one = _sifted(one, F.ltrim(F.lower("word"), F.lit(_TRIM)), wanted.select(_word(F.col("p")).alias("word")), bits)
    one = one.select(F.explode(_lexical(F.col("word"), gap, _ends(F.col("t1"))[1], _ends(F.col("t2"))[0])).alias("p")).filter("p <> ''")
    return _sifted(one, F.col("p"), wanted.select("p"), bits)


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds __p_cand: (s, e, p, m), p its patterns, of identifier-like tokens outside the base spans, and
    __p_seed: (p, m) of the base spans."""
    def candidates(g: Column) -> Column:
        free = F.filter(
            _located(g["seg"], CANDIDATE, len(KINDS)),
            lambda x: ~F.exists(g["base"], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
        )
        return F.transform(free, lambda x: F.struct(
            (x["s"] + g["at"]).alias("s"), (x["e"] + g["at"]).alias("e"), _around(g, x["s"], x["e"]).alias("p"), x["m"].alias("m"),
        ))

    def seeds(g: Column) -> Column:
        return F.transform(g["base"], lambda b: F.struct(
            _around(g, b["s"], b["e"]).alias("p"), F.substr(g["seg"], b["s"] + 1, b["e"] - b["s"]).alias("m"),
        ))

    return df.withColumns({
        "__p_cand": F.when(F.col("__p_t").rlike("[0-9]"), F.flatten(F.transform("__p_seg", candidates))).otherwise(
            F.expr("cast(array() as array<struct<s:int,e:int,p:array<string>,m:string>>)")),
        "__p_seed": F.flatten(F.transform("__p_seg", seeds)),
    })


def learn_patterns(docs: DataFrame, found: DataFrame, how: Bootstrap) -> DataFrame:
    """Patterns of high confidence, with it: (p, confidence).

    found holds __p_cand and __p_seed of each row. A pattern's occurrences are counted over the
    whole corpus, summed before they are shuffled; those of patterns that cannot matter are
    sifted out before that, by tables of how.bits bits. A pattern that could not
    reach the confidence even if all that it holds were right is left out before the rounds.
    """
    edges = (
        found.select(F.explode("__p_seed").alias("x"), F.lit(1).alias("seed"))
        .select("x.p", "x.m", "seed")
        .union(
            found.select(F.explode("__p_cand").alias("x")).select("x.p", "x.m", F.col("x.m").rlike(SECRET).cast("int").alias("seed"))
            .filter(_digits(F.col("m")) >= how.min_digits)
        )
        .select(F.explode("p").alias("p"), "m", "seed").filter("p <> ''")
        .groupBy("p", "m").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    )
    edges = cut(edges, "pii-edges")
    hopeful = cut(edges.groupBy("p").agg(F.sum("n").alias("most"), F.count("*").alias("kinds")).filter(F.col("kinds") >= how.min_support).select("p", "most"), "pii-hopeful")
    words = corpus_patterns(docs, hopeful.select("p"), how.bits).groupBy("p").agg(F.count("*").alias("total"))
    patterns = cut(
        hopeful.join(words, "p", "left").withColumn("total", F.greatest("most", F.coalesce("total", F.lit(0))))
        .filter(F.col("most") >= how.min_confidence * F.col("total")).select("p", "total"),
        "pii-patterns",
    )
    drop(hopeful)
    hopeful = patterns
    graph = cut(edges.join(hopeful, "p"), "pii-graph")
    score = graph.groupBy("m").agg(F.max("seed").cast("double").alias("score"))
    patterns = None
    for _ in range(how.rounds):
        if patterns is not None:
            drop(patterns)
        patterns = cut(
            graph.join(score, "m").groupBy("p").agg(
                F.sum(F.col("n") * F.col("score")).alias("right"), F.max("total").alias("total"), F.sum("score").alias("support"))
            .filter(F.col("support") >= how.min_support)
            .select("p", F.least(F.lit(1.0), F.col("right") / F.col("total")).alias("confidence")),
            "pii-confidence",
        )
        miss = F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("confidence", F.lit(0.0))))
        previous, score = score, cut(
            graph.join(patterns, "p", "left").groupBy("m").agg(
                F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(F.sum(miss))).alias("score")),
            "pii-score",
        )
        drop(previous)
    for done in (score, graph, hopeful, edges):
        drop(done)
    return patterns.filter(F.col("confidence") >= how.min_confidence)


def discover(found: DataFrame, patterns: DataFrame, key: list[str], how: Bootstrap) -> DataFrame:
    """key columns and __p_more, the spans of kind id."""
    one = found.select(*key, F.explode("__p_cand").alias("x")).select(*key, "x.*").filter(_digits(F.col("m")) >= how.min_digits)
    one = one.select(*key, "s", "e", F.explode("p").alias("p"))
    return one.join(patterns.select("p"), "p").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(
        F.lit(len(KINDS)).alias("k"), F.col("s"), F.col("e")))).alias("__p_more"))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*KINDS, DISCOVERED)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str, how: Bootstrap = Bootstrap()) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_candidates(with_base_spans(docs)).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "__p_base", "__p_cand", "__p_seed")
    found = cut(found, "pii-found")
    patterns = learn_patterns(docs, found, how)
    more = discover(found, patterns, ["rid"], how)
    out = found.select("rid", "doc_id", "__p_base").join(more, "rid", "left")
    base = F.col("__p_base")
    return out.select(
        "doc_id",
        *[_count(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.coalesce("__p_more", _none()))).alias("spans"),
    )


def _redacted_segment(t: Column, spans: Column) -> Column:
    """Each span becomes <KIND>; a span that begins inside an earlier one extends it."""
    marks = F.array(*[F.lit(f"<{x.upper()}>") for x in (*KINDS, DISCOVERED)])
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    done = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], -x["e"]).alias("at"),
            F.when(x["s"] >= a["at"], F.concat(
                a["out"], F.substr(t, a["at"] + 1, x["s"] - a["at"]), F.element_at(marks, x["k"] + 1)
            )).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.concat(done["out"], F.substr(t, done["at"] + 1, F.length(t)))


def _redacted(t: Column, segments: Column, spans: Column) -> Column:
    def part(g: Column) -> Column:
        own = F.transform(
            F.filter(spans, lambda x: (x["s"] >= g["at"]) & (x["s"] < g["at"] + F.length(g["seg"]))),
            lambda x: F.struct(x["k"].alias("k"), (x["s"] - g["at"]).alias("s"), (x["e"] - g["at"]).alias("e")),
        )
        return F.when(F.size(own) > 0, _redacted_segment(g["seg"], own)).otherwise(g["seg"])

    return F.when(F.size(spans) > 0, F.array_join(F.transform(segments, part), "")).otherwise(t)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str, how: Bootstrap = Bootstrap()) -> DataFrame:
    """Pipeline stage: personal data in every text is replaced by its kind. Columns as given;
    n_chars follows the new text, a null text stays null. Rows are told apart by doc_id and
    the text's hash, so rows that repeat a doc_id are each redacted by their own spans."""
    key = ["__p_id", "__p_h"]
    # the row travels as one struct, so none of its columns can clash with the stage's own
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__p_id"), F.xxhash64("text").alias("__p_h"), "text",
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__p_doc"),
    )
    found = cut(
        with_candidates(with_base_spans(keyed.select(*key, "text")))
        .filter("size(__p_cand) > 0 or size(__p_seed) > 0").select(*key, "__p_cand", "__p_seed"),
        "pii-stage",
    )
    patterns = learn_patterns(docs, found, how)
    more = cut(discover(found, patterns, key, how), "pii-more")
    base = with_base_spans(keyed)
    if more.isEmpty():
        base = base.withColumn("__p_more", _none())
    else:
        base = base.join(more, key, "left").withColumn("__p_more", F.coalesce("__p_more", _none()))
    text = F.when(F.col("text").isNotNull(), _redacted(F.col("__p_t"), F.col("__p_seg"), F.concat("__p_base", "__p_more")))
    new = {"text": F.col("__p_new").alias("text"), "n_chars": F.length("__p_new").cast("long").alias("n_chars")}
    return base.withColumn("__p_new", text).select(*[new.get(c, F.col(f"__p_doc.`{c}`")) for c in docs.columns])
