"""Personal data: base spans by rule, and terms that disclose them by co-occurrence.

Base kinds are found by pattern and checked (IP parts, Luhn, digit counts). For the
method, a protected entity is a base value. A term discloses an entity when

    PMI(term, entity) / IC(entity) >= threshold,   IC(e) = log(D / c(e)),
    PMI(t, e) = IC(e) + log P(e | t)

with D the number of distinct texts, c(e) and c(t) those that hold the entity and the term,
and P(e | t) the lower confidence bound of c(t, e) / c(t). Every rare word of a text meets
the entities of that text at least once, so the count must also beat chance: given that a
pair meets at all, the chance to meet c(t, e) times is bounded (Chernoff, Poisson mean
c(t) c(e) / D), and false discoveries among all pairs that meet are held to ``ALPHA``. A pair
met once never passes. c(t, e) counts distinct texts and distinct neighbourhoods of the
term, whichever are fewer, so exact and near copies of one text are one piece of evidence.
Disclosing terms become spans of kind ``term`` wherever they stand, in all texts. DataFrame
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import LAST, canonical, fresh, let, materialise
from .line_dedup import _may_hold

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
#: Distances in words of a term's near and far neighbours, on either side.
NEAR, FAR = (1, 2), (3, 4, 5, 6)
#: Share of false discoveries among the pairs that are taken to beat chance.
ALPHA = 0.05
#: Steps of a natural logarithm in which probabilities are counted.
_STEPS = 20
#: Standard deviations of the lower confidence bound (one-sided 90%).
Z = 1.2816
#: Share of an entity's information from which a term discloses it.
THRESHOLD = 0.8

# Linear forms of the rules: a match starts where its run of characters starts or where the last match
# ended, and runs are possessive. Both leave the matches as they are.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
TERM = r"[\p{L}\p{N}_'-]++"
_MARK = "\ue000"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def located(text: Column, pattern: str, kind: Column) -> Column:
    """Matches with code point offsets: the text between matches and the matches, added up."""
    def sums(hit: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

        def body(gap: Column) -> Column:
            state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(_SPAN).alias("out"))
            return F.aggregate(hit, state, lambda s, v: F.struct(
                (s["at"] + gap[s["i"]] + F.length(v)).alias("at"), (s["i"] + 1).alias("i"),
                F.concat(s["out"], F.array(F.struct(
                    kind.cast("int").alias("kind"), (s["at"] + gap[s["i"]]).alias("start"),
                    (s["at"] + gap[s["i"]] + F.length(v)).alias("end"), v.alias("value")))).alias("out")),
                lambda s: s["out"])
        return let(gaps, body)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sums)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


_GATE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def base_spans(text: Column) -> Column:
    """All checked base matches by kind, then start."""
    def checked(i: int, kind: str) -> Column:
        found = F.filter(located(text, PATTERNS[kind], F.lit(i)), lambda m: _valid(kind, m["value"]))
        return F.when(_GATE[kind](text), found).otherwise(F.array().cast(_SPAN))
    return F.concat(*[checked(i, kind) for i, kind in enumerate(BASE)])


def _names(term: Column) -> Column:
    return (F.length(term) >= 3) & term.rlike(r"\p{L}")


def _spread(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(term, c_t) over distinct texts, and their number."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    spread = docs.select("h", "text").dropDuplicates(["h"]).select(F.explode(terms).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    return spread, F.lit(float(docs.select("h").distinct().count()))


def _told(d: Column, threshold: float, z: float) -> Column:
    """Whether ``texts`` of c_t texts tell of an entity in c_e of ``d`` texts, by Wilson's lower bound."""
    n, zz = F.col("c_t").cast("double"), z * z
    p = F.least("texts", "c_t") / n
    low = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    ic = F.log(d / F.col("c_e"))
    return (ic > 0) & (ic + F.log(low) >= threshold * ic)


def _chance() -> Column:
    """Natural logarithm of a bound for the chance that a pair that meets does so ``c_te`` times."""
    c, mean = F.col("c_te").cast("double"), F.col("c_t") * F.col("c_e") / F.col("d")
    tail = c - mean + c * F.log(mean / c) - F.log(-F.expm1(-mean))
    return F.when((c <= 1) | (c <= mean), F.lit(0.0)).otherwise(F.least(tail, F.lit(0.0)))


def _cut(pairs: DataFrame, alpha: float) -> int | None:
    """The step of log probability from which pairs beat chance (Benjamini-Hochberg); None if none do."""
    # one row per step
    steps = sorted(((r["step"], r["n"]) for r in pairs.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, above, best = sum(n for _, n in steps), 0, None
    for step, n in steps:
        above += n
        if step > 0 and total * math.exp(-step / _STEPS) <= alpha * above:
            best = step
    return best


def _apart(spans: Column, base: Column) -> Column:
    """Spans that no base span overlaps."""
    return F.filter(spans, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def _outside(text: Column, base: Column) -> Column:
    """(term, near, far) of the terms of a text that no base span overlaps, in linear time, with hashes of their neighbours.

    A base span becomes a letter of its own, and words with that letter go. Base spans end in a term's
    character; where one does not start with such, a space keeps the word before it whole.
    """
    marked = F.transform(base, lambda b: F.struct(
        F.when(b["value"].rlike(f"^{TERM}"), 0).otherwise(1).alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    clear = _replaced(F.translate(text, _MARK, ","), marked, F.array(F.lit(_MARK), F.lit(f" {_MARK}")))
    words = F.regexp_extract_all(F.lower(clear), F.lit(TERM.replace("_'", f"_{_MARK}'")), F.lit(0))

    def each(w: Column) -> Column:
        def beside(i: Column, steps: tuple[int, ...]) -> Column:
            return F.xxhash64(*[F.coalesce(F.get(w, i + k), F.lit("")) for d in steps for k in (-d, d)])
        near = F.transform(w, lambda x, i: F.struct(x.alias("term"), beside(i, NEAR).alias("near"), beside(i, FAR).alias("far")))
        return F.array_distinct(F.filter(near, lambda x: ~F.contains(x["term"], F.lit(_MARK)) & _names(x["term"])))
    return let(words, each)


def disclosing_terms(docs: DataFrame, threshold: float = THRESHOLD, z: float = Z, alpha: float = ALPHA) -> DataFrame:
    """(term) of all terms that disclose some entity, counted over whole distinct texts.

    Entities that stand in the same texts have the same counts with every term, so one row
    stands for all of them: a text full of values met once costs one row per term.
    """
    held = docs.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    values = materialise(held.select("h", F.explode("base").alias("e")).select(
        "h", F.col("e.kind").alias("kind"), F.lower("e.value").alias("value")).distinct(), "pii_values")
    of = values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("c_e"), F.bit_xor(F.xxhash64("h")).alias("s1"),
                                             F.bit_xor(F.xxhash64(F.lit("2"), "h")).alias("s2"))
    who = materialise(values.join(of, ["kind", "value"]).select("h", "s1", "s2", "c_e").distinct(), "pii_who")
    most = who.agg(F.max("c_e")).first()[0] or 0
    spread, d = _spread(docs)
    # P(e | t) is at most c_e / c_t, so a term in more texts than this tells of no entity
    def reach(c_e: Column) -> Column:
        return F.pow(c_e.cast("double"), F.lit(threshold)) * F.pow(d, F.lit(1 - threshold)) * (1 + 1e-9)
    rare = spread.filter(_names(F.col("term")) & (F.col("c_t") <= reach(F.lit(most))))
    terms = held.select("h", F.explode(_outside(F.col("text"), F.col("base"))).alias("t")).select("h", "t.term", "t.near", "t.far").distinct()
    pairs = terms.join(rare, "term").join(who, "h").filter(F.col("c_t") <= reach(F.col("c_e"))) \
        .groupBy("term", "s1", "s2", "c_e", "c_t").agg(F.count_distinct("h").alias("texts"), F.count_distinct("near").alias("near"), F.count_distinct("far").alias("far"))
    pairs = pairs.select("term", "c_e", "c_t", "texts", F.least("texts", "near", "far").alias("c_te")).withColumn("d", d)
    pairs = materialise(pairs.withColumn("step", F.floor(-_chance() * _STEPS).cast("int")), "pii_pairs")
    cut = _cut(pairs, alpha)
    met = pairs.filter(F.lit(False) if cut is None else F.col("step") >= cut)
    return met.filter(_told(F.col("d"), threshold, z)).select("term").distinct()


def term_words(docs: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """(doc_id, h, told): the words of the (doc_id, h, text) rows, as written, that are disclosing terms."""
    told = materialise(disclosing_terms(docs, threshold, z), "pii_told")
    wanted = told.select(F.xxhash64("term").alias("h1"), "term")
    words = docs.select("doc_id", "h", F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("word")).withColumn("term", F.lower("word"))
    near = _may_hold(words.withColumn("h1", F.xxhash64("term")), wanted)
    return near.join(wanted, ["h1", "term"]).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("word")).alias("told"))


def _told_spans(text: Column, base: Column, told: Column) -> Column:
    """Spans of the words ``told`` in a text, but for those inside base spans; terms hold no pattern characters."""
    edge = r"[\p{L}\p{N}_'-]"
    pattern = F.concat(F.lit(f"(?<!{edge})(?:"), F.array_join(told, "|"), F.lit(f")(?!{edge})"))
    found = _apart(located(text, pattern, F.lit(len(BASE))), base)
    return F.when(told.isNotNull(), found).otherwise(F.array().cast(_SPAN))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = canonical(df, id_col, text_col)
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def _all(text: Column, told: Column) -> Column:
    """(kind, start, end) of all spans of a text."""
    def spans(base: Column) -> Column:
        return F.transform(F.concat(base, _told_spans(text, base, told)), lambda b: F.struct(
            b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return let(base_spans(text), spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every row; kinds are positions in ``KINDS``.

    Null and empty texts have no spans. Repeated rows get equal spans. Values compare in lower case.
    """
    docs = _keyed(df, id_col, text_col)
    told = materialise(term_words(docs, threshold, z), "pii_words")
    # only texts that may hold a term travel
    some = _may_hold(docs.withColumn("h1", F.col("h")), told.select(F.col("h").alias("h1"))).join(told, ["doc_id", "h"])
    full = some.select("doc_id", "h", _all(F.col("text"), F.col("told")).alias("full")).dropDuplicates(["doc_id", "h"])
    base = docs.select("doc_id", "h", _all(F.col("text"), F.lit(None).cast("array<string>")).alias("base"))
    return base.join(full, ["doc_id", "h"], "left").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), F.coalesce("full", "base").alias("spans"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def base_only() -> Column:
    return F.filter("spans", lambda s: s["kind"] < len(BASE))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, names: Column) -> Column:
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        ordered, start, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            (-s["back"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                                               names[s["kind"]]).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], -s["back"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """``df`` with every span of its texts generalised to its kind, such as ``[EMAIL]``; null texts stay null.

    Overlapping spans become one mark, that of the first.
    """
    docs = _keyed(df, id_col, text_col)
    key, h, terms = fresh(df, "_key", "_h", "_terms")
    found = term_words(docs, threshold, z).select(
        F.col("doc_id").alias(key), F.col("h").alias(h), F.col("told").alias(terms))
    text = F.col(text_col)
    rows = df.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)),
                           h: F.xxhash64(F.coalesce(text, F.lit("")))}).join(found, [key, h], "left")
    spans = _all(text, F.col(terms))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean = F.when(text.isNotNull(), let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(_replaced(text, s, names))))
    return rows.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in df.columns])
