"""Personal data by patterns, and information-theoretic sanitisation of what stands around it; built-in functions only.

Patterns find the protected entities (addresses, numbers). The words of the texts that hold them
are counted over the corpus: with c(e, t) different texts that show term t and
entity e, c(e) texts with e, d(t) texts with t and N texts in all, t reveals log2(c(e,t) N / (c(e) d(t)))
bits of the log2(N / c(e)) bits that e holds. Terms that reveal more than a threshold share are
spans of their own: above the upper threshold they are removed, between both generalised.
Equal texts count once, so that copies do not pass for evidence. An entity that stands in fewer
different texts than are asked for says nothing about its words: that a word is rare there is no sign
that it reveals anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, materialize, small_side
from .spans import SPAN, count_in, located, names_of, replaced

#: Kinds in the order in which spans with one start stand.
KINDS = ("email", "ip", "card", "phone", "term", "trait")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "", "trait": "[TRAIT]"}

# Possessive and anchored forms of the base patterns: the same matches, in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_VALID = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
_LETTER = r"[\p{L}\p{M}\p{N}]"
TERM = _LETTER + "+"

#: Texts that must show an entity and a term together, and shares of an entity's bits.
MIN_TEXTS, GENERALISE, REMOVE = 3, 0.7, 0.9
#: Texts with entities whose terms one task spreads out.
TEXTS_PER_TASK = 256
#: Revealing terms that are looked up inside the rows of the corpus; more are joined with its words.
MAX_TERMS = 50_000


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, doubled(d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The base entities of a text, by start and kind. Matches that fail their test are dropped, not tried again."""
    none = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0)).otherwise(none)
    ip = F.filter(located(text, IP, 1), lambda s: s["value"].rlike(IP_VALID))
    length = lambda s: F.length(_digits(s["value"]))
    card = F.filter(F.filter(located(text, CARD, 2), lambda s: length(s).between(12, 19)), lambda s: _luhn(_digits(s["value"])))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), lambda s: length(s).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def _bare(text: Column, base: Column) -> Column:
    """The text without its entities."""
    return replaced(text, base, lambda x: F.lit(" "))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_texts: int = MIN_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE, max_terms: int = MAX_TERMS, everywhere: bool = False) -> DataFrame:
    """doc_id, key (of the text), base (spans of the patterns) and spans (with those of revealing terms) of every row of docs.

    A span is (start, kind, end, value) with code points from 0, the end exclusive, and kind an
    index of KINDS. Null texts count as empty and have no spans. Repeated rows get the same
    spans; null ids stay; columns other than doc_id and text are ignored; an empty table gives
    an empty result. A revealing term is a span wherever it stands in the texts with its entity;
    everywhere: in all texts. An entity that stands in fewer than min_texts different texts
    reveals nothing about its words, however rare they are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content_key(F.col(text)).alias("key"), whole.alias("text")).withColumn("base", base_spans(F.col("text")))
    terms = F.when(F.size("base") > 0, _words(_bare(F.col("text"), F.col("base"))))
    found = materialize(rows.select("doc_id", "key", "base", terms.alias("words")), "entities")
    spans = found.select("doc_id", "key", "base")
    # Copies share a key; one of each is a text.
    texts = found.where(F.size("base") > 0).groupBy("key").agg(F.first(F.struct("base", "words")).alias("t"))
    entity = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), F.when(x["kind"] >= 2, _digits(x["value"])).otherwise(F.lower(x["value"])))
    texts = materialize(texts.select("key", F.transform("t.base", entity).alias("each"), F.col("t.words").alias("words"), F.array_distinct(F.transform("t.words", F.lower)).alias("terms")), "texts")
    entities = materialize(texts.select(F.explode(F.array_distinct("each")).alias("entity")).groupBy("entity").agg(F.count("*").alias("ce")), "known")
    known = small_side(entities).where(F.col("ce") >= min_texts)
    held = materialize(texts.select("key", "words", "terms", F.explode(F.array_distinct("each")).alias("entity")).join(known, "entity"), "held")
    # A text is one short row with some hundred terms: tasks are dealt by the number of texts, so that each makes about as many rows at any size.
    dealt = held.repartition(-(-held.count() // TEXTS_PER_TASK) or 1, "key", "entity")
    pairs = dealt.select("entity", "ce", F.explode("terms").alias("term")).groupBy("entity", "ce", "term").agg(F.count("*").alias("cet")).where(F.col("cet") >= min_texts)
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return spans.withColumn("spans", F.col("base"))
    # A text with c copies shows its terms c times: rows are counted by c before they meet, and c rows make one text. Texts with entities are counted apart, without them.
    marks = found.groupBy("key").agg(F.count("*").alias("copies"), F.max(F.size("base") > 0).alias("holds")).where("copies > 1 OR holds")
    marks = small_side(materialize(marks, "copies"))
    others = docs.select(content_key(F.col(text)).alias("key"), _words(F.lower(whole)).alias("terms")).join(marks, "key", "left").where(~F.coalesce("holds", F.lit(False)))
    counts = others.select(F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.explode("terms").alias("term")).unionByName(texts.select(F.lit(1).cast("long").alias("copies"), F.explode("terms").alias("term")))
    counts = counts.groupBy("term", "copies").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum(F.expr("n div copies")).alias("dt"))
    n = found.select("key").distinct().agg(F.count("*").alias("n"))
    rated = pairs.join(counts, "term").crossJoin(F.broadcast(n))  # n is one row
    bits = F.log2(F.col("cet") * F.col("n") / (F.col("ce") * F.col("dt")))
    rated = rated.withColumn("share", F.when(F.col("n") > F.col("ce"), bits / F.log2(F.col("n") / F.col("ce"))).otherwise(F.lit(0.0)))
    risky = materialize(rated.where(F.col("share") >= generalise).select("entity", "term", F.when(F.col("share") >= remove, 4).otherwise(5).alias("kind")), "risky")
    hits = _shown(docs.select(content_key(F.col(text)).alias("key"), whole.alias("text")), held, risky, max_terms, everywhere)
    # A term of two entities may have both verdicts: the stricter one counts.
    hits = hits.groupBy("key", "word").agg(F.min("kind").alias("kind")).groupBy("key").agg(F.collect_list(F.struct("word", "kind")).alias("hits"))
    hits = small_side(materialize(hits, "hits"))
    shown = docs.select(content_key(F.col(text)).alias("key"), whole.alias("text")).join(hits, "key")
    pattern = F.concat(F.lit(f"(?<!{_LETTER})(?:"), F.array_join(F.transform("hits", lambda h: h["word"]), "|"), F.lit(f")(?!{_LETTER})"))
    more = F.transform(located(F.col("text"), pattern, 4), lambda x: F.struct(x["start"].alias("start"), F.element_at(F.map_from_entries("hits"), x["value"]).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    out = spans.join(shown.select("key", more.alias("more")).dropDuplicates(["key"]), "key", "left")
    extra = F.filter("more", lambda s: ~F.exists("base", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return out.select("doc_id", "key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", extra))).alias("spans"))


def _shown(texts: DataFrame, held: DataFrame, risky: DataFrame, max_terms: int, everywhere: bool) -> DataFrame:
    """(key, word, kind): the words of texts(key, text) that are revealing terms, of all texts or of those that hold the entity."""
    if not everywhere:
        near = held.select("key", "entity", F.explode("words").alias("word")).withColumn("term", F.lower("word"))
        return near.join(small_side(risky), ["entity", "term"]).select("key", "word", "kind")
    verdicts = materialize(risky.groupBy("term").agg(F.min("kind").alias("kind")), "verdicts")
    if verdicts.count() <= max_terms:
        kinds = {r.term: r.kind for r in verdicts.collect()}  # bounded by max_terms
        if not kinds:
            return texts.where(F.lit(False)).select("key", F.lit("").alias("word"), F.lit(4).alias("kind"))
        removed = [t for t, k in kinds.items() if k == 4]
        mine = F.transform(F.filter(_words(F.col("text")), lambda w: F.lower(w).isin(list(kinds))), lambda w: F.struct(w.alias("word"), F.when(F.lower(w).isin(removed), 4).otherwise(5).alias("kind")))
        return texts.select("key", F.explode(mine).alias("h")).select("key", "h.word", "h.kind")
    shown = texts.select("key", F.explode(_words(F.col("text"))).alias("word")).withColumn("term", F.lower("word"))
    return shown.join(small_side(verdicts), "term").select("key", "word", "kind")


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return names_of(spans, KINDS)


def count_of(spans: Column, kind: str) -> Column:
    return count_in(spans, KINDS.index(kind))


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, with every span of the text masked: entities by their kind, terms removed, traits generalised. Of overlapping spans the first, then the longest, is masked and the rest of the others with it."""
    spans = personal_data(docs, text, **options).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("_spans"))
    rows = docs.withColumn("_key", content_key(F.col(text))).join(spans.withColumnRenamed("key", "_key"), "_key", "left")
    label = lambda x: F.element_at(F.array(*[F.lit(MASKS[k]) for k in KINDS]), x["kind"] + 1)
    masked = replaced(F.col(text), F.col("_spans"), label)
    return rows.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked)).select(*[F.col(f"`{c}`") for c in docs.columns])
