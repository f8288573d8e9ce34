"""Personal data: fixed patterns, and terms that reveal them by corpus co-occurrence. DataFrame functions only.

Base spans are the matches of four patterns. Each matched value is a protected entity. The words around it are the terms that
may reveal it: over all documents, a term's disclosure of an entity is their normalised pointwise mutual information, from
the number of documents that hold the term, the entity, and both; one document is enough, so a value that stands once is protected
like any other. Terms over the first threshold are generalised, over the second removed: in every document that holds personal data,
and, where at least WIDE documents show the term next to the entity, in all other documents too, with or without the entity. (A single
meeting may be chance, and would have clean texts lose words that tell nothing.)

Defined cases: null is empty and has no spans, and stays null when sanitised; of overlapping spans all are reported, and the sanitised
text replaces their union by the label of the first; equal rows count once for each row and get equal results; rows of null or repeated
doc_id are told apart by their text; an empty table has no rows; `sanitise` keeps other columns, whatever their names; texts may be of
any length; all matching is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked, written

#: Kinds in order and their patterns. Possessive forms of the patterns as documented: they match the same places
#: without backtracking, and a search starts at the front of a run of characters or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds.
GENERAL, REMOVED = "general", "removed"
KINDS = [*PATTERNS, GENERAL, REMOVED]
#: Words on either side of an entity, documents that must show a term next to it before documents without personal data lose it, and
#: the two disclosure thresholds.
NEAR, WIDE, GENERALISE, REMOVE = 5, 3, 0.8, 0.95
#: Parts into which the documents of one term are dealt.
SALTS = 16
_WORD = r"[\p{L}\p{N}]++"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def places(text: Column, pattern: Column | str, kind: int) -> Column:
    """All matches as (start, kind, end, value), in code points, from the lengths of the matches and of what lies between."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    none = F.array().cast(_SPAN)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"])


def _small(part: Column) -> Column:
    digits = F.ltrim(part, F.lit("0"))
    return (F.length(digits) <= 3) & (F.coalesce(F.substring(digits, 1, 3).try_cast("int"), F.lit(0)) <= 255)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i + 1, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    n = F.length(digits)
    return F.when((n < 12) | (n > 19), F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _text (never null) and _key (equal for equal doc_id and text)."""
    docs = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("_key", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "_text"), 256))


def base(docs: DataFrame) -> DataFrame:
    """docs with _text, _key and _base, the spans of the fixed patterns."""
    docs = keyed(docs)
    none = F.array().cast(_SPAN)
    digit = F.col("_text").rlike("[0-9]")
    when = {"email": F.col("_text").contains("@"), "ip": digit, "card": digit, "phone": F.col("_text").contains("+")}
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    good = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), _small),
        "card": lambda s: _luhn(s["value"]),
        "phone": lambda s: digits(s).between(9, 15),
    }
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        docs = docs.withColumn(f"_{kind}", F.filter(F.when(when[kind], places(F.col("_text"), pattern, k)).otherwise(none), good[kind]))
    return docs.withColumn("_base", F.array_sort(F.concat(*[f"_{k}" for k in PATTERNS]))).drop(*[f"_{k}" for k in PATTERNS])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def near(found: DataFrame, width: int = NEAR) -> DataFrame:
    """Distinct (key, entity, term): the words next to each entity of each document."""
    reach = 40 * width
    one = found.where(F.size("_base") > 0).select("_key", "_text", F.explode("_base").alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    lead = F.concat(F.substring("_text", F.greatest(start - reach, F.lit(0)) + 1, start - F.greatest(start - reach, F.lit(0))))
    left, right = _words(lead), _words(F.substring("_text", end + 1, F.lit(reach)))
    # The reach may cut the outermost word. Where too few whole words are within it, all of that side is read.
    left = F.when(start <= reach, left).when(F.size(left) > width, F.slice(left, 2, F.size(left) - 1)).otherwise(_words(F.substring("_text", F.lit(1), start)))
    right = F.when((F.length("_text") <= end + reach) | (F.size(right) > width), right).otherwise(_words(F.substring("_text", end + 1, F.length("_text"))))
    left = F.slice(left, F.greatest(F.size(left) - width + 1, F.lit(1)), F.lit(width))
    terms = F.concat(left, F.slice(right, 1, width))
    out = one.select("_key", F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value")).alias("entity"), F.explode(terms).alias("term"))
    return out.where(F.col("term").rlike(r"\p{L}")).distinct()


def holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (_key, and the columns of terms) of the documents (_key, _text) that hold a term; a frequent term's are dealt into parts."""
    words = docs.select("_key", F.explode(F.array_distinct(_words(F.col("_text")))).alias("term"))
    words = words.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return words.join(salted, ["term", "_salt"]).drop("_salt").distinct()


def disclosure(docs: DataFrame, protected: DataFrame, context: DataFrame, least: float = GENERALISE) -> DataFrame:
    """(entity, term, beside, strength): normalised pointwise mutual information over all documents, of pairs with at least `least`.

    protected holds the documents with personal data (_key, _text, _base), context the pairs of near; beside counts the documents of a pair.
    """
    pairs = context.groupBy("entity", "term").agg(F.count("*").alias("beside"))
    own = context.select("_key", "entity").distinct()
    entities = own.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Summed in each task before it is shuffled, then joined to the terms of interest.
    terms = docs.select(F.explode(F.array_distinct(_words(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
    terms = terms.groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("total"))

    def strength(both: Column) -> Column:
        pmi = F.log(both * F.col("total") / (F.col("n_term") * F.col("n_entity")))
        return F.when(both < F.col("total"), pmi / -F.log(both / F.col("total"))).otherwise(F.lit(0.0))

    # Strength grows with the documents that hold both, which are no more than those of either: other pairs cannot reach `least`.
    pairs = terms.join(pairs, "term").join(entities, "entity").crossJoin(F.broadcast(total))
    pairs = written(pairs.where(strength(F.least("n_term", "n_entity")) >= least - 1e-9), "pii-pairs")
    # Documents that hold an entity and a term, wherever they stand in it.
    both = holding(protected, pairs.select("term").distinct()).join(own, "_key").groupBy("entity", "term").agg(F.count("*").alias("both"))
    found = both.join(pairs, ["entity", "term"]).select("entity", "term", "beside", strength(F.col("both")).alias("strength"))
    return found.where(F.col("strength") >= least)


def spans(docs: DataFrame, width: int = NEAR, wide: int = WIDE, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with _text, _base and _spans (base spans and those of the method, by start and kind)."""
    protected = written(base(docs.select("doc_id", "text")).where(F.size("_base") > 0).select("_key", "_text", "_base"), "pii-protected")
    context = written(near(protected, width), "pii-context")
    strong = disclosure(docs, protected, context, generalise).groupBy("term")
    strong = written(strong.agg(F.max("strength").alias("strength"), F.max(F.when(F.col("beside") >= wide, F.col("strength"))).alias("everywhere")), "pii-strong")
    # What all documents lose, and what those with personal data lose besides.
    every = holding(keyed(docs.select("doc_id", "text")), strong.where("everywhere IS NOT NULL").select("term", F.col("everywhere").alias("strength")))
    terms = every.unionByName(holding(protected, strong.select("term", "strength")))
    words = F.array_sort(F.collect_list(F.struct("term", "strength")))
    terms = terms.groupBy("_key", "term").agg(F.max("strength").alias("strength")).groupBy("_key").agg(words.alias("_terms"))
    terms = written(terms, "pii-terms")
    # Only documents that may have terms are moved.
    rows = marked(keyed(docs), "_key", terms.select("_key"))
    alone = base(rows.where("NOT _maybe").drop("_maybe")).withColumn("_terms", F.lit(None).cast(terms.schema["_terms"].dataType))
    rows = base(rows.where("_maybe").drop("_maybe")).join(terms.withColumnRenamed("_key", "_own"), F.col("_key") == F.col("_own"), "left").drop("_own").unionByName(alone)

    def chosen(low: float, high: float) -> Column:
        return F.transform(F.filter("_terms", lambda x: (x["strength"] >= low) & (x["strength"] < high)), lambda x: x["term"])

    none = F.array().cast(_SPAN)
    out = F.col("_base")
    for kind, low, high in ((GENERAL, generalise, remove), (REMOVED, remove, 9.0)):
        words = chosen(low, high)
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        out = F.concat(out, F.when(F.size(words) > 0, places(F.col("_text"), pattern, KINDS.index(kind))).otherwise(none))
    return rows.withColumn("_spans", F.array_sort(out)).drop("_key", "_terms")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of text generalised to its label or removed; n_chars, where there is one, follows the text."""
    labels = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")])
    packed = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = spans(packed, **options)

    def add(state: Column, s: Column) -> Column:
        text, start = F.col("_text"), F.greatest(s["start"], state["at"])
        kept = F.substring(text, state["at"] + 1, start - state["at"])
        label = F.when(s["start"] >= state["at"], F.get(labels, s["kind"])).otherwise(F.lit(""))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], kept, label).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.length("_text")))
    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, rest)
    new = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    rows = rows.select("row", new.alias("text"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)

    return rows.select(*[column(c) for c in docs.columns])
