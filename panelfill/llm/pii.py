"""Personal data: patterns, and terms that disclose what the patterns protect, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfill.session import stored

KINDS = ("email", "ip", "card", "phone")
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GENERALISE = 0.85
REMOVE = 0.95
FILTER_BITS = 22
IDENTIFIERS = 8
BITS = 7

# The base patterns, written so that no text makes them go back: a run of characters that a match may begin with
# is entered at its first character or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a cheap test first: texts that fail it hold no match
HINTS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, valid) -> Column:
    """Array of (start, end, match) of a pattern: code points, end exclusive; places from the gaps between matches."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("found"))

    def step(state, p):
        begin = state["at"] + F.length(p["gap"])
        end = begin + F.length(F.coalesce(p["match"], F.lit("")))
        span = F.struct(begin.alias("start"), end.alias("end"), p["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(p["match"].isNotNull() & valid(p["match"]), F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(pairs, start, step, lambda state: state["found"])


def base_spans(docs: DataFrame) -> DataFrame:
    """Add one array of (start, end, match) for each kind; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    for kind in KINDS:
        found = F.when(F.rlike(text, F.lit(HINTS[kind])), _spans(text, PATTERNS[kind], lambda m, kind=kind: _valid(kind, m)))
        docs = docs.withColumn(kind, F.coalesce(found, none))
    return docs


def _value(kind: Column, match: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(match)).when(kind == "ip", match).otherwise(_digits(match)))


def _term(word: Column) -> Column:
    """A word as a term: lower case without marks at its ends, if at least three letters or digits are left."""
    bare = F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(F.length(bare) >= 3, bare)


def _terms(text: Column) -> Column:
    """The distinct terms of a text, each once whatever marks stand at the ends of its words."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES))
    return F.array_distinct(F.filter(F.transform(words, _term), lambda t: t.isNotNull()))


def _bits(wanted: DataFrame, column: str) -> DataFrame:
    """A filter of 2 ** ``FILTER_BITS`` bits of the column's values: (word, bits), at most 2 ** (FILTER_BITS - 6) rows at any size."""
    place = wanted.select(F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)).alias("place"))
    return place.groupBy(F.shiftright("place", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("_bits"))


def _passing(rows: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean: false only where the column's value is not in ``wanted``; the fuller the filter, the more pass."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    joined = rows.join(F.broadcast(_bits(wanted, column)), F.shiftright(place, 6) == F.col("_word"), "left")
    return joined.withColumn(name, F.coalesce(F.getbit("_bits", place.bitwiseAND(F.lit(63))) == 1, F.lit(False))).drop("_word", "_bits")


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, by Stirling's series beyond 20."""
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(
        n * F.log(n.cast("double")) - n + 0.5 * F.log(6.283185307179586 * n) + 1 / (12 * n)
    )


def disclosure(total: int, incidences: int) -> Column:
    """How much of a protected value's information a term gives away, from ``both``, ``n_term``, ``n_value``, ``alike``, ``terms``, ``held``.

    A term of ``n_term`` documents meets the value's documents, which hold ``held`` of all ``incidences`` of a term in a
    document, ``both`` times by chance with a Poisson probability; ``terms`` terms of that many documents exist, so that
    probability times ``terms`` of them are expected to, with two standard deviations above, and ``alike`` of them do. The share
    beyond chance, times both / n_term, is a lower bound of the probability of the value where the term stands. Of many terms
    with the same numbers, as in copies of one text, ``IDENTIFIERS`` may belong to the value, so each has their share of the
    probability only. The result is its pointwise mutual information over the information of the value, 0 to 1; of that, what
    tells the value from more than 2 ** ``BITS`` others is not counted, so that the result does not rise with the corpus.
    """
    rate = F.col("n_term") * F.col("held") / F.lit(float(max(1, incidences)))
    expected = F.col("terms") * F.exp(F.col("both") * F.log(rate) - rate - _log_factorial(F.col("both")))
    chance = F.least(F.lit(1.0), (expected + 2 * F.sqrt(expected)) / F.col("alike"))
    probability = (1 - chance) * F.least(F.lit(1.0), F.lit(float(IDENTIFIERS)) / F.col("alike")) * F.col("both") / F.col("n_term")
    worth = F.least(F.lit(float(BITS)), F.log2(F.lit(float(total)) / F.col("n_value")))
    return F.when((worth > 0) & (probability > 0), F.greatest(F.lit(0.0), 1 + F.log2(probability) / worth)).otherwise(0.0)


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, disclosure): how much of a protected value's information a term gives away at most, over all documents.

    Numbers of documents are counted over whole texts; see :func:`disclosure` for what they say. One chance meeting says
    nothing where such meetings are as many as chance gives, and something where they are not; repeated ones say much. Values
    of the same documents share their numbers, and are counted as one.
    """
    holds = stored(found.select("key", F.explode("mentions").alias("m")).select("key", "m.value").distinct(), "holds")
    values = holds.groupBy("value").agg(F.count("*").alias("n_value"), F.bit_xor(F.xxhash64("key")).alias("same"))
    alike = holds.join(values, "value").select("key", "n_value", "same").distinct()
    alike = alike.groupBy("key").agg(F.collect_list(F.struct("n_value", "same")).alias("alike"))
    pairs = found.select("key", _terms(F.col("text")).alias("terms")).join(alike, "key")
    pairs = pairs.select(F.explode("alike").alias("v"), "terms").select("v.*", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("n_value", "same", "term").agg(F.count("*").alias("both"))
    seen = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    seen = stored(seen, "seen")
    spectrum = stored(seen.groupBy("n_term").agg(F.count("*").alias("terms")), "spectrum")
    incidences = spectrum.agg(F.sum(F.col("n_term") * F.col("terms"))).first()[0] or 0
    counted = stored(pairs.join(seen, "term"), "counted")
    held = counted.groupBy("same").agg(F.sum("both").alias("held"))
    kinds = counted.groupBy("same", "n_value", "both", "n_term").agg(F.count("*").alias("alike"))
    kinds = kinds.join(spectrum, "n_term").join(held, "same").withColumn("disclosure", disclosure(docs.count(), incidences))
    told = stored(kinds.filter(F.col("disclosure") >= GENERALISE).select("same", "n_value", "both", "n_term", "disclosure"), "kinds")
    return counted.join(told, ["same", "n_value", "both", "n_term"]).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _placed(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """(key, terms): every place of a telling term, in all documents.

    Terms, and then texts, are chosen by a filter where they are read, so that only few of them are shuffled.
    """
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    words = texts.select("key", F.explode(_terms(F.col("text"))).alias("term"))
    hits = _passing(words, "term", telling, "maybe").filter("maybe").select("key", "term").join(telling, "term")
    hits = stored(hits.groupBy("key").agg(F.collect_set(F.struct("term", "disclosure")).alias("hits")), "hits")
    chosen = _passing(texts, "key", hits, "maybe").filter("maybe").drop("maybe").join(hits, "key").dropDuplicates(["key"])
    chosen = chosen.withColumn("told", F.map_from_entries("hits"))
    spans = _spans(F.col("text"), WORD, lambda m: F.coalesce(F.map_contains_key("told", F.coalesce(_term(m), F.lit(""))), F.lit(False)))
    action = lambda s: F.when(F.element_at("told", _term(s["match"])) >= REMOVE, "remove").otherwise("generalise")
    return chosen.select("key", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), action(s).alias("action"))).alias("terms"))


def _mentions(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(_value(F.lit(kind), s["match"]).alias("value"), s["start"].alias("start"), s["end"].alias("end")))


def _marks(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("put")))


def _named(kind: str, column: str) -> Column:
    return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with key, base arrays (email, ip, card, phone) and ``terms``: spans (start, end, action) of disclosing words.

    The base table, with only the texts that hold a mention, is written once to the shared folder.
    """
    rows = base_spans(docs.withColumn("key", F.xxhash64("doc_id", "text")))
    rows = rows.withColumn("mentions", F.concat(*map(_mentions, KINDS)))
    rows = rows.select("doc_id", "key", *KINDS, "mentions", F.when(F.size("mentions") > 0, F.col("text")).alias("text"))
    rows = stored(rows, "personal")
    found = rows.filter(F.size("mentions") > 0).select("key", "mentions", "text").dropDuplicates(["key"])
    spans = _placed(docs, stored(disclosing(docs, found), "telling"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    joined = rows.join(spans, "key", "left").withColumn("terms", F.coalesce("terms", none))
    clear = F.filter("terms", lambda t: ~F.exists("mentions", lambda m: (t["start"] < m["end"]) & (m["start"] < t["end"])))
    return joined.withColumn("terms", clear)


def _joined(arrays: list[tuple[str, str]]) -> Column:
    return F.array_join(F.concat(*[_named(kind, column) for kind, column in arrays]), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans are the patterns' leftmost matches, by kind; the method adds spans of kind ``term``: words whose
    co-occurrence with a protected value over the whole corpus, beyond what chance gives, gives away at least ``GENERALISE``
    of its information (:func:`disclosure`), wherever they stand. They are generalised, or removed from ``REMOVE`` on. Values
    and terms are counted by aggregates that combine in the tasks first; pairs are formed of a value and the terms of the
    texts that hold it. What is broadcast are filters of 2 ** ``FILTER_BITS`` bits, 1 MB at any size of the input.

    Null text counts as empty and has no spans. Rows that repeat doc_id and text count once as evidence and get the same
    answer each. An empty table gives an empty table; further columns are ignored.
    """
    rows = find_spans(docs.select("doc_id", "text"))
    base = [(k, k) for k in KINDS]
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined([*base, ("term", "terms")]).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with each base span as its kind in brackets, generalised terms as [TERM], and removed terms gone.

    Spans that overlap leave the text together, under the name of the one that starts first, the longer of two that
    start together. All columns and all
    rows of ``docs`` are kept; a null text stays null. Only documents that have a span, and few others that a filter lets
    pass, are shuffled.
    """
    marked = find_spans(docs.select("doc_id", "text")).select(
        "key",
        F.sort_array(
            F.concat(
                *map(_marks, KINDS),
                F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("put"))),
            )
        ).alias("marks"),
    )
    marked = stored(marked.filter(F.size("marks") > 0).dropDuplicates(["key"]), "marks")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _passing(rows, "key", marked, "maybe")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, m):
        part = F.substring(F.col("text"), state["at"] + 1, m["start"] - state["at"])
        return F.when(m["start"] < state["at"], F.struct(F.greatest(state["at"], -m["back"]).alias("at"), state["parts"].alias("parts"))).otherwise(F.struct((-m["back"]).alias("at"), F.concat(state["parts"], F.array(part, m["put"])).alias("parts")))

    clean = F.aggregate("marks", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    hit = rows.filter("maybe").join(marked, "key", "left")
    hit = hit.select(F.when(F.col("marks").isNotNull(), F.col("row").withField("text", clean)).otherwise(F.col("row")).alias("row"))
    return rows.filter("NOT maybe").select("row").unionByName(hit).select("row.*")
