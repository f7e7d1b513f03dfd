"""Personal data by patterns, and by what the corpus shows to give it away; DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. They are the protected entities. What else
discloses them is read from the corpus. Its unit is the distinct text; texts that hold the very same values are one unit, so
neither copies nor near copies of a text count twice. Terms are the words that base spans leave; a word with digits stands
for all of its kind and length, so that tokens and numbers that never repeat have statistics too.

With n(t) units that hold term t, n(t, k) of them with an entity of kind k, and p(k) the share of units with one,
``log(n(t, k) / n(t) / p(k)) / log(1 / p(k))`` is the share of k's information that t gives away: 1 where t never occurs
without such an entity, 0 where it is independent of it. A term discloses k if that share reaches the threshold and chance
can't explain it: n(t) times the divergence of n(t, k) / n(t) from p(k) must exceed the logarithm of the number of
terms and kinds tried over the error allowed, so what is asked of a term grows with the corpus. Disclosing terms get spans of their own
wherever they stand, in any document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

KINDS = ("email", "ip", "card", "phone")
#: What stands for a span in sanitised text.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Share of an entity's information that a term may give away, and the chance that any term of the corpus passes by accident.
DISCLOSURE, ERROR = 0.5, 0.05

#: So many disclosing terms are looked up in each text as one literal; more meet the words of all texts in a join.
LOOKED_UP = 2000

#: The kinds' patterns, anchored so that the engine doesn't try again inside a run that has failed: a run of local
#: characters or digits is tried where it begins (or where the last match ended), and never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]{3,}+"

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column, use: Callable[[Column], Column]) -> Column:
    """array of use(block): ``values`` in about as many blocks as a block has members."""
    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    starts = F.sequence(F.lit(1), F.size(values), size)
    return F.when(F.size(values) > 0, F.transform(starts, lambda at: use(F.slice(values, at, size)))).otherwise(F.array())


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What ``merge`` makes of 0 and all values (array<long>) before each place, and of all values last: one entry more than ``values``.

    Runs in blocks, as appending to an array copies it: the work is a value times the square root of their number.
    """
    zero = F.lit(0).cast("long")

    def scan(array: Column, first: Column) -> Column:
        return F.aggregate(array, F.array(first), lambda done, v: F.concat(done, F.array(merge(F.element_at(done, -1), v))))

    def whole(array: Column) -> Column:
        totals = _blocks(array, lambda block: F.aggregate(block, zero, merge))
        return let(scan(totals, zero), lambda first: F.flatten(F.zip_with(_blocks(array, lambda b: b), first, lambda b, at: F.when(b.isNull(), F.array(at)).otherwise(F.slice(scan(b, at), F.lit(1), F.size(b))))))

    return let(values, whole)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def located(text: Column, pattern: str | Column, kind: str) -> Column:
    """SPAN of the pattern's matches in ``text``, in code points: matches and the gaps between them, summed up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        ends = F.slice(running(sizes, _sum), F.lit(2), F.size(found))
        return F.zip_with(found, ends, lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    return let(F.regexp_extract_all(text, pattern, 0), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(F.array().cast(SPAN)))


def luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda d: d != "")

    def weigh(digit: Column, place: Column) -> Column:
        n = digit.cast("int")
        return F.when(place % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda total, n: total + n) % 10 == 0


def _parts_small(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """SPAN of all kinds, in the order of KINDS, then by place."""
    none = F.array().cast(SPAN)
    digits = text.rlike("[0-9]")
    n_digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    email = F.when(F.contains(text, F.lit("@")), located(text, PATTERNS["email"], "email")).otherwise(none)
    ip = F.when(digits, F.filter(located(text, PATTERNS["ip"], "ip"), lambda s: _parts_small(s["value"]))).otherwise(none)
    card = F.when(digits, F.filter(located(text, PATTERNS["card"], "card"), lambda s: luhn(s["value"]))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(located(text, PATTERNS["phone"], "phone"), lambda s: n_digits(s).between(8, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def _replaced(text: Column, spans: Column, general: Callable[[Column, Column], Column]) -> Column:
    """``text`` with general(kind, size) for each span; of spans that overlap, the first to begin stands for what they cover first, and the others for the rest.

    ``size`` is what a span covers beyond those before it; a span that begins inside another has a null ``kind``. Pieces are cut
    out of blocks, not out of the whole text, as finding a place in a text means counting to it.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cuts(ordered: Column, covered: Column) -> Column:
        def one(s: Column, before: Column) -> Column:
            inside = s["start"] < before
            label = general(F.when(~inside, s["kind"]), F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0)))
            return F.struct(before.alias("low"), F.greatest(s["start"], before).alias("high"), label.alias("label"))

        return F.zip_with(ordered, F.slice(covered, F.lit(1), F.size(ordered)), one)

    def join(block: Column) -> Column:
        base = F.get(block, F.lit(0))["low"]
        chunk = F.substr(text, (base + 1).cast("int"), (F.element_at(block, -1)["high"] - base).cast("int"))
        piece = lambda c, own: F.concat(F.substr(own, (c["low"] - base + 1).cast("int"), (c["high"] - c["low"]).cast("int")), c["label"])
        return let(chunk, lambda own: F.array_join(F.transform(block, lambda c: piece(c, own)), ""))

    def whole(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: s["end"])
        parts = lambda covered: let(cuts(ordered, covered), lambda c: F.array_join(_blocks(c, join), ""))
        return let(running(ends, _most), lambda covered: F.concat(parts(covered), F.substr(text, (F.element_at(covered, -1) + 1).cast("int"))))

    return let(order, whole)


def redact(text: Column, spans: Column) -> Column:
    """Each span replaced by its kind's general term; of spans that overlap, the first to begin names them all."""
    label = F.create_map(*(F.lit(x) for pair in GENERAL.items() for x in pair))
    return F.when(F.size(spans) > 0, _replaced(text, spans, lambda kind, size: F.coalesce(F.try_element_at(label, kind), F.lit("")))).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of its spans, so that all else keeps its place."""
    return F.when(F.size(spans) > 0, _replaced(text, spans, lambda kind, size: F.repeat(F.lit(" "), size.cast("int")))).otherwise(text)


def term_of(word: Column) -> Column:
    """A word in lower case; one with digits as ``#``, whether it has letters too, and its length."""
    shape = F.concat(F.when(word.rlike(r"\p{L}"), F.lit("#x")).otherwise("#d"), F.length(word).cast("string"))
    return F.when(word.rlike(r"\p{N}"), shape).otherwise(F.lower(word))


def words_of(text: Column) -> Column:
    """The distinct words of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))


def unit_counts(texts: DataFrame) -> DataFrame:
    """term, n, n_email, ...: units that hold each term, and those with an entity of each kind; the term "" stands for all units.

    ``texts(text)`` are distinct. A term's units are summed in two steps, so a term of any frequency has partial sums.
    """
    own = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))))
    has = lambda kind: F.exists("spans", lambda s: s["kind"] == kind)
    found = texts.withColumn("spans", base_spans(F.col("text")))
    held = found.select(
        F.when(F.size("spans") > 0, F.md5(F.array_join(own, "\n").cast("binary"))).alias("unit"),
        F.array(*map(has, KINDS)).alias("kinds"),
        F.array_distinct(F.concat(F.array(F.lit("")), F.transform(words_of(blanked(F.col("text"), F.col("spans"))), term_of))).alias("terms"),
    )
    # an inner explode would have the optimiser find all terms before the distinct texts too, to filter rows by them
    by_unit = held.select(F.explode_outer("terms").alias("term"), "unit", "kinds").groupBy("term", "unit", "kinds").agg(F.count(F.lit(1)).alias("texts"))
    one = F.when(F.col("unit").isNull(), F.col("texts")).otherwise(1)
    return by_unit.groupBy("term").agg(F.sum(one).alias("n"), *(F.count_if(F.get("kinds", F.lit(i))).alias(f"n_{k}") for i, k in enumerate(KINDS)))


def disclosing_terms(docs: DataFrame, threshold: float = DISCLOSURE, error: float = ERROR, text_column: str = "text") -> DataFrame:
    """term, kind, n, near, disclosure: the terms of all distinct texts that disclose an entity of ``kind``."""
    counts = cut(unit_counts(docs.select(text_of(text_column).alias("text")).distinct()))
    total = counts.where("term = ''").first()
    tried = max(counts.count() - 1, 1) * len(KINDS)
    known = [(k, total[f"n_{k}"] / total["n"]) for k in KINDS if total and 0 < total[f"n_{k}"] < total["n"]]
    if not known:
        return counts.where("false").select("term", F.lit("").alias("kind"), "n", F.col("n").alias("near"), F.lit(0.0).alias("disclosure"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("near"), F.lit(p).alias("p")) for k, p in known)))
    pairs = counts.where("term != ''").select("term", "n", each.alias("_")).select("term", "n", "_.*").where("near > 0")
    chance, p = F.col("near") / F.col("n"), F.col("p")
    other = F.when(F.col("near") < F.col("n"), (1 - chance) * F.log((1 - chance) / (1 - p))).otherwise(0.0)
    proof = F.col("n") * (chance * F.log(chance / p) + other)
    judged = pairs.withColumn("disclosure", 1 - F.log(chance) / F.log(p)).where((chance > p) & (proof > F.log(F.lit(tried / error))))
    return judged.where(F.col("disclosure") >= threshold).select("term", "kind", "n", "near", "disclosure")


def _key(id_column: str = "doc_id") -> Column:
    """Rows that are equal in id and text are equal in spans, so they may share a key."""
    return F.struct(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"), F.length("text").alias("size"))


def marked(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows(doc_id, text, ...)`` with spans (base, SPAN) and terms (SPAN): every occurrence of one of ``terms`` in what base spans leave."""
    rows = rows.withColumn("spans", base_spans(F.col("text"))).withColumn("left", blanked(F.col("text"), F.col("spans")))
    known = [r.term for r in terms.limit(LOOKED_UP + 1).collect()]
    if not known:
        return rows.withColumn("terms", F.array().cast(SPAN)).drop("left")
    if len(known) <= LOOKED_UP:
        listed = F.array(*map(F.lit, sorted(known)))
        hit = lambda words: F.array_intersect(F.transform(words, term_of), listed)
        forms = let(words_of(F.col("left")), lambda words: let(hit(words), lambda h: F.when(F.size(h) > 0, F.filter(words, lambda w: F.array_contains(h, term_of(w))))))
        rows = rows.withColumn("forms", forms)
    else:
        rows = rows.withColumn("doc_key", _key())
        words = rows.select("doc_key", F.explode(words_of(F.col("left"))).alias("form")).distinct()
        hits = words.join(terms.hint("shuffle_hash"), term_of(F.col("form")) == F.col("term")).groupBy("doc_key").agg(F.collect_set("form").alias("forms"))
        rows = rows.join(hits, "doc_key", "left").drop("doc_key")
    # a form is letters and digits only, so it needs no escape
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("forms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    named = F.transform(located(F.col("left"), pattern, "term"), lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value")))
    return rows.withColumn("terms", F.when(F.size("forms") > 0, named).otherwise(F.array().cast(SPAN))).drop("left", "forms")


def find_spans(docs: DataFrame, threshold: float = DISCLOSURE, error: float = ERROR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, spans (base, SPAN), terms (SPAN): one row per row of ``docs``.

    Null text is empty text, without spans. Null doc_id stays null. Repeated rows each get a row, but their
    texts and entities count once. No rows: no rows. Other columns are ignored. Texts are never cut.
    """
    terms = cut(disclosing_terms(docs, threshold, error, text_column).select("term").distinct())
    return marked(docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")), terms).select("doc_id", "spans", "terms")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and of all spans, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = (F.size("spans") + F.size("terms")).cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, KINDS), every, F.sha2(joined_spans(F.col("spans")), 256).alias("base_sha256"), joined_spans(F.concat("spans", "terms")).alias("spans"))


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE, error: float = ERROR, text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced in ``text_column``; other columns stay, whatever their names. Null text stays null.

    Rows without a span are passed on as they are.
    """
    terms = cut(disclosing_terms(docs, threshold, error, text_column).select("term").distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of(text_column).alias("text"))
    rows = rows.withColumn("doc_id", F.xxhash64("text"))
    clean = redact(F.col("text"), F.concat("spans", "terms"))
    clean = F.when(F.size("spans") + F.size("terms") > 0, clean).otherwise(F.col(f"row.`{text_column}`"))
    return marked(rows, terms).select(*((clean if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
