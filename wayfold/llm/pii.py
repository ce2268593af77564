"""Information-theoretic removal of personal data. DataFrame operations only.

Emails, addresses, cards, phone numbers and credentials (keys, tokens and passwords behind their label, or of a published form) are
found by pattern and are the protected entities. Then co-occurrence over the corpus says what else reveals them. A term t discloses an
entity e if all of these hold, n(t), n(e) and n(t, e) being numbers of rows:

* the lower confidence bound (``Z`` deviations, Wilson's) on p(e | t) is ``GENERALISE`` or more: seeing t leaves at most one bit about e;
* that bound gives at least ``GAIN`` bits over p(e): it is eight times as likely with t, so what every eighth row holds is nobody's secret;
* chance does not explain it: of all pairs of a term of t's frequency and an entity of e's, were each occurrence of the term dealt to a
  row in proportion to its number of terms, fewer than ``CHANCE`` would be expected to meet so often (Chernoff's bound on the binomial tail);
* at most ``ALIKE`` terms stand to e exactly as t does, with equal n(t) and n(t, e). Counts cannot tell such terms apart, and
  the rare words of one document, or of copies of it, are many where names are few.

Each looks at e's own rows and at t's own frequency, so thresholds do not drift as a corpus grows. Disclosing terms become
their class (a number, a name, a word); those whose bound is ``REMOVE`` or more go, in every row that holds them. Both sides of the
co-occurrence are counted over whole documents, their entities left out. The digest of base spans covers the first four kinds only.

Places come from cutting a text at a pattern: the lengths of gaps and matches add up to code point offsets. Patterns are written so that
they neither rescan runs nor recurse, and each runs only on texts that can hold a match: once for what discloses, once for the result
(a copy of the texts with their spans would save the second and cost more disk than the input). Document frequencies cover all documents:
terms are counted in texts as they are, and rows with entities, which are written, give what the entities add to or take from the
counts. Rows are named by a hash of their text, and texts shuffle only if the rows' disclosing terms exceed a broadcast.
Two steps keep pairs few and lose none: entities that occur in the same rows are one class, and a term in more documents than could
still disclose an entity (``most_documents``) does not meet it.

Defined results: a null text counts as empty; equal texts are judged alike, and each row counts; terms are looked for
outside base spans; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import broadcast_by_bytes, materialize, text_of

#: In the order in which equal starts are listed. The patterns equal the plain ones in meaning: possessive groups where
#: nothing follows that could need the characters back, and a run is entered at its start or after a match.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET_KIND, TERM_KIND = 4, 5
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words before a credential, and the published forms of some that need no word before them.
LABELLED = r"(?i:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?token|access[_-]?token|token|secret|passwd|password|pwd|bearer)"
FORMS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+"
#: Of a labelled credential at least eight characters, a letter and a digit among them.
SECRET = (
    r"(?<![A-Za-z0-9_+/.-])(?:(?<=[:=][\x20\x09]{0,3}[\x22\x27]?)(?<=" + LABELLED + r"[\x22\x27]?[\x20\x09]{0,3}[:=][\x20\x09]{0,3}[\x22\x27]?)"
    r"(?=[A-Za-z_+/=.-]*+[0-9])(?=[0-9_+/=.-]*+[A-Za-z])[A-Za-z0-9_+/=.-]{8,}+|(?:" + FORMS + r")(?![A-Za-z0-9]))"
)
#: What every labelled credential has before it; the sign comes first, as a scan for one sign is quick.
LABEL = r"[:=](?<=" + LABELLED + r"[\x22\x27]?[\x20\x09]{0,3}[:=])"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
TERM = r"[\p{L}\p{N}]{2,}+"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}

#: Bounds on p(entity | term) from which terms are generalised and removed, and the deviations below the estimate at which the bound lies.
GENERALISE, REMOVE, Z = 0.5, 0.9, 1.0
#: Bits that a term must give; terms that chance may be expected to tie to an entity; terms alike among which names cannot be told.
GAIN, CHANCE, ALIKE = 3.0, 0.05, 8

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: Column, pattern, kind: int) -> Column:
    """Spans of a pattern's matches: array<struct<start, kind, end, value>>. Offsets add up in blocks of as many matches as there are
    blocks, as an array that a fold appends to is copied each time."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = _let(gaps, lambda g: F.zip_with(found, F.slice(g, 1, F.size(g) - 1), lambda m, g: F.struct(m.alias("m"), g.alias("g"), F.length(m).alias("n"))))
    none = F.array().cast(_SPAN)

    def span(at: Column, size: Column, value: Column) -> Column:
        return F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + size).alias("end"), value.alias("value"))

    def block(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(none.alias("out"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(F.array_append(acc["out"], span(acc["at"] + x["g"], x["n"], x["m"])).alias("out"), (acc["at"] + x["g"] + x["n"]).alias("at")),
        )

    def joined(all_pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_pairs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / width).cast("int")), lambda k: block(F.slice(all_pairs, k * width + 1, width)))
        spans = F.aggregate(
            blocks,
            F.struct(F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(
                F.array_append(acc["out"], F.transform(x["out"], lambda s: span(acc["at"] + s["start"], s["end"] - s["start"], s["value"]))).alias("out"),
                (acc["at"] + x["at"]).alias("at"),
            ),
            lambda acc: acc["out"],
        )
        return F.when(F.size(all_pairs) > 0, F.flatten(spans)).otherwise(none)

    return _let(pairs, joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    doubled = F.translate(digits, "123456789", "246813579")  # twice each digit, its digits added
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, F.substr(doubled, i, F.lit(1))).otherwise(F.substr(digits, i, F.lit(1))).cast("int"),
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds by start, then kind."""
    none = F.array().cast(_SPAN)
    parts = "".join([rf"^{BYTE}", *[rf"\.{BYTE}"] * 3, "$"])
    email = F.when(F.contains(text, F.lit("@")), _places(text, F.lit(EMAIL), 0)).otherwise(none)
    ip = F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), F.filter(_places(text, F.lit(IP), 1), lambda s: F.rlike(s["value"], F.lit(parts)))).otherwise(none)

    def is_card(s: Column) -> Column:
        d = _digits(s["value"])
        return F.length(d).between(12, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False)

    card = F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), F.filter(_places(text, F.lit(CARD), 2), is_card)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_places(text, F.lit(PHONE), 3), lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none)
    return F.sort_array(F.concat(email, ip, card, phone))


def entity_spans(text: Column) -> Column:
    """Spans of all protected entities by start, then kind: the base kinds and credentials."""
    form = F.contains(text, F.lit("_")) & F.rlike(text, F.lit("gh[pousr]_"))
    for start in ("AKIA", "xox", "sk-", "eyJ"):
        form = form | F.contains(text, F.lit(start))
    secrets = F.when(F.rlike(text, F.lit(LABEL)) | form, _places(text, F.lit(SECRET), SECRET_KIND)).otherwise(F.array().cast(_SPAN))
    return F.sort_array(F.concat(base_spans(text), secrets))


def _entity(span: Column) -> Column:
    """One name for an entity however it is written."""
    plain = F.when(span["kind"] == SECRET_KIND, span["value"]).when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), F.lit(":"), plain)


def _masked() -> Column:
    """The text with spaces for its entities: what is left to disclose them, at the same places. Entities go in blocks, each with
    the piece of the text from the furthest end before it to the furthest end in it."""
    n = F.size("entities")
    width = F.ceil(F.sqrt(n)).cast("int")
    last = F.floor((n - 1) / width).cast("int")

    def furthest(count: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.slice("entities", F.lit(1), count), lambda s: s["end"])), F.lit(0))

    def block(b: Column) -> Column:
        return F.aggregate(
            b["spans"],
            F.struct(F.array().cast("array<string>").alias("out"), b["begin"].alias("at")),
            lambda acc, s: F.struct(
                F.array_append(
                    acc["out"],
                    F.concat(
                        F.substring(b["piece"], acc["at"] - b["begin"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                        F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], acc["at"])),
                    ),
                ).alias("out"),
                F.greatest(s["end"], acc["at"]).alias("at"),
            ),
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(b["piece"], acc["at"] - b["begin"] + 1, F.length(b["piece"]))),
        )

    def bounds(k: Column) -> Column:
        end = F.when(k == last, F.length("text")).otherwise(furthest((k + 1) * width))
        return F.struct(k.alias("k"), furthest(k * width).alias("begin"), end.alias("end"))

    def filled(x: Column) -> Column:
        piece = F.substring(F.col("text"), x["begin"] + 1, x["end"] - x["begin"])
        return F.struct(F.slice("entities", x["k"] * width + 1, width).alias("spans"), x["begin"].alias("begin"), piece.alias("piece"))

    pieces = F.transform(F.transform(F.transform(F.sequence(F.lit(0), last), bounds), filled), block)
    return F.when(n > 0, F.array_join(pieces, "")).otherwise(F.col("text"))


def _terms(text: Column) -> Column:
    """The distinct terms of a whole text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _classes(found: DataFrame) -> DataFrame:
    """row, classes: the entities of each row, those that occur in the same rows as one, with their number of rows n and of terms in them, held."""
    entities = found.select("row", F.size("terms").cast("long").alias("n_terms"), F.explode("names").alias("entity"))
    shared = entities.groupBy("entity").agg(
        F.count("*").alias("n"), F.sum("n_terms").alias("held"), F.min("row").alias("first"), F.max("row").alias("last"), F.bit_xor(F.xxhash64("row")).alias("mix")
    ).where("n > 1")
    shared = materialize(shared.select("entity", F.struct("n", "held", "first", "last", "mix").alias("class")), "pii-shared")
    alone = F.struct(F.lit(1).cast("long").alias("n"), F.col("n_terms").alias("held"), F.col("row").alias("first"), F.col("row").alias("last"), F.xxhash64("row").alias("mix"))
    named = entities.join(broadcast_by_bytes(shared, F.octet_length("entity") + 64), "entity", "left")
    return named.groupBy("row").agg(F.collect_set(F.coalesce("class", alone)).alias("classes"))


def lower_bound(both: Column, term: Column) -> Column:
    """The lower confidence bound on p(entity | term) from the rows that hold the term, and both."""
    return (both + Z * Z / 2 - Z * F.sqrt(both * (term - both) / term + Z * Z / 4)) / (term + Z * Z)


def log_chance(both: Column, term: Column, part: Column, pairs: Column) -> Column:
    """The logarithm of how many of ``pairs`` pairs of a term and an entity, whose rows hold ``part`` of all terms, are expected to meet as often."""
    p = both / term
    rest = F.when(both < term, (1 - p) * F.log((1 - p) / (1 - part))).otherwise(0.0)
    return F.log(pairs) - F.when(p > part, term * (p * F.log(p / part) + rest)).otherwise(0.0)


def most_documents(entity: Column) -> Column:
    """In how many documents a term can be and still disclose an entity: the bound lies below the estimate, and that is at most entity / term."""
    return entity / GENERALISE


def _found(rows: DataFrame) -> DataFrame:
    """Rows with entities: row, names of their entities, terms outside them, raw terms that only the whole text has, new ones that only the rest has."""
    some = rows.where(F.size("entities") > 0).select("row", F.array_distinct(F.transform("entities", _entity)).alias("names"), _terms(_masked()).alias("terms"), _terms(F.col("text")).alias("raw"))
    return materialize(some.select("row", "names", "terms", F.array_except("raw", "terms").alias("raw"), F.array_except("terms", "raw").alias("new")), "pii-found")


def disclosures(rows: DataFrame, found: DataFrame) -> DataFrame:
    """term, share: the highest bound of the entities that a term discloses. ``rows``: row, text; ``found``: those with entities."""
    classes = materialize(_classes(found), "pii-classes")
    top = classes.agg(F.max(F.array_max(F.transform("classes", lambda c: c["n"])))).first()[0] or 1
    plain = rows.select(F.explode(_terms(F.col("text"))).alias("term"), F.lit(1).alias("one"))
    for own, one in (("raw", -1), ("new", 1)):
        plain = plain.unionByName(found.select(F.explode(own).alias("term"), F.lit(one).alias("one")))
    words = materialize(plain.groupBy("term").agg(F.sum("one").alias("n_term")).where("n_term > 0"), "pii-words")
    total, held = max(rows.count(), 1), words.agg(F.sum("n_term")).first()[0] or 1
    counted = words.where(F.col("n_term") <= most_documents(F.lit(top)))
    alike = materialize(counted.groupBy("n_term").agg(F.count("*").alias("n_alike")), "pii-frequencies")
    sizes = materialize(classes.select(F.explode("classes").alias("class")).distinct().groupBy(F.col("class.n").alias("n_entity")).agg(F.count("*").alias("n_like")), "pii-sizes")
    near = found.select("row", F.explode("terms").alias("term")).join(broadcast_by_bytes(counted, F.octet_length("term") + 16), "term")
    near = near.join(broadcast_by_bytes(classes, F.size("classes") * 48 + 16), "row")
    able = F.filter("classes", lambda c: F.col("n_term") <= most_documents(c["n"]))
    pairs = near.select("term", "n_term", F.explode(able).alias("class")).groupBy("class", "term", "n_term").agg(F.count("*").alias("n_both"))
    bound = lower_bound(F.col("n_both"), F.col("n_term"))
    bounded = pairs.withColumn("share", bound).where((F.col("share") >= GENERALISE) & (F.col("share") * total >= F.col("class.n") * 2**GAIN))
    chance = log_chance(F.col("n_both"), F.col("n_term"), F.col("class.held") / float(held), F.col("n_alike") * F.col("n_like"))
    tied = bounded.join(broadcast_by_bytes(alike, F.lit(16)), "n_term").join(broadcast_by_bytes(sizes, F.lit(16)), F.col("class.n") == F.col("n_entity")).where(chance <= math.log(CHANCE))
    told = tied.withColumn("n_same", F.count("*").over(Window.partitionBy("class", "n_term", "n_both"))).where(F.col("n_same") <= ALIKE)
    return told.groupBy("term").agg(F.max("share").alias("share"))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, entities and terms (spans by start), shares, text where there are any spans."""
    text = text_of(docs)
    based = docs.select(docs["doc_id"], F.xxhash64(text).alias("row"), entity_spans(text).alias("entities"), text.alias("text"))
    found = _found(based)
    shares = materialize(disclosures(based, found), "pii-shares")
    told = broadcast_by_bytes(shares, F.octet_length("term") + 16)
    # of rows with entities the terms outside them count, of others all
    own = found.select("row", F.explode("terms").alias("term")).join(told, "term")
    others = based.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(told, "term")
    others = others.join(broadcast_by_bytes(found.select("row"), F.lit(16)), "row", "left_anti")
    hits = own.unionByName(others).groupBy("row").agg(F.collect_set(F.struct("term", "share")).alias("hits"))
    hits = materialize(hits, "pii-hits")
    size = F.aggregate("hits", F.lit(16), lambda n, h: n + F.octet_length(h["term"]) + 24)
    marked = based.join(broadcast_by_bytes(hits, size), "row", "left")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("hits", lambda h: h["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    places = F.when(F.col("hits").isNotNull(), _places(_masked(), pattern, TERM_KIND)).otherwise(F.array().cast(_SPAN))
    some = F.when((F.size("entities") > 0) | F.col("hits").isNotNull(), F.col("text"))
    return marked.select("doc_id", "entities", places.alias("terms"), F.map_from_entries("hits").alias("shares"), some.alias("text"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, clean: texts with entities as labels, disclosing terms generalised or removed. Rows without either give null."""
    found = find(docs)
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS[:TERM_KIND]])

    def put(s: Column) -> Column:
        general = F.when(F.rlike(s["value"], F.lit("^[0-9]+$")), "[NUMBER]").when(F.rlike(s["value"], F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")
        term = F.when(F.element_at("shares", s["value"]) >= REMOVE, "").otherwise(general)
        return F.when(s["kind"] == TERM_KIND, term).otherwise(F.element_at(labels, F.least(s["kind"] + 1, F.lit(TERM_KIND))))

    # of spans that meet, the first stays
    done = F.aggregate(
        F.sort_array(F.concat("entities", "terms")),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.array_append(acc["out"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), put(s))).alias("out"), s["end"].alias("at")),
        ).otherwise(acc),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", done.alias("clean"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; then n_base (the four kinds), n_secret, n_private (both) and n_terms."""
    of = find(docs).withColumn("base", F.filter("entities", lambda s: s["kind"] < SECRET_KIND))
    kinds = F.transform("entities", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(5)]
    n_base, n_private, n_terms = [F.size(c).cast("long").alias(n) for c, n in (("base", "n_base"), ("entities", "n_private"), ("terms", "n_terms"))]
    spans = listing(F.sort_array(F.concat("entities", "terms"))).alias("spans")
    return of.select("doc_id", *counts[:4], F.sha2(listing(F.col("base")), 256).alias("base_sha256"), spans, n_base, counts[4], n_private, n_terms)
