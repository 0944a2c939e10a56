"""Personal data: base patterns and information-theoretic sanitisation.

Four kinds of base spans are found by patterns. They are the protected entities, by
kind and value. Terms that stand in the same documents can still give an entity away
once it is masked. The corpus tells how strongly: for a term and an entity that meet,
the disclosure is the share of the term's documents that hold the entity, ``doubt``
documents without it added, and the information is log2 of that share over the entity's
share of all documents. Pairs that reach both thresholds are disclosing; in documents
that hold the entity the term is masked. With the usual thresholds a term that stands
with one entity alone discloses it, were it in a single document. Entities in so many
documents that no share gives the bits have no terms. Copies of a text, under one id or
several, count as one document. Words that overlap a base span are no terms.

Terms and entities are counted by their 64-bit hashes. Of the whole corpus only terms
that stand beside an entity are counted, and only those that mostly do meet entities.

All matching runs as pattern functions over whole texts. Single separators within a
card number and single dots within a mail host are first turned into stand-ins of the
same length, so that every pattern is a run over one class of characters: time and
stack stay bounded on long runs.

Defined cases: null and empty texts have no spans; positions count code points, the
end is exclusive; repeated rows count as one document and get the same spans; rows with
a null id count and are judged like any other. Work grows with the length of a text and
its spans, not with their product, in texts of MANY spans and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, materialize

KINDS = ("email", "ip", "card", "phone")
#: Stand-ins for separators within a card number and for dots within a host name.
GAP, DOT, OTHER = "\ue000", "\ue001", "\ue002"
HIDDEN = "\ue003"
WHITE = r"[\x20\x09-\x0D]+"

EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{GAP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What texts without which no match can be have; one cheap look spares the rest.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


SPAN = "struct<kind:string,start:int,end:int,value:string>"
CHUNK, MANY = 128, 64


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value made once, though it is used in a function that is applied to many elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, join) -> Column:
    """For each place of an int array what ``join`` makes of all values before it, beginning with 0.

    By chunks, so that the arrays built step by step stay short.
    """

    def steps(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), _none("int").alias("out"))
        return F.aggregate(part, begin, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / CHUNK).cast("int"), F.lit(0))), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))

    def scanned(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: join(a, x)))
        return F.flatten(F.zip_with(chunks, steps(totals, F.lit(0)), steps))

    return _with(values, lambda v: _with(chunked(v), scanned))


def _cut(text: Column, pattern: str, kind: str, valid) -> Column:
    """Spans of ``pattern``: the pieces between matches give the places."""

    def span(x: Column, at: Column) -> Column:
        start = at + x["p"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

    def spans(zipped: Column) -> Column:
        before = _scan(F.transform(zipped, lambda x: x["p"] + F.length(x["m"])), lambda a, x: a + x)
        return F.filter(F.zip_with(zipped, before, span), lambda s: valid(s["value"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.filter(F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p"))), lambda x: x["m"].isNotNull())
    return _with(zipped, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def _parts_small(value: Column) -> Column:
    """Every part at most 255; leading zeros don't count."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind as in KINDS, then start."""
    clean = F.coalesce(text, F.lit(""))
    safe = F.when(clean.rlike(f"[{GAP}{DOT}]"), F.translate(clean, GAP + DOT, OTHER + OTHER)).otherwise(clean)
    hosts = F.regexp_replace(safe, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    runs = F.regexp_replace(safe, r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    none = _none()
    anything = lambda m: F.lit(True)
    return F.concat(
        F.when(F.contains(safe, F.lit("@")), _cut(hosts, EMAIL, "email", anything)).otherwise(none),
        F.when(safe.rlike(r"[0-9]\.[0-9]"), _cut(safe, IP, "ip", _parts_small)).otherwise(none),
        F.when(runs.rlike(rf"[0-9][0-9{GAP}]{{15}}"), _cut(runs, CARD, "card", _luhn)).otherwise(none),
        F.when(F.contains(safe, F.lit("+")), _cut(safe, PHONE, "phone", lambda m: F.length(_digits(m)).between(8, 15))).otherwise(none),
    )


def _entity(span: Column) -> Column:
    """Hash of a span's kind and value, the value without separators or letter case."""
    bare = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(F.translate(span["value"], DOT, ".")))
    return F.xxhash64(span["kind"], bare)


def _terms(text: Column) -> Column:
    """Hashes of the distinct words without their outer punctuation, lower-cased."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+[^\p{L}\p{N}]*|[^\p{L}\p{N}]+(?=[\x20\x09-\x0D]|$)"), lambda w: w != ""))
    return F.transform(words, lambda w: F.xxhash64(w))


def _rebuilt(text: Column, spans: Column, shown) -> Column:
    """The text with ``shown(span)`` for each span; one that begins inside an earlier one only extends what is hidden."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put_together(ordered: Column, cut) -> Column:
        reach = _scan(F.transform(ordered, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        pieces = F.zip_with(ordered, reach, lambda s, r: F.when(s["start"] >= r, F.concat(cut(r, s["start"] - r), shown(s))).otherwise(""))
        last = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(last, F.length(text) - last))

    def by_signs(o: Column) -> Column:
        return _with(F.split(text, ""), lambda signs: put_together(o, lambda at, n: F.array_join(F.slice(signs, at + 1, n), "")))

    # Cutting a string goes through it from its start; for many spans its signs are cut from an array.
    few = _with(ordered, lambda o: put_together(o, lambda at, n: F.substring(text, at + 1, n)))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) < MANY, few).otherwise(_with(ordered, by_signs))


def _outside(text: Column, spans: Column) -> Column:
    """The text without the words that a base span touches, so that no term comes from them."""
    return F.regexp_replace(_rebuilt(text, spans, lambda s: F.lit(HIDDEN)), rf"[^\x20\x09-\x0D{HIDDEN}]*+{HIDDEN}[^\x20\x09-\x0D]*+", " ")


def _key(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(text).alias("h"), F.hash(text).alias("g")]


#: Rows of two or three numbers that may be broadcast; above it they are joined by shuffling.
BROADCAST_ROWS = 500_000


def _near(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def found_in(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, g, spans, text) of all rows; only rows with spans carry their text along."""
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", *_key(F.col("text")), base_spans(F.col("text")).alias("spans"), "text")
    return rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))


def disclosing(found: DataFrame, documents: DataFrame, share: float = 0.8, bits: float = 3.0, doubt: float = 0.25, text_col: str = "text") -> DataFrame | None:
    """(h, g, terms) of the texts with terms whose disclosure of an entity of the text reaches the thresholds; terms are hashes."""
    texts = materialize(found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("rows")), "texts")
    total = texts.count()
    repeated = texts.where("rows > 1").select("h", "g", "rows")
    holding = found.where(F.size("spans") > 0).groupBy("h", "g").agg(F.first(F.struct("text", "spans")).alias("x"))
    holding = holding.select("h", "g", F.array_distinct(F.transform("x.spans", _entity)).alias("entities"), _terms(_outside(F.col("x.text"), F.col("x.spans"))).alias("terms"))
    holding = materialize(holding, "holding")
    entities = holding.select("h", "g", F.explode("entities").alias("entity"))
    # A share is below 1, so an entity in more than one of 2 ** bits documents can't be disclosed.
    often = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") * F.lit(2.0**bits) < total)
    often = materialize(often, "entities")
    rare = materialize(entities.join(often, "entity").select("h", "g", "entity", "n_entity"), "held")
    own = holding.join(rare.select("h", "g").distinct(), ["h", "g"], "left_semi").select("h", "g", F.explode("terms").alias("term"))
    beside = materialize(own.groupBy("term").agg(F.count(F.lit(1)).alias("n_with")), "beside")
    # Each text counts once: a row of a text that n rows have counts 1 / n.
    rows = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("text", *_key(F.col("text")))
    rows = rows.join(_near(repeated), ["h", "g"], "left").select(F.explode(_terms(F.col("text"))).alias("term"), F.coalesce(1 / F.col("rows"), F.lit(1.0)).alias("part"))
    counted = rows.join(_near(beside.select("term")), "term", "left_semi").groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_term"))
    strong = beside.join(counted, "term").where(F.col("n_with") >= share * (F.col("n_term") + doubt)).select("term", "n_term")
    strong = materialize(strong, "strong")
    met = materialize(own.join(_near(strong), "term").join(rare, ["h", "g"]).select("h", "g", "term", "entity", "n_term", "n_entity"), "met")
    both = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    told = F.log2(F.col("n_both") * F.lit(float(total)) / ((F.col("n_term") + doubt) * F.col("n_entity"))) >= bits
    pairs = both.where((F.col("n_both") >= share * (F.col("n_term") + doubt)) & told).select("entity", "term")
    out = materialize(met.join(pairs, ["entity", "term"]).groupBy("h", "g").agg(F.sort_array(F.collect_set("term")).alias("terms")), "terms")  # words of one text
    discard(texts, holding, often, rare, beside, strong, met)
    return out


def _terms_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with the column ``terms`` by h and g, empty where there are none."""
    small = terms.agg(F.coalesce(F.sum(F.size("terms") + 4), F.lit(0)).alias("n")).first()["n"] <= 4 * BROADCAST_ROWS  # 8 bytes each
    return rows.join(F.broadcast(terms) if small else terms, ["h", "g"], "left").withColumn("terms", F.coalesce("terms", _none("long")))


def sanitised(documents: DataFrame, share: float = 0.8, bits: float = 3.0, doubt: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``text`` (null without base spans), ``base`` spans and ``terms`` (hashes of lower-case words that disclose an entity of the row)."""
    found = materialize(found_in(documents, id_col, text_col), "pii")
    terms = disclosing(found, documents, share, bits, doubt, text_col)
    return _terms_of(found, terms).select(F.col("id").alias(id_col), "text", F.col("spans").alias("base"), "terms")


def term_spans(text: Column, terms: Column) -> Column:
    """Where the words stand whose hashes are in ``terms``, as spans of kind ``term``."""
    pieces = F.split(text, WHITE, -1)
    gaps = F.regexp_extract_all(text, F.lit(WHITE), F.lit(0))
    zipped = F.zip_with(pieces, gaps, lambda w, g: F.struct(w.alias("w"), (F.length(w) + F.coalesce(F.length(g), F.lit(0))).alias("n")))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(F.regexp_extract(x["w"], r"^[^\p{L}\p{N}]*", 0))
        core = F.regexp_replace(F.regexp_replace(x["w"], r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")
        return F.struct(F.lit("term").alias("kind"), start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"))

    spans = _with(zipped, lambda z: F.zip_with(z, _scan(F.transform(z, lambda x: x["n"]), lambda a, x: a + x), span))
    wanted = F.filter(spans, lambda s: (s["value"] != "") & F.array_contains(terms, F.xxhash64(F.lower(s["value"]))))
    return F.when(F.size(terms) > 0, wanted).otherwise(_none())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, numbers of base spans, digest of base spans, all spans."""
    rows = sanitised(documents)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.col("base"))
    extra = _joined(term_spans(F.col("text"), F.col("terms")))
    spans = F.when(F.coalesce(extra, F.lit("")) == "", base).otherwise(F.concat_ws(",", base, extra))
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def masked(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their base spans replaced by ``[KIND]`` and disclosing terms by ``[TERM]``; other columns stay."""
    found = materialize(found_in(documents, id_col, text_col), "pii")
    terms = disclosing(found, documents, text_col=text_col)
    discard(found)
    # All columns in one, so that none can clash with ours.
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _terms_of(rows.select("row", "text", *_key(F.col("text"))), terms)
    rows = rows.select("row", "text", F.concat(base_spans(F.col("text")), term_spans(F.col("text"), F.col("terms"))).alias("spans"))
    new = _rebuilt(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rows = rows.select("row", F.when(F.size("spans") > 0, new).otherwise(F.col("row")[text_col]).alias("new"))
    return rows.select(*(F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in documents.columns))
