"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, case is
folded and punctuation falls away. Windows of ``window`` template words of documents are
hash-joined with those of the benchmark, so a question with other numbers or names is
still found; windows of plain words are joined beside them, so verbatim passages need no
placeholder. Each alignment of a passage with an item that a window tells of is compared
with the whole item: a word fits that is the same or fills a placeholder of its kind.
Along an alignment each filling of the item must answer to one filling of the document;
windows that hold one with two answers are left out unless they are verbatim. Two fillings
of the item may well become one of the document: two numbers of a question may turn out
equal once they are changed. A document is contaminated by an item when the windows that
remain cover ``percent`` of the item's.

Few documents hold anything of a benchmark, so all are first searched for short runs of
plain words: of each window of an item one run of up to RUN words without a placeholder,
the one of the lowest hash, which every text that matches the window has word by word.
Only documents that have one of the runs become templates.

Defined cases: null and empty texts match nothing; items without words are ignored;
items shorter than a window are taken as one window of their own length, those of fewer
than ``least`` words without placeholders; items of the same template and words stand
under the smallest id; rows with the same id are judged each by its own text; rows with
a null id are never contaminated; an item window of placeholders alone has no run, and all
documents become templates then. The best item is that of the highest share, then of the
smallest id.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Units of measure that a number may carry; fixed values.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "kmh", "mph", "usd", "eur", "percent", "dollars", "euros", "hours", "minutes", "seconds", "days", "weeks", "years", "meters", "miles")
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Benchmark windows that may be broadcast; above it the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Words of the longest runs, and how many runs may stand in the plan; above it they are joined.
RUN, PLANNED_RUNS = 4, 50_000


def _bare(text: Column) -> Column:
    """The text without placeholders and punctuation, a space before each word, letters as they were."""
    clean = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), r"[\x01-\x03!-/:-@\[-`{-~]+", "")
    return F.rtrim(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", " "))


def _folded(text: Column) -> Column:
    """Case-folded, also the sharp s and the final sigma, which capitals spell otherwise."""
    return F.replace(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), F.lit("\u03c2"), F.lit("\u03c3"))


def _template(bare: Column) -> Column:
    """The template of a text that ``_bare`` has prepared.

    A name is a word of a capital and a small letter, wherever it stands; a number is a
    word of digits, with or without a unit; a unit follows one.
    """
    units = "|".join(UNITS)
    named = _folded(F.regexp_replace(bare, r" \p{Lu}\p{Ll}[^ ]*", f" {NAME}"))
    numbered = F.regexp_replace(named, rf" [0-9]+(?:{units})?(?![^ ])", f" {NUMBER}")
    return F.when(bare.rlike(" [0-9]"), F.regexp_replace(numbered, rf"{NUMBER} (?:{units})(?![^ ])", f"{NUMBER} {UNIT}")).otherwise(named)


def _words(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(text, F.lit(2)), " "))


def templated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, template, plain): word arrays of equal length, plain holding what fills the placeholders."""
    rows = df.select(F.col(id_col).alias("id"), _bare(F.col(text_col)).alias("_s"))
    rows = rows.select("id", _template(F.col("_s")).alias("_t"), _folded(F.col("_s")).alias("_p"))
    return rows.select("id", _words(F.col("_t")).alias("template"), _words(F.col("_p")).alias("plain"))


def windows(rows: DataFrame, sizes: list[int], least: int) -> DataFrame:
    """(id, size, at, hash) of all windows of each size, in each of their readings.

    A window is read plainly, with numbers and units as placeholders, with names too, and
    with all but a name in its first place, where a passage may begin in either case.
    Windows of fewer than ``least`` words are read plainly only. Hashes of four words each
    are put together, so that a window costs little more than a word.
    """
    rows = rows.select("id", "template", F.transform("plain", lambda w: F.xxhash64(w)).alias("p1"))
    typed = lambda *kinds: F.zip_with("template", "p1", lambda t, p: F.when(t.isin(*kinds), F.xxhash64(t)).otherwise(p))
    rows = rows.select("id", "p1", typed(NUMBER, UNIT).alias("n1"), typed(NAME, NUMBER, UNIT).alias("t1"))
    four = lambda r: F.transform(f"{r}1", lambda h, i: F.xxhash64(h, *(F.get(f"{r}1", i + k) for k in (1, 2, 3)))).alias(f"{r}4")
    rows = rows.select("*", *(four(r) for r in "pnt"))

    def whole(size: int, first: str, rest: str) -> Column:
        far = [*range(1, size - 4, 4), size - 4] if size > 4 else range(1, size)
        parts = lambda i: [F.get(f"{rest}{4 if size > 4 else 1}", i + k) for k in far]
        return F.transform(F.slice(f"{first}1", F.lit(1), F.greatest(F.size(f"{first}1") - size + 1, F.lit(0))), lambda h, i: F.xxhash64(h, *parts(i)))

    kinds = {size: ("pp", "nn", "tt", "nt") if size >= least else ("pp",) for size in sizes}
    rows = rows.select("id", *(whole(size, *k).alias(f"{k}{size}") for size in sizes for k in kinds[size]))

    def new(size: int, kind: str, others: tuple[str, ...]) -> Column:
        """Windows of one reading whose hash no other reading has."""
        row = lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("at"), h.alias("hash"))
        if not others:
            return F.transform(f"{kind}{size}", row)
        differs = lambda h, i: functools.reduce(Column.__and__, (h != F.get(f"{o}{size}", i) for o in others))
        return F.filter(F.transform(f"{kind}{size}", lambda h, i: F.when(differs(h, i), row(h, i))), lambda x: x.isNotNull())

    readings = {"pp": (), "nn": ("pp",), "tt": ("nn",), "nt": ("nn", "tt")}
    found = [new(size, k, readings[k]) for size in sizes for k in kinds[size]]
    # Outer: else a filter on the sum of all these arrays is made and pushed down into each of them.
    return rows.select("id", F.explode_outer(F.concat(*found)).alias("w")).select("id", "w.size", "w.at", "w.hash")


def _gram(array: str, k: int) -> Column:
    """Hashes of the k words from each place on; null where there are fewer."""
    rest = lambda i: [F.get(array, i + j) for j in range(1, k)]
    return F.transform(array, lambda h, i: F.when(i <= F.size(array) - k, F.xxhash64(h, *rest(i))))


def _all_fixed(k: int) -> Column:
    return F.transform("fixed", lambda f, i: F.forall(F.slice("fixed", i + 1, F.lit(k)), lambda x: x))


def _holds(k: int, runs: list[int]) -> Column:
    return F.coalesce(F.exists(_gram("p", k), lambda g: g.isin(runs)), F.lit(False))


def _tagged(k: int) -> Column:
    return F.transform(_gram("p", k), lambda g: F.struct(F.lit(k).alias("k"), g.alias("run")))


def _runs(items: DataFrame, least: int) -> DataFrame:
    """(k, run) of the item windows; k is 0 for a window of placeholders alone."""
    fixed = F.transform("template", lambda t: ~t.isin(NAME, NUMBER, UNIT) | (F.size("template") < least))
    rows = items.select("length", fixed.alias("fixed"), F.transform("plain", lambda w: F.xxhash64(w)).alias("p"))
    for k in range(1, RUN + 1):
        rows = rows.withColumn(f"g{k}", F.zip_with(_gram("p", k), _all_fixed(k), lambda g, whole: F.when(whole, g)))
    rows = rows.select("length", *(f"g{k}" for k in range(1, RUN + 1)), F.explode(F.sequence(F.lit(0), F.size("p") - F.col("length"))).alias("a"))
    chosen = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("run"))
    for k in range(1, RUN + 1):
        least_of = F.array_min(F.slice(f"g{k}", F.col("a") + 1, F.greatest(F.col("length") - k + 1, F.lit(0))))
        chosen = F.when(least_of.isNotNull(), F.struct(F.lit(k).alias("k"), least_of.alias("run"))).otherwise(chosen)
    return rows.select(chosen.alias("c")).select("c.k", "c.run").distinct()


def _touched(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """The documents (id, h, text) that hold a run of an item window."""
    runs = materialize(_runs(items, least), "runs")
    found = runs.limit(PLANNED_RUNS + 1).collect()  # at most one more than may stand in the plan
    if any(r["k"] == 0 for r in found) or runs.where("k = 0").limit(1).count():
        return docs
    bare = F.regexp_replace(_folded(F.coalesce("text", F.lit(""))), r"[\x01-\x03!-/:-@\[-`{-~]+", "")  # the words of _bare with one pass less
    words = F.split(F.btrim(bare, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    rows = docs.select("id", "h", F.transform(words, lambda w: F.xxhash64(w)).alias("p"))
    sizes = sorted({r["k"] for r in runs.select("k").distinct().collect()})
    if len(found) <= PLANNED_RUNS:
        has = functools.reduce(Column.__or__, (_holds(k, [r["run"] for r in found if r["k"] == k]) for k in sizes))
        # By id, as a filter here would be pushed below the hashes and make them again for each word.
        hit = rows.select("id", "h", has.alias("has")).groupBy("id", "h").agg(F.max("has").alias("has")).where("has")
    else:
        hit = rows.select("id", "h", F.explode_outer(F.concat(*(_tagged(k) for k in sizes))).alias("g")).select("id", "h", "g.k", "g.run").join(runs, ["k", "run"], "left_semi")
    hit = materialize(hit.select("id", "h").distinct(), "touched")
    return docs.join(_near(hit), ["id", "h"], "left_semi")


#: Documents that may be broadcast by id and hash, 16 bytes each; above it they are joined by shuffling.
BROADCAST_IDS = 500_000


def _near(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows are told apart by id and text."""
    text = F.col(f"`{text_col}`")
    return documents.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, h, item, n_hits, n_item_windows): windows of the item that consistent alignments cover; h is the text's hash."""
    items = templated(benchmark.where(F.col(item_col).isNotNull()), item_col, text_col).where(F.size("template") > 0)
    items = items.groupBy("template", "plain").agg(F.min("id").alias("id")).withColumn("length", F.least(F.size("template"), F.lit(window)))
    items = materialize(items, "items")
    sizes = sorted(r["length"] for r in items.select("length").distinct().collect())  # from 1 to window
    docs = _keyed(documents, id_col, text_col).where("id is not null")
    if not sizes:
        return docs.select("id", "h", *(F.lit(0).cast("long").alias(c) for c in ("item", "n_hits", "n_item_windows"))).limit(0)
    own = functools.reduce(DataFrame.unionByName, (windows(items.where(F.col("length") == size), [size], least) for size in sizes))
    own = own.select(F.col("id").alias("item"), "size", F.col("at").alias("item_at"), "hash")
    if own.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        own = F.broadcast(own)  # 32 bytes each
    touched = _touched(docs, items, least)
    both = touched.select(F.struct("id", "h").alias("id"), "text")
    seeds = windows(templated(both, "id", "text"), sizes, least).join(own, ["hash", "size"])
    seeds = materialize(seeds.select(F.col("id").alias("doc"), "item", (F.col("at") - F.col("item_at")).alias("line")).distinct(), "seeds")
    held = docs.join(_near(seeds.select("doc.id", "doc.h").distinct()), ["id", "h"], "left_semi").select(F.struct("id", "h").alias("id"), "text")
    texts = templated(held, "id", "text").select(F.col("id").alias("doc"), F.col("template").alias("t"), F.col("plain").alias("p")).distinct()
    # Each alignment that a window told of is compared with the whole item, word by word.
    lines = seeds.join(items.withColumnRenamed("id", "item"), "item").join(texts, "doc")

    def word(old: Column, i: Column) -> Column:
        at = F.col("line") + i
        new, kind = F.when(at >= 0, F.get("p", at)), F.get("template", i)
        same = F.coalesce(old == new, F.lit(False))
        slot = F.coalesce((F.size("template") >= least) & kind.isin(NAME, NUMBER, UNIT) & (kind == F.when(at >= 0, F.get("t", at))), F.lit(False))
        return F.struct(i.alias("i"), kind.alias("t"), old.alias("old"), new.alias("new"), same.alias("same"), slot.alias("slot"))

    lines = lines.select("doc", "item", "length", F.transform("plain", word).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    fits = F.filter(starts, lambda a: F.forall(F.slice("words", a + 1, F.col("length")), lambda w: w["same"] | w["slot"]))
    lines = lines.withColumn("fits", fits).where(F.size("fits") > 0)
    covered = lambda i: F.exists(F.slice("fits", F.lit(1), F.size("fits")), lambda a: (a <= i) & (i < a + F.col("length")))
    lines = lines.withColumn("slots", F.filter("words", lambda w: w["slot"] & covered(w["i"])))
    torn = F.filter("slots", lambda s: F.exists("slots", lambda o: (o["t"] == s["t"]) & (o["old"] == s["old"]) & (o["new"] != s["new"])))
    lines = lines.withColumn("torn", F.transform(torn, lambda s: s["i"]))
    verbatim = lambda a: F.forall(F.slice("words", a + 1, F.col("length")), lambda w: w["same"])
    whole = lambda a: ~F.exists("torn", lambda i: (a <= i) & (i < a + F.col("length")))
    lines = lines.withColumn("hits", F.filter("fits", lambda a: verbatim(a) | whole(a)))
    hits = lines.groupBy("doc", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hits")).where("n_hits > 0")
    counts = items.select(F.col("id").alias("item"), (F.size("template") - F.col("length") + 1).cast("long").alias("n_item_windows"))
    return hits.join(counts, "item").select("doc.id", "doc.h", "item", "n_hits", "n_item_windows")


def _best(documents: DataFrame, benchmark: DataFrame, window: int, percent: int, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """(id, h, best, contaminated) of the documents with any hit."""
    found = matches(documents, benchmark, window, id_col=id_col, text_col=text_col, item_col=item_col)
    share = F.col("n_hits") / F.col("n_item_windows")
    best = found.groupBy("id", "h").agg(F.min_by(F.struct("item", "n_hits", "n_item_windows"), F.struct(-share, "item")).alias("best"))
    return best.withColumn("contaminated", 100 * F.col("best.n_hits") >= percent * F.col("best.n_item_windows"))


def judge(documents: DataFrame, benchmark: DataFrame, window: int = 8, percent: int = 60, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: the id, item_id of the best match, n_hits, n_item_windows, contaminated."""
    best = _best(documents, benchmark, window, percent, id_col, text_col, item_col)
    out = _keyed(documents, id_col, text_col).drop("text").join(best, ["id", "h"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.item").alias(item_col),
        F.coalesce("best.n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("best.n_item_windows", F.lit(0)).cast("long").alias("n_item_windows"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 8, percent: int = 60, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows that no item contaminates, all columns as they are."""
    found = _best(documents, benchmark, window, percent, id_col, text_col, item_col).where("contaminated").select("id", "h")
    found = materialize(found, "contaminated").select(F.col("id").alias("_found_id"), F.col("h").alias("_found_h"))
    own = documents[id_col], F.xxhash64(documents[text_col])
    return documents.join(_near(found), (own[0] == F.col("_found_id")) & (own[1] == F.col("_found_h")), "left_anti")
