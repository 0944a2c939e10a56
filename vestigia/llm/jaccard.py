"""Exact Jaccard self-join of word n-gram sets, as classes of linked documents.

A size-aware heavy-light join. Elements have one order for the whole corpus, rare ones
first; a first pass over all texts counts them in a table of CELLS cells for that. In
this order every set gives signatures such that two sets that reach the threshold share
at least one:

* small sets (light): all subsets of a fixed size, here pairs, of the set's first
  ``m + 2`` elements, m being as many as a partner may lack; similar sets share two of
  the elements. Sets so small that one common element links them give single ones too;
* large sets (heavy): the inverted lists of their first ``m + k`` elements. Similar sets
  share the lists of at least k elements, k growing with the set.

``boundary`` tells where small ends: at the least size for which subsets cost more than
lists, by the rows that either takes and the lengths of lists and of subsets' groups
measured in the first pass (second moments of the counts).

Sets then have a number of signatures to share with others before they are looked at:
one of a large set that shares fewer than the k of its smallest partner is linked with
nothing. Documents that have only a passage in common fall short, the more so as the
words of a passage that recurs are not rare, and are left out exactly and before any
set is fetched.

Pairs in a list are never all made. Each list has a leader, the member with the
largest part of its signatures shared (near the middle of its group), and every
member is compared with the leaders of its lists only. What a comparison finds is
kept as the difference from the leader. Two members whose classes are still apart
can then be linked only if their differences overlap enough; elements that no other
member's difference holds can't overlap, so bounds on three counts decide which
pairs are left to compare, and these are compared by their differences. No link is
lost: any two similar sets share a list, and so a leader.

Defined cases: null and empty texts have an empty set and are linked with nothing;
with fewer than ``words`` words the whole sequence is the only element; equal sets
are linked before anything else, so groups of copies cost one set; rows with the
same id count as one document's rows and are returned as they are; rows with a null
id are returned with their size and a null class. ``percent`` is from 1 to 100.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.storage import discard, materialize
from ..plans.workers import lean

#: Cells of the element counts, and of each of the two tables for measuring list lengths.
CELLS, MEASURED = 1 << 18, 1 << 16
#: Sizes over which list lengths are measured, and what meeting one member costs against making a row.
SMALL, MEETING = (4, 64), 0.05
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: How often signatures are counted anew after documents fell short; more rounds only save comparisons.
ROUNDS = 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _odd(at: np.ndarray) -> np.ndarray:
    """Odd factors, one for each place."""
    return _mix(at.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes of the k-word sequences, ascending; A-Z are lower-cased, words end at ASCII white space."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    long = ends - starts
    first = np.cumsum(long) - long
    place = np.arange(first[-1] + long[-1]) - np.repeat(first, long)
    h = _mix(np.add.reduceat(_BYTE[data[inside]] * _odd(np.arange(long.max()))[place], first) + long.astype(np.uint64))
    size = min(n, k)
    factors = _odd(np.arange(size) + 1_000_003)
    mixed = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        mixed += h[i : n - size + 1 + i] * factors[i]
    mixed = np.sort(_mix(mixed))
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def lacking(n: int, percent: int) -> int:
    """The most elements of a set of n that a set linked with it may lack."""
    return n - -(-percent * n // 100)


def sharing(n: int, percent: int) -> int:
    """How many lists a set of n is to share: the more, the longer its part in the lists."""
    m = lacking(n, percent)
    return max(1, min(1 + m // 2, n - m))


def listed(n: int, percent: int) -> int:
    """In how many lists a set of n stands."""
    return lacking(n, percent) + sharing(n, percent)


def moment(counts: np.ndarray) -> float:
    """Mean length of the list that a random entry stands in, from counts by cell with chance meetings taken off."""
    total, cells = float(counts.sum()), len(counts)
    if not total:
        return 1.0
    return max(1.0, ((counts.astype(float) ** 2).sum() - total**2 / cells) / (1 - 1 / cells) / total)


def boundary(percent: int, list_length: float, group_length: float) -> int:
    """The smallest size at which lists cost less than pairs."""
    n = 2
    while True:
        light = math.comb(lacking(n, percent) + 2, 2) * (1 + MEETING * group_length)
        if light > listed(n, percent) * (1 + MEETING * list_length):
            return n
        n += 1


@dataclass(frozen=True)
class Order:
    """The order of elements, rare ones first, and the size from which sets are large."""

    percent: int
    ranks: np.ndarray  # by cell, 16 bits
    edge: int

    def sorted(self, s: np.ndarray) -> np.ndarray:
        return s[np.argsort(self.ranks[s & np.uint64(CELLS - 1)], kind="stable")]

    def signatures(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(part, number to share, signatures of 64 bits) for each part that a set enters."""
        n, p, out = len(s), self.percent, []
        if not n:
            return out
        s = self.sorted(s)
        if p * n <= 100:  # a single common element may link it
            out.append((0, 1, _mix(s + np.uint64(11))))
        if n > 1 and p * n < 100 * self.edge:  # its partners may be small
            head = s[: lacking(n, p) + 2]
            i, j = np.triu_indices(len(head), 1)
            out.append((1, 1, _mix(head[i] * np.uint64(5) + _mix(head[j]))))
        if n >= self.edge:
            least = max(self.edge, -(-p * n // 100))
            out.append((2, sharing(least, p), s[: listed(n, p)]))
        return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


#: Signatures that a worker holds back to find those that repeat among them.
HELD = 300_000
ALONE, FIRST, REPEATED = 0, 1, 2


def _measured(documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Two kinds of rows: (doc, n, key) for each document, (cell, times) of each part of the input.

    Cells below CELLS count all elements; of small sets the next MEASURED count the first
    element and the last MEASURED the first two together.
    """
    names = ["doc", "n", "key", "cell", "times"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(CELLS + 2 * MEASURED, np.int64)
        for batch in batches:
            n, key = [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k)
                n.append(len(s))
                key.append(_digest(s))
                np.add.at(times, s & np.uint64(CELLS - 1), 1)
                if SMALL[0] <= len(s) < SMALL[1]:
                    first = _mix(s[:2])
                    times[CELLS + int(first[0]) % MEASURED] += 1
                    times[CELLS + MEASURED + int(first[0] ^ _mix(first[1:])[0]) % MEASURED] += 1
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names)
        cells = np.flatnonzero(times)
        for i in range(0, len(cells), 50_000):
            part = cells[i : i + 50_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(part.astype(np.int32)), pa.array(times[part])], names)

    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(work), "doc long, n long, key binary, cell int, times long")


def _order(measured: DataFrame, percent: int) -> Order:
    """The order of all elements; at most as many rows as there are cells reach the driver."""
    found = measured.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(CELLS + 2 * MEASURED, np.int64)
    times[found.column("cell").to_numpy()] = found.column("times").to_numpy()
    edge = boundary(percent, moment(times[CELLS : CELLS + MEASURED]), moment(times[CELLS + MEASURED :]))
    # Steps of some four percent: chance differences between cells of rare elements don't count.
    return Order(percent, np.floor(16 * np.log2(times[:CELLS] + 1)).astype(np.uint16), edge)


def _marked(given: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(sig, doc, due, local) of arrays of sig, doc and due.

    local tells whether the signature repeats among those held together: what is REPEATED
    is known to be shared and need not meet the others, so a signature of a large group
    meets the others only once for each stretch of input.
    """

    def flush(held):
        sig, doc, due = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(sig, kind="stable")
        again = sig[order[1:]] == sig[order[:-1]]
        before, after = np.append(False, again), np.append(again, False)
        local = np.empty(len(sig), np.int8)
        local[order] = np.where(before, REPEATED, np.where(after, FIRST, ALONE))
        for i in range(0, len(sig), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(sig[part]), pa.array(doc[part]), pa.array(due[part]), pa.array(local[part])], ["sig", "doc", "due", "local"])

    held, size = [], 0
    for rows in given:
        if len(rows[0]):
            held.append(rows)
            size += len(rows[0])
        if size > HELD:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


MARKED = "sig long, doc long, due int, local byte"


def _signed(documents: DataFrame, order: Order, id_col: str, text_col: str, k: int) -> DataFrame:
    """(sig, doc, due, local) for each signature; due is 4 * the number of signatures to share + the number of the part."""
    shared = documents.sparkSession.sparkContext.broadcast(order)  # half a MB, whatever the corpus

    def signatures(batches: Iterator[pa.RecordBatch]):
        given = shared.value
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part, need, found in given.signatures(shingles(text.as_py(), k)):
                    yield found.view(np.int64), np.full(len(found), doc, np.int64), np.full(len(found), 4 * need + part, np.int32)

    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(lambda batches: _marked(signatures(batches))), MARKED)


def _still(listed: DataFrame) -> DataFrame:
    """(sig, doc, due, local) of signatures that are to meet once more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _marked(tuple(c.to_numpy() for c in batch.columns) for batch in batches)

    return listed.select("sig", "doc", "due").mapInArrow(lean(work), MARKED)


def _met(marked: DataFrame) -> DataFrame:
    """(sig, doc, due) of the signatures that may be shared: neighbours in hash order are compared.

    All rows take one way, so that what made them runs once and no table of them is written;
    REPEATED ones are dealt by document, the signature of a large group being no single key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_met = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            sig = batch.column(0).to_numpy()
            again = sig[1:] == sig[:-1]
            met = np.append(last_met, again) | np.append(again, False) | (batch.column(3).to_numpy() != ALONE)
            last, last_met = batch.slice(len(sig) - 1), bool(met[-1])
            met[-1] = False
            yield batch.select([0, 1, 2]).filter(pa.array(met))
        if last is not None and last_met:
            yield last.select([0, 1, 2])

    way = F.when(F.col("local") == REPEATED, F.col("doc")).otherwise(F.col("sig"))
    return marked.repartition(way).sortWithinPartitions("sig").mapInArrow(lean(work), "sig long, doc long, due int")


def _due(listed: DataFrame) -> DataFrame:
    """Rows of the parts in which a document shares as many signatures as a link takes."""
    enough = listed.groupBy("doc", "due").count().where("count >= due div 4").select("doc", "due")
    return listed.join(enough, ["doc", "due"], "left_semi").select("sig", "doc", "due")


def _led(listed: DataFrame, leaders: DataFrame) -> DataFrame:
    """(leader, doc) that need comparing.

    Linked documents share as many lists as either is to share. So each may leave out
    less than half of that number and they still share one that both keep: left out are
    the lists of the leaders that lead the fewest of the document's lists.
    """
    led = listed.join(leaders, "sig").groupBy("doc", "due", "leader").agg(F.count("sig").alias("lists"))
    fewest = Window.partitionBy("doc", "due").orderBy("lists", "leader").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = led.withColumn("below", F.sum("lists").over(fewest)).where(F.col("below") > F.expr("(due div 4 - 1) div 2"))  # the leaders of one document
    return needed.where("leader != doc").select("leader", "doc").distinct()


#: Ids of documents whose sets are wanted that may be broadcast, 16 bytes each; above it the texts are shuffled.
BROADCAST_IDS = 1_000_000


def _sets(documents: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc, leads, elements) of the documents in ``wanted`` (doc, leads), elements as packed 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out = [shingles(x.as_py(), k).tobytes() for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["doc", "leads", "elements"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    near = wanted.hint("broadcast") if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    return rows.join(near, "doc").select("doc", "leads", "text").mapInArrow(lean(work), "doc long, leads boolean, elements binary")


def _as_set(packed) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.setxor1d(a, b, assume_unique=True)


def _compare(pairs: DataFrame, t: int) -> DataFrame:
    """(leader, doc, size, differs, linked, elements): the set difference of each pair; t in hundredths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for a, b in zip(part.column(2), part.column(3), strict=True):
                    x, y = _as_set(a.as_buffer()), _as_set(b.as_buffer())
                    d = _difference(x, y)
                    union = (len(x) + len(y) + len(d)) // 2
                    rows.append((len(y), len(d), 100 * (union - len(d)) >= t * union, d.tobytes()))
                size, differs, linked, elements = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(differs, pa.int64()), pa.array(linked, pa.bool_()), pa.array(elements, pa.binary())],
                    ["leader", "doc", "size", "differs", "linked", "elements"],
                )

    return pairs.select("leader", "doc", "a", "b").mapInArrow(lean(work), "leader long, doc long, size long, differs long, linked boolean, elements binary")


def _exploded(stars: DataFrame) -> DataFrame:
    """(leader, doc, element) of differences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [_as_set(e.as_py()) for e in part.column(2)]
                n = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), n)),
                        pa.array(np.repeat(part.column(1).to_numpy(), n)),
                        pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()),
                    ],
                    ["leader", "doc", "element"],
                )

    return stars.select("leader", "doc", "elements").mapInArrow(lean(work), "leader long, doc long, element long")


def _verified(pairs: DataFrame, t: int) -> DataFrame:
    """(src, dst) of the pairs (x, y, nx, ny, dx, dy) of one star that reach t."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            keep = np.zeros(batch.num_rows, bool)
            for i, (n, a, b) in enumerate(zip(both, batch.column(4), batch.column(5), strict=True)):
                apart = len(_difference(_as_set(a.as_buffer()), _as_set(b.as_buffer())))
                union = (n + apart) // 2
                keep[i] = 100 * (union - apart) >= t * union
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep))

    return pairs.select("x", "y", "nx", "ny", "dx", "dy").mapInArrow(lean(work), "src long, dst long")


def classes(documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``n_shingles`` (size of its set) and ``component_id``.

    Two documents are linked when 100 * intersection >= percent * union of their
    sets of ``words``-word sequences; component_id is the smallest id that links
    reach, itself included.
    """
    measured = materialize(_measured(documents, id_col, text_col, words), "measured")
    order = _order(measured, percent)
    sets = measured.where(F.col("doc").isNotNull()).select("doc", "n", "key")
    heads = materialize(sets.where(F.col("n") > 0).groupBy("key").agg(F.min("doc").alias("head")), "heads")
    met = materialize(_met(_signed(documents, order, id_col, text_col, words)), "met")
    listed = materialize(_due(met).join(heads.select(F.col("head").alias("doc")), "doc", "left_semi"), "listed")
    discard(met)
    # Copies are gone now, and documents that fell short: what only they shared no longer counts.
    for _ in range(ROUNDS):
        met = materialize(_met(_still(listed)), "met")
        discard(listed)
        listed = materialize(_due(met), "listed")
        discard(met)
    shared = listed.groupBy("doc").agg(F.count("sig").alias("n_shared"))
    central = (
        sets.join(heads.select(F.col("head").alias("doc")), "doc", "left_semi")
        .join(shared, "doc")
        .select("doc", F.struct((-F.col("n_shared") / F.col("n")).alias("share"), "doc").alias("rank"))
    )
    ranked = materialize(listed.join(central, "doc"), "ranked")
    discard(listed)
    leaders = ranked.groupBy("sig").agg(F.min("rank").alias("first"), F.max("doc").alias("a"), F.min("doc").alias("b")).where("a != b")
    leaders = materialize(leaders.select("sig", F.col("first.doc").alias("leader")), "leaders")
    pairs = materialize(_led(ranked.select("sig", "doc", "due"), leaders), "pairs")
    discard(ranked, leaders)
    wanted = pairs.select("doc", F.lit(False).alias("leads")).union(pairs.select(F.col("leader").alias("doc"), F.lit(True)))
    wanted = materialize(wanted.groupBy("doc").agg(F.max("leads").alias("leads")), "wanted")
    elements = materialize(_sets(documents, wanted, id_col, text_col, words), "sets")
    of_leader = elements.where("leads").select(F.col("doc").alias("leader"), F.col("elements").alias("a"))
    both = pairs.join(elements.select("doc", F.col("elements").alias("b")), "doc").join(of_leader, "leader")
    stars = materialize(_compare(both, percent), "stars")
    discard(elements, pairs, wanted)
    links = stars.where("linked").select(F.col("leader").alias("src"), F.col("doc").alias("dst"))
    known = connected_components(links)
    more = _rest(stars, known, percent)
    if more is not None:
        known = connected_components(links.union(more))
    of_head = heads.join(known, F.col("head") == F.col("node"), "left").select("key", F.coalesce("component", "head").alias("component_id"))
    of_head = materialize(of_head, "components")
    discard(stars, heads, known, more)
    out = sets.join(of_head, "key", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")
    )
    nameless = documents.where(F.col(id_col).isNull())
    if nameless.limit(1).count():
        sizes = nameless.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(shingles(x.as_py(), words)) for x in b.column(0)], pa.int64())], ["n"]) for b in batches)), "n long")
        out = out.union(sizes.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))
    return out


def _rest(stars: DataFrame, known: DataFrame, percent: int) -> DataFrame | None:
    """Links between members of a star whose classes are apart so far.

    x and y of leader L differ from L in dx and dy elements, of which ux and uy are
    in no other member's difference. They differ from each other in at least
    dx + dy - 2 * min(dx - ux, dy - uy) elements, and a link allows d of them.
    """
    t = percent / 100
    most = (1 - t) / (1 + t)
    placed = stars.join(known.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    of_leader = known.select(F.col("node").alias("leader"), F.col("component").alias("home"))
    placed = placed.join(of_leader, "leader", "left").withColumn("away", F.col("component") != F.coalesce("home", "leader"))
    # Stars with a single member, or with all in the leader's class, have nothing left.
    open_stars = placed.groupBy("leader").agg(F.count("doc").alias("members"), F.max("away").alias("apart")).where("members > 1 and apart").select("leader")
    placed = materialize(placed.join(open_stars, "leader", "left_semi").select("leader", "doc", "size", "differs", "component", "away"), "open")
    tokens = _exploded(stars.join(placed.select("leader", "doc"), ["leader", "doc"], "left_semi"))
    lone = tokens.groupBy("leader", "element").agg(F.count("doc").alias("c"), F.min("doc").alias("doc")).where("c = 1").groupBy("leader", "doc").agg(F.count("element").alias("alone"))
    counted = materialize(placed.join(lone, ["leader", "doc"], "left").withColumn("alone", F.coalesce("alone", F.lit(0))), "counted")
    free = F.col("differs") - 2 * F.col("alone")
    widest = F.floor(F.lit(most * (1 + 1 / t)) * F.col("size") + F.lit(1e-9))  # d with the largest partner that there can be
    lean = counted.select("leader", "doc", "size", "differs", "component", "away", free.alias("free"), (F.col("differs") - widest).alias("need"), (free + widest).alias("most"))
    reach = lean.groupBy("leader").agg(F.max("free").alias("best"), F.min("differs").alias("least"))
    seeking = lean.where("away").join(reach, "leader").where("need <= best and most >= least").drop("best", "least")
    seeking = materialize(seeking, "seeking")
    if seeking.isEmpty():
        return None
    sought = seeking.groupBy("leader").agg(F.min("need").alias("worst"), F.max("most").alias("widest"))
    offering = materialize(lean.join(sought, "leader").where("free >= worst and differs <= widest").drop("worst", "widest"), "offering")
    pairs = materialize(_candidates(stars, seeking, offering, percent), "rest")
    discard(seeking, offering)
    if pairs.isEmpty():
        return None
    found = stars.select("leader", "doc", "size", "elements")
    full = pairs.join(found.select("leader", F.col("doc").alias("x"), F.col("size").alias("nx"), F.col("elements").alias("dx")), ["leader", "x"])
    full = full.join(found.select("leader", F.col("doc").alias("y"), F.col("size").alias("ny"), F.col("elements").alias("dy")), ["leader", "y"])
    links = materialize(_verified(full, percent).distinct(), "rest-links")
    discard(placed, counted, pairs)
    return links


#: Differences of a star fall into bands by size, each up to so many times its lower end.
BAND = 1.5


def _candidates(stars: DataFrame, seeking: DataFrame, offering: DataFrame, percent: int) -> DataFrame:
    """(leader, x, y) of members whose differences may overlap enough: x seeks, y offers.

    This is the join of the large sets once more, within each star. Two differences of dx
    and dy elements must have c = (dx + dy - allowed) / 2 in common, which is 1 at least
    while x is not of the leader's class. Ordered by how many of the star's differences
    hold an element, the first s - c + 1 of the s elements that others hold too must then
    meet. c is taken for each band of partners by its least difference and largest set,
    so that what nearly all members differ in from the leader comes last and makes no pairs.
    """
    t = percent / 100
    most = (1 - t) / (1 + t)
    keep = ("leader", "doc", "size", "differs", "component", "away", "free")
    members = offering.select(*keep).unionByName(seeking.select(*keep)).distinct()
    members = members.withColumn("band", F.floor(F.log(F.col("differs").cast("double")) / math.log(BAND)).cast("int"))
    tokens = _exploded(stars.join(members.select("leader", "doc"), ["leader", "doc"], "left_semi"))
    often = tokens.groupBy("leader", "element").agg(F.count("doc").alias("c")).where("c > 1")
    own = tokens.join(often, ["leader", "element"]).groupBy("leader", "doc").agg(F.array_sort(F.collect_list(F.struct("c", "element"))).alias("own"))  # of one difference
    members = materialize(members.join(own, ["leader", "doc"]), "members")
    bands = members.groupBy("leader", F.col("band").alias("other")).agg(F.min("differs").alias("least"), F.max("size").alias("largest"))
    widest = F.floor(F.lit(most) * (F.col("size") + F.least(F.col("largest").cast("double"), F.col("size") / F.lit(t))) + F.lit(1e-9))
    common = F.greatest(F.lit(1), F.ceil((F.col("differs") + F.col("least") - widest) / 2)).cast("int")
    headed = members.join(bands, "leader").withColumn("head", F.size("own") - common + 1).where("head > 0")
    entries = headed.select("leader", "doc", "size", "differs", "component", "away", "free", "band", "other", F.explode(F.slice("own", F.lit(1), F.col("head"))).alias("e")).select("*", "e.element").drop("e")
    entries = materialize(entries, "entries")
    x, y = entries.where("away").alias("x"), entries.alias("y")
    allowed = F.floor(F.lit(most) * (F.col("x.size") + F.col("y.size")) + F.lit(1e-9))
    met = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.band") == F.col("y.other")) & (F.col("x.other") == F.col("y.band"))
    pairs = x.join(y, met).where(
        (F.col("x.doc") != F.col("y.doc"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("y.differs") <= F.col("x.free") + allowed)
        & (F.col("x.differs") <= F.col("y.free") + allowed)
        & ~(F.col("y.away") & (F.col("x.doc") > F.col("y.doc")))
    )
    return pairs.select(F.col("x.leader").alias("leader"), F.col("x.doc").alias("x"), F.col("y.doc").alias("y")).distinct()
