"""N-gram Jaccard join: links between documents whose shingle sets are similar.

1. *Sets.*  Word shingles as 64-bit hashes.  Equal sets are one node from here on, named by a
   64-bit hash of theirs; ids come back at the end.  Shingles
   that many documents of a chunk have are counted, and the most frequent come last in the
   order of all sets; any order gives the same links, this one gives short index lists.
2. *Index.*  The prefix of each set that a similar one must meet.  Shingles of only one set
   leave through one exchange of packed records.
3. *Leaders.*  A list is headed by the set that lies in most lists.  A set is compared to the
   one that heads most of its lists; if linked, that is its leader, and the exact overlap is kept.  Lists of copies come down to one
   component here, without a pair of each with each.
4. *Lists again, across components.*  Lists are cut in blocks by set size.  A pair comes out of
   a list that can hold the first shingle the two share, and is skipped where they meet in
   fewer lists than linked sets must.  Candidates between components get their answer from the leaders' overlap: |x & y| differs from |lx & ly| by no more than what
   the sets lack of their leaders.  Where that settles the question nothing is compared; the
   rest is compared exactly.
5. *Components* of all links.

Defined cases: texts without words (NULL, empty) have the empty set, 0 shingles and no link;
fewer than five words are one shingle; texts are used whole; rows of equal doc_id are linked
by any of their texts, whatever these are, and keep their own n_shingles; rows without a doc_id get
their n_shingles and no component; an empty table gives an empty one; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.common import forget, settle, table, whole_row
from cohortscope.llm.components import components
from cohortscope.llm.shared_keys import blocks, chunks, n_buckets, records, shared_keys

WIDTH = 5
PERCENT = 80                # of the union, for a link
HEADED = 4                  # a head need hold but this part of the lists a leader must share
FREQUENT_IN_CHUNK = 8       # documents of a chunk that make a shingle worth counting
MOST_FREQUENT = 1 << 17     # shingles that are put last; orders work, never leaves any out
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each text as ascending hashes; only A-Z are lower-cased."""
    return [s for a, b in blocks(texts) for s in _shingle_sets(texts[a:b])]


def _shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    none = np.zeros(0, np.uint64)
    if not len(start):
        return [none] * len(texts)
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    size = end - start
    at = np.flatnonzero(~blank)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    letters = _mix((place.astype(np.uint64) << np.uint64(8) | buf[at]) + _ODD[0])
    word = _mix(np.add.reduceat(letters, np.cumsum(size) - size))
    stop = np.cumsum([len(t) + 1 for t in texts])
    edge = np.r_[0, np.searchsorted(start, stop)]
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        w = word[a:b]
        n = max(1, len(w) - width + 1)
        h = np.full(n if len(w) else 0, np.uint64(min(len(w), width)))
        for j in range(min(width, len(w))):
            h = h + w[j:j + n] * _ODD[j]
        out.append(np.unique(_mix(h)) if len(w) else none)
    return out


def needed(n, m):
    """Smallest overlap of linked sets of the given sizes, as a Column or an array."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def prefix(size: int) -> int:
    """How many of a set's first shingles must hold one of any set linked to it."""
    return size - -(-PERCENT * size // 100) + 1


def node_of(s: np.ndarray) -> int:
    """The name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _survey(batches):
    """A row per document, and rows of shingles that a chunk has often."""
    names = ["doc", "n", "node", "shingle", "often"]
    types = [pa.int64()] * 5
    for ids, texts in chunks(batches):
        sets = shingle_sets(texts)
        nodes = [node_of(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, types[0]), pa.array([len(s) for s in sets], types[1]),
             pa.array(nodes, types[2]), pa.nulls(len(ids), types[3]),
             pa.nulls(len(ids), types[4])], names)
        distinct = list(dict(zip(nodes, sets)).values())
        key, n = np.unique(np.concatenate(distinct), return_counts=True)
        key, n = key[n >= FREQUENT_IN_CHUNK], n[n >= FREQUENT_IN_CHUNK]
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(key), t) for t in types[:3]], pa.array(key.view(np.int64)),
             pa.array(n)], names)


def _index(frequent: np.ndarray):
    """Prefix records of a chunk's distinct sets: hash, set, size, position."""
    def make(_, texts):
        keys, nodes, sizes, places, seen = [], [], [], [], set()
        for s in shingle_sets(texts):
            node = node_of(s)
            if not len(s) or node in seen:
                continue
            seen.add(node)
            if len(frequent):
                spot = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                late = frequent[spot] == s
                s = np.r_[s[~late], s[late]]
            k = prefix(len(s))
            keys.append(s[:k])
            nodes.append(np.full(k, node))
            sizes.append(np.full(k, len(s)))
            places.append(np.arange(k))
        if not keys:
            return records([], [], [], [])
        return records(*map(np.concatenate, (keys, nodes, sizes, places)))
    return make


def _sets(batches):
    for ids, texts in chunks(batches):
        sets = shingle_sets(texts)
        edge = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()),
             pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat))],
            ["doc", "node", "set"])


def sets_of(rows: DataFrame, known: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(node, set) of the given nodes, each once, written.

    A set is read from the smallest document that has it.  A document of one row has no other
    set; sets of documents of several rows are picked out and made distinct.
    """
    nodes = nodes.distinct().join(known.select("node", "doc", "rows"), "node")
    listed = settle(nodes.groupBy("node").agg(F.min(F.struct("doc", "rows")).alias("m"))
                    .select("node", "m.doc", "m.rows"), f"{name}-ids")

    def read(which):
        return rows.join(listed.filter(which).select("doc").distinct(), "doc", "left_semi").select(
            "doc", "text").mapInArrow(_sets, "doc bigint, node bigint, set array<bigint>")

    several = read("rows > 1").join(listed, ["doc", "node"], "left_semi").dropDuplicates(["node"])
    return settle(read("rows = 1").unionByName(several).select("node", "set"), name)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of the sets of every pair (x, y)."""
    one = sets.select(F.col("node").alias("x"), F.col("set").alias("of_x"))
    two = sets.select(F.col("node").alias("y"), F.col("set").alias("of_y"))
    both = F.size(F.array_intersect("of_x", "of_y")).cast("long")
    return pairs.join(one, "x").join(two, "y").select("x", "y", both.alias("both"))


def _near(n, m):
    """Whether sets of these sizes can be linked at all."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def meetings(lists: DataFrame) -> DataFrame:
    """Pairs of sets in different components (x, y, nx, ny) that may be linked, per list.

    Lists are cut in blocks of sizes: a set meets the blocks of its own size and the next
    larger.  The first token that two sets share has all they share at or behind it, in
    both: a pair comes out of a list only where either has room for that many, whatever
    other lists the two are in.
    """
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9)
    rows = lists.withColumn("block", block)
    left = rows.filter(F.col("place") <= F.col("n") - _needed(F.col("n"), F.col("n"))).select(
        "key", "block", F.col("node").alias("x"), F.col("n").alias("nx"),
        F.col("place").alias("px"), F.col("component").alias("cx"))
    right = rows.select("key", F.explode(F.array("block", F.col("block") - 1)).alias("block"),
                        F.col("node").alias("y"), F.col("n").alias("ny"),
                        F.col("place").alias("py"), F.col("component").alias("cy"))
    need = _needed(F.col("nx"), F.col("ny"))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny"))
                                             & (F.col("x") < F.col("y")))
    return (left.join(right, ["key", "block"])
            .filter((F.col("cx") != F.col("cy")) & smaller & _near(F.col("nx"), F.col("ny"))
                    & (F.col("px") <= F.col("nx") - need) & (F.col("py") <= F.col("ny") - need))
            .select("x", "y", "nx", "ny"))


def candidates(lists: DataFrame) -> DataFrame:
    """Pairs that meet in a list (:func:`meetings`) and in as many as linked sets must."""
    held = lists.groupBy("node").agg(F.collect_set("key").alias("keys"))
    one = held.select(F.col("node").alias("x"), F.col("keys").alias("of_x"))
    two = held.select(F.col("node").alias("y"), F.col("keys").alias("of_y"))
    met = F.size(F.array_intersect("of_x", "of_y"))
    return (meetings(lists).distinct().join(one, "x").join(two, "y")
            .filter(met >= _met(F.col("nx"), F.col("ny"))).select("x", "y", "nx", "ny"))


def _needed(n, m):
    return F.floor((PERCENT * (n + m) + 99 + PERCENT) / (100 + PERCENT))


def _met(n, m):
    """In how many lists linked sets of these sizes meet at least.

    Of the tokens that both have, at most size - prefix of either lie behind its prefix; up
    to where the shorter reaching prefix ends, the prefixes share all that both have.
    """
    def inside(k):
        return _needed(n, m) - F.floor((PERCENT * k + 99) / 100) + 1
    return F.greatest(F.least(inside(n), inside(m)), F.lit(1))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surveyed documents, links): doc, n, node of each; pairs (a, b) of linked ids.

    Links join documents of equal sets to the smallest of them and hold, between different
    sets, enough links for the components: every link lies inside one of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    survey = settle(rows.mapInArrow(
        _survey, "doc bigint, n bigint, node bigint, shingle bigint, often bigint"), "survey")
    frequent = (survey.filter("shingle IS NOT NULL").groupBy("shingle")
                .agg(F.sum("often").alias("often"))
                .orderBy(F.desc("often"), "shingle").limit(MOST_FREQUENT).select("shingle"))
    often = np.sort(frequent.toArrow().column("shingle").to_numpy().view(np.uint64))
    known = survey.filter("often IS NULL").select("doc", "n", "node")
    filled = known.filter("n > 0 AND doc IS NOT NULL")
    several = settle(filled.groupBy("doc").agg(F.count("*").alias("rows"))
                     .filter("rows > 1"), "several")
    held = (filled.select("doc", "node").distinct().join(several, "doc", "left")
            .withColumn("rows", F.coalesce("rows", F.lit(1))))
    first = held.groupBy("node").agg(F.min("doc").alias("rep"), F.min(F.struct("doc", "rows"))
                                     .alias("m"), F.max("doc").alias("top"))
    first = settle(first.select("node", "rep", F.col("m.doc").alias("doc"),
                                F.col("m.rows").alias("rows"), (F.col("top") > F.col("rep"))
                                .alias("shared")), "classes")
    equal = (held.select("doc", "node").join(first.filter("shared").select("node", "rep"), "node")
             .filter("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")))

    found = shared_keys(rows.filter("doc IS NOT NULL"), _index(often), n_buckets(rows))
    lists = settle(found.select("key", F.col("id").alias("node"), F.col("a").alias("n"),
                                F.col("b").alias("place")).distinct(), "lists")

    # a list is headed by the set that lies in most lists: of near copies, the one whose
    # shingles most others have
    often_in = lists.groupBy("node").agg((-F.count("*")).alias("rank"))
    head = lists.join(often_in, "node").groupBy("key").agg(
        F.min(F.struct("rank", "node", "n")).alias("head"))
    x, y = F.col("nx"), F.col("ny")
    stars = (lists.join(head, "key").select(
        F.col("node").alias("x"), F.col("head.node").alias("y"), F.col("n").alias("nx"),
        F.col("head.n").alias("ny"))
        .filter((F.col("x") != F.col("y")) & _near(x, y))
        .groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("met"))
        .filter(HEADED * F.col("met") >= _met(x, y))
        .groupBy("x", "nx").agg(F.min(F.struct((-F.col("met")).alias("met"), "y", "ny")).alias("best"))
        .select("x", "best.y", "nx", "best.ny"))
    stars = settle(stars, "stars")
    sets = sets_of(rows, first, stars.select(F.explode(F.array("x", "y")).alias("node")), "sets")
    linked = settle(overlaps(stars, sets).join(stars, ["x", "y"])
                    .filter(F.col("both") >= _needed(x, y)), "near")
    forget(stars, sets)
    near = linked.select(F.col("x").alias("a"), F.col("y").alias("b"))

    part = components(near).withColumnRenamed("node", "in")
    placed = (lists.join(part, lists["node"] == part["in"], "left")
              .withColumn("component", F.coalesce("component", "node")).drop("in"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"),
                                      F.max("component").alias("high")).filter("low != high")
    open_ = settle(placed.join(mixed.select("key"), "key", "left_semi"), "open")
    forget(lists)
    pairs = settle(candidates(open_), "candidates")
    forget(open_)
    more = _answers(rows, first, pairs, linked)
    rep = first.select("node", "rep")
    # what is linked so far hangs on its smallest document, which leaves few rounds to go
    held = part.join(rep, part["in"] == rep["node"]).select("component", "rep")
    low = held.groupBy("component").agg(F.min("rep").alias("b"))
    hung = held.join(low, "component").select(F.col("rep").alias("a"), "b").filter("a != b")
    named = more
    for side in ("a", "b"):
        named = named.join(rep, named[side] == rep["node"]).drop("node", side).withColumnRenamed(
            "rep", side)
    found = settle(equal.unionByName(hung).unionByName(named), "found")
    forget(more, pairs, linked)
    return known, found


def _answers(docs: DataFrame, known: DataFrame, pairs: DataFrame,
             linked: DataFrame) -> DataFrame:
    """Links among candidates (x, y, nx, ny), from the answers of their leaders."""
    best = linked.select("x", F.struct("y", "both", "ny").alias("l"))

    def led(rows, of):
        mine = best.select(F.col("x").alias(of), F.col("l").alias(f"l{of}"))
        n, lead = F.col(f"n{of}").cast("long"), F.col(f"l{of}")
        return rows.join(mine, of, "left").withColumns({
            f"lead_{of}": F.coalesce(lead["y"], F.col(of)),
            f"new_{of}": F.coalesce(n - lead["both"], F.lit(0)),        # not in the leader
            f"gone_{of}": F.coalesce(lead["ny"] - lead["both"], F.lit(0)),
        }).drop(f"l{of}")

    rows = led_ = settle(led(led(pairs, "x"), "y"), "led")
    sets = sets_of(docs, known, rows.select(F.explode(F.array("x", "y", "lead_x", "lead_y"))
                                            .alias("node")), "candidate-sets")
    lead = rows.select(F.col("lead_x").alias("x"), F.col("lead_y").alias("y")).filter(
        "x != y").distinct()
    leads = overlaps(lead, sets).select(
        F.col("x").alias("lead_x"), F.col("y").alias("lead_y"), "both")
    need = _needed(F.col("nx"), F.col("ny"))
    rows = rows.join(leads, ["lead_x", "lead_y"])
    high = F.col("both") + F.col("new_x") + F.col("new_y")
    low = F.col("both") - F.col("gone_x") - F.col("gone_y")
    rows = settle(rows.filter(high >= need).withColumn("sure", low >= need), "bounded")
    forget(led_)
    rest = rows.filter("NOT sure").select("x", "y", "nx", "ny")
    exact = overlaps(rest.select("x", "y"), sets).join(rest, ["x", "y"]).filter(
        F.col("both") >= need)
    out = settle(rows.filter("sure").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(
        exact.select(F.col("x").alias("a"), F.col("y").alias("b"))), "more")
    forget(rows, sets)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Number of shingles and component of every document."""
    known, found = links(docs)
    part = components(found)
    forget(found)
    return (known.join(part, known["doc"] == part["node"], "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "doc").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows with equal doc_id the first by text, then by the other columns, stays; rows
    without a doc_id stay all.
    """
    first = settle(near_duplicates(docs).filter("doc_id = component_id")
                   .select(F.col("doc_id").alias("id")).distinct(), "first")
    mine = Window.partitionBy("id").orderBy(*[F.col(f"row.`{c}`") for c in ["text", *docs.columns]])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_row(docs))
    held = (rows.join(first, "id", "left_semi").withColumn("place", F.row_number().over(mine))
            .filter("place = 1"))
    return held.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLE: dict[str, str] = {}
