"""N-gram Jaccard join by grouped prefixes.

Every text is the set of its word shingles.  Shingles have one global order:
first by how often their slot of a fixed-size count sketch over the whole
corpus was hit, then by hash; any order gives right results, this one keeps
shared shingles out of the prefixes, as a text has others in emptier slots.  Two sets can reach the
threshold only if their prefixes share a shingle and their sizes are close.

Equal sets are one class.  Classes of equal size and equal prefix are one
group; only groups meet in the candidate join.  Pairs of groups are expanded to
pairs of classes, and these are verified on the sets.  Two star rounds come
first, in which each list of groups is tried against one of its groups only.
The full join then takes what is left: pairs whose classes are not yet in one
component.  So no link between components is lost, and large groups of near
copies don't make all of their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.scratch import Scratch, running, small_batches
from tidemark.llm.text import byte_chunks, fold, mix64, prefix_hash, span_hash, word_spans

#: Counters of the sketch, fixed whatever the corpus: 8 MB as broadcast.
SKETCH_BITS = 21
SLICE_BITS = 15
#: Bits of the filter that tells which sets to gather: 16 MB at most.
FILTER_BITS = 27
_A, _B, _C = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xDB4F0B9175AE2165))
_SALT = np.uint64(0x94D049BB133111EB)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row), rows ascending; a text with fewer words is one shingle of all of them."""
    data = fold(data)
    start, end, row = word_spans(data, offsets)
    word = span_hash(prefix_hash(data), start, end)
    n = len(word)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    acc = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        acc = mix64(acc * _A + word[k : n - width + 1 + k] * _B + np.uint64(k + 1))
    whole = (row[: len(acc)] == row[width - 1 :]) if len(acc) else np.zeros(0, bool)
    hashes, rows = [acc[whole]], [row[: len(acc)][whole]]
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        lone = np.full(len(short), _C, np.uint64)
        for k in range(width - 1):
            has = per_row[short] > k
            lone[has] = mix64(lone[has] * _A + word[first[short[has]] + k] * _C + np.uint64(k + 1))
        hashes.append(lone)
        rows.append(short)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def _sets(column, width: int):
    """(row, ascending distinct hashes) of every text of an Arrow column."""
    for lo, hi, data, offsets in byte_chunks(column):
        hashes, rows = shingles(data, offsets, width)
        cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, np.unique(hashes[cuts[i] : cuts[i + 1]])


def _signature(a: np.ndarray, salt: int = 0) -> bytes:
    """128 bits of a set of hashes."""
    one = mix64(a + np.uint64(salt)).sum(dtype=np.uint64)
    two = mix64((a ^ _SALT) * _A + np.uint64(salt)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def sketch_loads(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """The load of every slot of the sketch."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_chunks(batch.column(0)):
                hashes, _ = shingles(data, offsets, width)
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        parts = np.minimum(total, 2**32 - 1).astype("<u4").reshape(-1, 1 << SLICE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
                total[k] = total[k] + part if k in total else part
        loads = [np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(loads, pa.binary())], ["slice", "n"])

    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    with running(docs.sparkSession):
        found = (docs.select(text).mapInArrow(count, "slice int, n binary").repartition(slices, "slice")
                 .mapInArrow(add, "slice int, n binary").collect())
    counts = np.zeros((slices, 1 << SLICE_BITS), np.uint32)
    for k, raw in found:
        counts[k] = np.frombuffer(raw, "<u4")
    return counts.ravel()


def _describe(docs: DataFrame, key: str, text: str, width: int, percent: int, classes) -> DataFrame:
    """(key, n, sig, gid, g, prefix) for every row; all but key and n are null for empty sets."""
    def run(batches):
        order = classes.value
        for batch in batches:
            n, sigs, gids, halves, prefixes = [], [], [], [], []
            for _, a in _sets(batch.column(1), width):
                n.append(len(a))
                if not len(a):
                    for x in (sigs, gids, halves, prefixes):
                        x.append(None)
                    continue
                keep = len(a) - -(-len(a) * percent // 100) + 1
                rank = order[(a >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefix = a[np.argsort(rank, kind="stable")[:keep]]
                sigs.append(_signature(a))
                gids.append(_signature(prefix, len(a)))
                halves.append(int.from_bytes(gids[-1][:8], "little", signed=True))
                prefixes.append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(gids, pa.binary()),
                                              pa.array(halves, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["key", "n", "sig", "gid", "g", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n long, sig binary, gid binary, g long, prefix array<long>")


def _bit(slots: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1


def bit_filter(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit table with the slots (column mod 2**bits) set; at most 2**(bits - 3) bytes come to the driver."""
    slots = values.select((F.pmod(F.col(column), F.lit(1 << bits)) + 1).alias("slot"))
    found = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    table = np.zeros(max(1, 1 << (bits - 3)), np.uint8)
    for b, raw in found:
        # Bucket b holds the numbers (b - 1) * 32768 + 1 and on; they are one more than the slots.
        part = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        slots_in = np.flatnonzero(part) + (b - 1) * 32768
        np.bitwise_or.at(table, slots_in >> 3, np.left_shift(np.uint8(1), (slots_in & 7).astype(np.uint8)))
    return table


def _lists(groups: DataFrame, percent: int) -> DataFrame:
    """Entries (token, band, low, pos, n, g) of tokens that two groups have in their prefixes.

    ``low`` entries may be the smaller of a pair: a pair whose sizes fit is in
    one band, the smaller one low there.  ``g`` is half of a group's name; groups
    that share it by chance only make candidates of each other.
    """
    tokens = groups.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("token")
    band = F.floor(F.log("n") / float(-np.log(percent / 100 - 0.01)))  # wider than the sizes of a pair can differ
    as_low = F.struct(band.alias("band"), F.lit(True).alias("low"))
    as_high = F.struct((band - 1).alias("band"), F.lit(False).alias("low"))
    return (tokens.join(shared, "token", "left_semi").select("token", "pos", "n", "g", F.explode(F.array(as_low, as_high)).alias("p"))
            .select("token", "p.band", "p.low", "pos", "n", "g"))


def _fits(percent: int, n1: Column, n2: Column, i: Column, j: Column) -> Column:
    """Sizes and places in the prefixes still allow the threshold."""
    needed = percent * (n1 + n2)
    rest = 1 + F.least(n1 - i - 1, n2 - j - 1)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (rest * (100 + percent) >= needed)


def _plausible(pairs: DataFrame, owned: DataFrame, percent: int, classes) -> DataFrame:
    """The pairs (a, b) of classes that may still reach the threshold, judged on whole prefixes.

    A token of one prefix that comes before the end of the other one and is not
    in it is not in the other set at all.
    """
    side = lambda x, i: owned.select(F.col("sig").alias(x), F.col("n").alias(f"n{i}"), F.col("prefix").alias(f"p{i}"))
    joined = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "n1", "p1", "n2", "p2")

    def run(batches):
        order = classes.value
        rank = lambda x: order[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        upto = lambda p, r, q, s: int(((r < s[-1]) | ((r == s[-1]) & (p <= q[-1]))).sum())
        for batch in batches:
            n1, n2 = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            keep = []
            for m, x, n, y in zip(n1, batch.column(3), n2, batch.column(5), strict=True):
                p, q = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                r, s = rank(p), rank(q)
                both = len(np.intersect1d(p, q, assume_unique=True))
                most = min(m - (upto(p, r, q, s) - both), n - (upto(q, s, p, r) - both))
                keep.append((100 + percent) * most >= percent * (m + n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    one = sets.select(F.col("sig").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("sig").alias("b"), F.col("members").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component) for each row of ``docs``.

    Two rows link when 100 * intersection >= percent * union of their shingle
    sets; component is the least key reachable.  Null, empty and wordless texts
    have the empty set and link with nothing, not with each other.  Repeated rows and keys are
    one class by their sets.  A null key is never a component unless all keys
    there are null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    classes = spark.sparkContext.broadcast(sketch_loads(docs, text, width))
    rows = scratch.table(_describe(docs, key, text, width, percent, classes), "rows")
    owned = scratch.table(rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(
        F.min("key").alias("rep"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("g").alias("g"), F.first("prefix").alias("prefix")), "classes")
    members = owned.select("sig", "g", "n")
    groups = scratch.table(owned.groupBy("gid").agg(
        F.first("g").alias("g"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("sig").alias("hub"), F.max("sig").alias("hub2"),
        F.count(F.lit(1)).alias("size")), "groups")
    lists = scratch.table(_lists(groups, percent), "lists")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Verify candidates, gathering the sets of those only that their prefixes leave."""
        some = scratch.table(_plausible(pairs, owned, percent, classes), f"{name}-pairs")
        if some.isEmpty():
            return some
        ends = some.select(F.col("a").alias("sig")).unionByName(some.select(F.col("b").alias("sig"))).distinct()
        reps = owned.join(ends, "sig", "left_semi").select(F.xxhash64("rep").alias("h"))
        table = spark.sparkContext.broadcast(bit_filter(reps, "h", FILTER_BITS))
        sets = scratch.table(_chosen_sets(docs, key, text, width, table).groupBy("sig").agg(F.first("members").alias("members")), f"{name}-sets")
        table.destroy()
        links = scratch.table(_verify(some, sets, percent), f"{name}-links")
        scratch.drop(sets)
        scratch.drop(some)
        return links

    stars = [_star(lists, groups, members, hub, percent) for hub in ("hub", "hub2")]
    links = confirmed(stars[0].unionByName(stars[1]).distinct(), "star")
    part_of = scratch.table(_components(owned.select("sig", "rep", "g"), links, scratch), "parts")
    more = confirmed(_left_over(lists, part_of, percent), "rest")
    classes.destroy()  # all that needs it is written
    scratch.drop(lists)
    scratch.drop(groups)
    if not more.isEmpty():  # join the components that the new links connect
        of = part_of.select("sig", "component")
        across = (more.join(of.withColumnsRenamed({"sig": "a", "component": "ca"}), "a").join(of.withColumnsRenamed({"sig": "b", "component": "cb"}), "b")
                  .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        onto = connected_components(across, scratch).select(F.col("node").alias("component"), F.col("component").alias("onto"))
        part_of = part_of.join(onto, "component", "left").withColumn("component", F.coalesce("onto", "component"))
    least = part_of.groupBy("component").agg(F.min("rep").alias("least"))
    named = part_of.join(least, "component").select("sig", "least")
    return rows.join(named, "sig", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component"))


def _chosen_sets(docs: DataFrame, key: str, text: str, width: int, table) -> DataFrame:
    """(sig, members) of the texts whose key the filter holds, each class once a task."""
    def choose(batches):
        bits, seen = table.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(_bit(batch.column(0).to_numpy(), bits).astype(bool)))
            for lo in range(0, batch.num_rows, 500):
                sigs, packed = [], []
                for _, a in _sets(batch.column(1).slice(lo, 500), width):
                    if len(a) and (sig := _signature(a)) not in seen:
                        seen.add(sig)
                        sigs.append(sig)
                        packed.append(a.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(packed, pa.binary())], ["sig", "members"])

    slot = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    return docs.select(slot.alias("slot"), text).mapInArrow(choose, "sig binary, members binary")


def _star(lists: DataFrame, groups: DataFrame, members: DataFrame, hub: str, percent: int) -> DataFrame:
    """Pairs of classes: each list's chosen group with its others, each group's chosen class with its others."""
    # Few tokens before the shared one means few that the others lack: the likeliest to link with many.
    order = F.col("g") if hub == "hub" else F.xxhash64("g")
    chosen = lists.groupBy("token", "band").agg(F.min(F.struct("pos", order.alias("by"), "g", "n")).alias("h"))
    fits = (F.col("g") != F.col("h.g")) & _fits(percent, F.col("n"), F.col("h.n"), F.col("pos"), F.col("h.pos"))
    between = lists.join(chosen, ["token", "band"]).where(fits).select("g", F.col("h.g").alias("to")).distinct()
    name = groups.select("g", F.col(hub).alias("sig"))
    between = (between.join(name.withColumnRenamed("sig", "a"), "g").drop("g")
               .join(name.withColumnsRenamed({"g": "to", "sig": "b"}), "to").select("a", "b"))
    within = members.join(groups.where("size > 1").select("g", F.col(hub).alias("a")), "g").where("a <> sig").select("a", F.col("sig").alias("b"))
    return between.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes`` with ``component``: a class of its linked ones."""
    found = connected_components(links, scratch).withColumnRenamed("node", "sig")
    return classes.join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def _left_over(lists: DataFrame, part_of: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that may link and are not in one component yet."""
    ends = part_of.groupBy("g").agg(F.min("component").alias("cmin"), F.max("component").alias("cmax"))
    entries = lists.join(ends, "g")
    mixed = entries.groupBy("token", "band").agg(F.min("cmin").alias("lo"), F.max("cmax").alias("hi")).where("lo <> hi").select("token", "band")
    entries = entries.join(mixed, ["token", "band"], "left_semi")
    x, y = entries.where("low").alias("x"), entries.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & F.col("y.low") & (F.col("x.g") < F.col("y.g")))
    apart = (F.col("x.cmin") != F.col("y.cmax")) | (F.col("x.cmax") != F.col("y.cmin"))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & ordered & apart
    fits = _fits(percent, F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"))
    pairs = x.join(y, on & fits).select(F.col("x.g").alias("g"), F.col("y.g").alias("h")).distinct()
    pairs = pairs.unionByName(ends.where("cmin <> cmax").select(F.col("g"), F.col("g").alias("h")))
    one = part_of.select("g", F.col("sig").alias("a"), F.col("component").alias("ca"))
    two = part_of.select(F.col("g").alias("h"), F.col("sig").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(one, "g").join(two, "h").where("ca <> cb and (g <> h or a < b)")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=3, percent=90).withColumnRenamed("component", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT y, c FROM reach JOIN link ON x = doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, coalesce(min(c), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
