"""Grouped prefix join: Jaccard similarity of word shingles, and its components.

Several jobs run when the query is built. Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their shingle
sets. The steps:

1. *Order.* A count sketch of fixed size holds how often shingles occur in the whole
   table. Any total order makes the prefix filter exact; ordering by the sketch, rare
   first, keeps frequent passages out of the prefixes.
2. *Classes.* Documents with equal sets collapse to one class, its least doc_id.
3. *Groups.* Classes with equal size and equal prefix collapse to one group.
4. *Group pairs.* Groups that share a prefix shingle meet in that shingle's run. A run
   is streamed in order of prefix position: its first group is the hub, and each other
   group that passes the size and position filters makes a pair with the hub, so a run
   gives as many pairs as it has rows, never all pairs.
5. *Verify.* Pairs expand to members; a hub's text meets those of its partners, a bounded
   number of them in a task, and the sets are compared.
6. *Rest.* With the components of step 5 known, only pairs of *different* components
   can still change the result. All of these that pass the filters are verified, by an
   equi-join on the shingle and the size's bucket between the rows that are apart from
   their hub and all rows, and likewise by an equi-join on the group between its members, whose prefix shingles
   need not occur in any other group.

No bucket, partner or candidate is capped, and all links that join components are
found, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.components import components
from tessera.llm.store import Workspace, few

#: Counters of the sketch: 2**SKETCH_BITS, whatever the input's size.
SKETCH_BITS = 21
SKETCH_BLOCKS = 64
#: Pairs that may be broadcast to pick the texts to verify (24 bytes each); beyond it, a shuffle join.
BROADCAST_PAIRS = 200_000
#: Ids that may be broadcast to pick documents (8 bytes each).
BROADCAST_IDS = 500_000
#: Pairs of a hub that one task verifies; the hub's text travels once for as many.
HUB_SHARE = 250


def _need(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection for sizes n_a, n_b, times (100 + percent), as an integer comparison's right side."""
    return percent * (n_a + n_b)


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    waiting: list[np.ndarray] = []
    held = 0

    def add() -> None:
        nonlocal waiting, held
        if waiting:
            np.add(total, np.bincount(np.concatenate(waiting), minlength=len(total)), out=total)
        waiting, held = [], 0

    for batch in batches:
        for _, data, offsets in S.text_chunks(batch.column(0)):
            for one in S.sets(data, offsets):
                waiting.append((one >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                held += len(one)
            if held > 1 << 21:
                add()
    add()
    width = len(total) // SKETCH_BLOCKS
    wide = np.uint16 if total.max() < 1 << 16 else np.uint32 if total.max() < 1 << 32 else np.uint64
    blocks = [total[k * width : (k + 1) * width].astype(wide).tobytes() for k in range(SKETCH_BLOCKS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([np.dtype(wide).itemsize] * SKETCH_BLOCKS, pa.int32()), pa.array(blocks, pa.binary())], ["block", "bytes", "counts"])


def _sum_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for size, counts in zip(batch.column("bytes").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(counts.as_buffer(), f"u{size}").astype(np.uint64)
            total = part if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])


def shingle_sketch(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each of 2**SKETCH_BITS hash ranges occur in ``texts`` (one string column).

    Each task sends one fixed-size table, in blocks that are summed apart from each
    other; what reaches the driver is one fixed-size array (8 MB).
    """
    parts = texts.mapInArrow(_count_blocks, "block int, bytes int, counts binary")
    rows = parts.groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect()
    total = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint32)
    for block, counts in rows:
        total[block] = np.frombuffer(counts, np.uint32)
    return total.ravel()


def _signer(sketch, percent: int):
    """(id, text) -> (id, n, two digests of the set, digest of the prefix, prefix)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in S.text_chunks(batch.column(1)):
                sizes, keys, groups, prefixes = [], [], [], []
                for one in S.sets(data, offsets):
                    n = len(one)
                    sizes.append(n)
                    keys.append(S.set_key(one))
                    first = one[np.lexsort((one, counts[(one >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[: n - -(-n * percent // 100) + 1]] if n else one
                    groups.append(int(S.mix(first + np.arange(len(first), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    prefixes.append(first.view(np.int64))
                at = np.zeros(len(prefixes) + 1, np.int32)
                np.cumsum([len(p) for p in prefixes], out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sizes)), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))],
                    ["id", "n", "h1", "h2", "g", "prefix"],
                )

    return sign


def _runs(percent: int):
    """Rows (token, id, n, pos) sorted by token, pos, id -> the same rows without tokens that one row has, plus the run's hub.

    ``hub`` is the run's first id; ``near`` says whether the row passes the filters
    against it. Memory is one batch, whatever a run's length.
    """
    names = ["token", "id", "n", "pos", "hub", "near"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the current run's first row
        alone = False  # whether it is yet to be emitted
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            if not rows.shape[1]:
                continue
            carried = head is not None
            if carried:
                rows = np.concatenate([head[:, None], rows], 1)
            start = np.empty(rows.shape[1], bool)
            start[0] = True
            np.not_equal(rows[0, 1:], rows[0, :-1], out=start[1:])
            first = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
            single = start.copy()
            single[:-1] &= start[1:]
            keep = ~single
            if carried and not alone:
                keep[0] = False
            last = first[-1]
            head = rows[:, last].copy()
            alone = bool(single[-1]) and not (carried and not alone and last == 0)
            yield pack(rows[:, keep], rows[:, first[keep]])

    def pack(rows: np.ndarray, hubs: np.ndarray) -> pa.RecordBatch:
        _, ids, n, pos = rows
        least = np.minimum(n - pos, hubs[2] - hubs[3])
        near = (ids != hubs[1]) & (100 * np.minimum(n, hubs[2]) >= percent * np.maximum(n, hubs[2])) & ((100 + percent) * least >= _need(n, hubs[2], percent))
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(hubs[1]), pa.array(near)], names)

    return stream


def _verifier(percent: int):
    """Rows (a, b, text), sorted by (key, part, b, a nulls first) -> the linked (a, b).

    A row without ``a`` is a hub: its text's set is kept until the next hub. The rows after
    it are the texts to compare with it.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(0, np.uint64)
        for batch in batches:
            hub = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            linked = np.zeros(len(hub), bool)
            for row, data, offsets in S.text_chunks(batch.column(2)):
                for k, left in enumerate(S.sets(data, offsets), row):
                    if hub[k]:
                        right = left
                        continue
                    both = len(left) + len(right) - len(np.union1d(left, right))
                    linked[k] = both > 0 and 100 * both >= percent * (len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))

    return verify


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, space: Workspace, tag: str, repeats: bool, few_pairs: int, hub_share: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts pass; ``texts(id, text)``, in which ids may repeat if ``repeats``.

    The text of ``b`` travels once for each ``hub_share`` of its pairs, not once a pair, and
    a hub of very many pairs is dealt to as many tasks. ``key`` tells the texts of a repeated id apart.
    """
    pairs = pairs.distinct()
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / hub_share).alias("parts"))
    pairs = space.put(f"{tag}-pairs", pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")))
    near = F.broadcast if few(pairs, few_pairs) else lambda rows: rows
    texts = texts.withColumn("key", F.xxhash64("text") if repeats else F.lit(0).cast("long"))
    hubs = texts.join(near(pairs.select(F.col("b").alias("id"), "part").distinct()), "id").select(F.lit(None).cast("long").alias("a"), F.col("id").alias("b"), "part", "key", "text")
    if repeats:
        hubs = space.put(f"{tag}-hubs", hubs.dropDuplicates(["b", "part", "key"]))
        pairs = pairs.join(hubs.select("b", "part", "key"), ["b", "part"])
    else:
        pairs = pairs.withColumn("key", F.lit(0).cast("long"))
    compared = texts.drop("key").join(near(pairs.withColumnRenamed("a", "id")), "id").select(F.col("id").alias("a"), "b", "part", "key", "text")
    rows = hubs.unionByName(compared).repartition("b", "part", "key").sortWithinPartitions("b", "part", "key", F.asc_nulls_first("a"))
    return space.put(f"{tag}-links", rows.select("a", "b", "text").mapInArrow(_verifier(percent), "a long, b long"))


def _apart_in_groups(groups: DataFrame, shared: DataFrame, roots: DataFrame, space: Workspace) -> DataFrame:
    """``id_a, id``: pairs of one group's members in different components. Equal sizes and prefixes pass every filter, whatever other groups hold."""
    members = groups.where("members > 1").select("gid", F.col("gid").alias("id")).unionByName(shared.select("gid", F.col("member").alias("id")))
    members = members.join(roots.select(F.col("node").alias("id"), F.col("root").alias("own")), "id", "left")
    members = members.join(roots.select(F.col("node").alias("gid"), F.col("root").alias("gid_root")), "gid", "left")
    members = space.put("members", members.select("gid", "id", F.coalesce("own", "id").alias("own"), F.coalesce("gid_root", "gid").alias("gid_root")))
    apart = members.where("own <> gid_root").select("gid", F.col("id").alias("id_a"), F.col("own").alias("own_a"))
    return apart.join(members, "gid").where("own_a <> own").select("id_a", "id")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, few_pairs: int = BROADCAST_PAIRS, hub_share: int = HUB_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, class_id, component_id``.

    ``class_id`` is the least id with an equal shingle set, ``component_id`` the least
    id reachable by links. Defined cases: a null, empty or word-less text has
    ``n_shingles`` 0, links with nothing and is its own class and component; a text of
    fewer than five words has one shingle; rows that repeat an id are one node with
    several texts, linked if any of these is; a row with a null id has its size but null
    class and component, and links nothing; an empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(shingle_sketch(texts.select("text")))
    signed = space.put("signed", texts.mapInArrow(_signer(sketch, percent), "id long, n long, h1 long, h2 long, g long, prefix array<long>"))
    sketch.unpersist()

    heads = space.put("heads", signed.select("id", "n", "h1", "h2"))
    usable = signed.where("n > 0 AND id IS NOT NULL")
    classes = space.put("classes", usable.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.min("g").alias("g")))
    groups = space.put("groups", classes.groupBy("n", "g").agg(F.min("rep").alias("gid"), F.count("*").alias("members")))
    shared = classes.join(groups.where("members > 1").drop("members"), ["n", "g"]).where("rep <> gid").select(F.col("rep").alias("member"), "gid")
    shared = space.put("shared", shared)

    firsts = groups.select(F.col("gid").alias("id"), "n", "g")
    tokens = usable.select("id", "n", "g", "prefix").join(firsts, ["id", "n", "g"], "left_semi").select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    runs = tokens.repartition(F.col("token")).sortWithinPartitions("token", "pos", "id")
    runs = runs.select("token", "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    runs = space.put("runs", runs.mapInArrow(_runs(percent), "token long, id long, n long, pos long, hub long, near boolean"))

    pairs = runs.where("near").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    twice = heads.where("n > 0 AND id IS NOT NULL").groupBy("id").count().where("count > 1").select("id")
    repeats = not twice.isEmpty()
    verify = lambda rows, tag: _linked(rows, texts, percent, space, tag, repeats, few_pairs, hub_share)
    space.drop("signed")
    links = verify(pairs.unionByName(shared.select(F.col("member").alias("a"), F.col("gid").alias("b"))), "hub")
    if repeats:  # the texts of one id are one node, whatever documents stand for their classes
        own = heads.join(twice, "id", "left_semi").join(classes, ["n", "h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = space.put("own-links", links.unionByName(own.where("a <> b")))
    roots = space.put("roots-1", components(links, space, "stars-1"))

    expanded = runs.unionByName(runs.join(shared, runs["id"] == shared["gid"]).select("token", F.col("member").alias("id"), "n", "pos", "hub", "near"))
    named = expanded.join(roots.select(F.col("node").alias("id"), F.col("root").alias("own")), "id", "left")
    named = named.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    named = named.select("token", "id", "n", "pos", F.coalesce("own", "id").alias("own"), F.coalesce("hub_root", "hub").alias("hub_root"))
    named = space.put("named", named)
    space.drop("runs")
    # sizes that can link differ by one bucket at most; the base is a little above 100 / percent, so that rounding cannot part them
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.2 / percent))).cast("int")
    apart = named.where("own <> hub_root").select("token", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "pos", "own")))
    rest = apart.join(named.withColumn("bucket", bucket), ["token", "bucket"]).where(
        (F.col("own_a") != F.col("own"))
        & (F.least("n_a", "n") * 100 >= F.greatest("n_a", "n") * percent)
        & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("n_a") + F.col("n")) * percent)
    )
    rest = rest.select("id_a", "id").unionByName(_apart_in_groups(groups, shared, roots, space))
    late = verify(rest.select(F.greatest("id_a", "id").alias("a"), F.least("id_a", "id").alias("b")), "rest")
    roots = space.put("roots-2", components(links.unionByName(late), space, "stars-2"))

    space.drop("named")
    space.drop("members")

    found = classes.select("n", "h1", "h2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    found = space.put("found", found.select("n", "h1", "h2", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id")))
    whole = heads.join(found, ["n", "h1", "h2"], "left")
    own = F.when(F.col("id").isNotNull(), F.col("class_id"))
    return whole.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce(own, "id").alias("class_id"),
        F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), "id").alias("component_id"),
    )
