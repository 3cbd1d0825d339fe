"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity
of at least ``percent`` / 100, exactly, by a token-group matrix.

1. Documents with equal sets become one class, found by a 128-bit digest.
2. A class keeps a prefix of its tokens in one global order (frequent tokens
   last); two linked classes share a token of their prefixes. Prefix tokens that
   no other class has are dropped after a count by token.
3. Similar classes are partitioned into groups: each bucket of a shared token
   proposes its most typical class as leader, and classes linked to a leader
   form one group. A bucket costs one pair a member, not all pairs.
4. Each group stores its token union as a row of bits (the token-group matrix).
   A class and a group of another leader that share a prefix token are bounded:
   a class's bits that the union lacks are tokens that no member has. Only
   groups that can still reach the threshold are opened, and their members are
   bounded one by one by their own bits.
5. Pairs that pass are verified on the whole sets. Every pair that shares a
   prefix token is either inside one group or went through step 4, so the
   components are exact.

The order of step 2 comes from counts over all documents; at most
``FREQUENT_TOKENS`` tokens, the most frequent, are told apart from the others.
Any order is exact; only speed depends on it. Sets are made again from the texts of
the classes to verify: their ids are broadcast below ``MAX_BROADCAST_IDS``, else
joined by a shuffle.

Defined results: null and empty texts have an empty set, link with nothing and
are their own component; a text of fewer words than a shingle is one shingle;
repeated rows are equal documents; ids that are null count as the largest; very
long texts are sets like others; an empty table gives no row; columns other than
id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, prepare, worker_cache, written
from sightline.llm.repeats import mix, widen, with_row_id

SHINGLE = 5
PERCENT = 80
FREQUENT_TOKENS = 1 << 20
FREQUENT_MIN = 4
BLOCK_TOKENS = 1 << 21
MAX_BROADCAST_IDS = 1_000_000
CELLS_PER_TOKEN = 32
GROUP_MEMBERS = 64


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct identifiers of all runs of ``size`` words, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(widen({1: mix(ids, ids)}, min(size, len(ids))))


def cell_bits(tokens: np.ndarray) -> bytes:
    """One bit for each token's cell."""
    cells = 1 << int(CELLS_PER_TOKEN * max(len(tokens), 8) - 1).bit_length()
    bits = np.zeros(cells, np.uint8)
    bits[(tokens & np.uint64(cells - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bits over fewer cells; cells are the low bits of a token."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def most_shared(n: int, mine: bytes, other: bytes) -> int:
    """At most so many of ``n`` tokens with bits ``mine`` are among ``other``."""
    a, b = np.frombuffer(mine, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(a), len(b))
    return n - int(np.bitwise_count(fold(a, size) & ~fold(b, size)).sum())


def probe_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set that must hold one of any linked set's: it shares at
    least ceil(n * percent / 100)."""
    return n - -(-n * percent // 100) + 1


def index_length(n: int, percent: int = PERCENT) -> int:
    """The same against sets that are not smaller: it shares at least
    ceil(2 n percent / (100 + percent))."""
    return n - -(-2 * n * percent // (100 + percent)) + 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
            yield rid, text.as_py()


def token_key(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The leading bits of tokens: their bucket and 32 bits after it."""
    return tokens >> np.uint64(32 - (buckets.bit_length() - 1))


def frequent_tokens(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Keys of at most ``FREQUENT_TOKENS`` tokens, the most frequent last, and
    the number of buckets that ``token_key`` takes.

    All tokens of all sets are counted by key.  Tasks add up blocks of sets and
    send each bucket's keys as packed arrays of four bytes a token (with counts
    only where a block has several), so little is shuffled and a token of very
    many documents weighs no more than any other.  A key that several tokens
    share may put a rare one late, which costs time only."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(6, (4 * partitions - 1).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(sets):
            keys, n = np.unique(token_key(np.concatenate(sets), buckets), return_counts=True)
            ends = np.searchsorted(keys >> np.uint64(32), np.arange(buckets, dtype=np.uint64), side="right")
            once, several, counts = [], [], []
            for a, b in zip([0, *ends], ends):
                low, c = keys[a:b].astype(np.uint32), n[a:b]
                once.append(low[c == 1].tobytes())
                several.append(low[c > 1].tobytes())
                counts.append(c[c > 1].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(range(buckets), pa.int32()), *[pa.array(x, pa.binary()) for x in (once, several, counts)]],
                names=["bucket", "once", "several", "counts"])

        worker_cache("jaccard")
        sets, size = [], 0
        for _, text in _texts(batches):
            sets.append(shingle_set(text))
            size += len(sets[-1])
            if size >= BLOCK_TOKENS:
                yield packed(sets)
                sets, size = [], 0
        if size:
            yield packed(sets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for bucket, once, several, counts in zip(*[b.column(i).to_pylist() for i in range(4)]):
                held.setdefault(bucket, []).extend([
                    (np.frombuffer(once, np.uint32).astype(np.uint64) << np.uint64(32)) | np.uint64(1),
                    (np.frombuffer(several, np.uint32).astype(np.uint64) << np.uint64(32)) | np.frombuffer(counts, np.uint32)])
        for bucket, parts in held.items():
            pairs = np.sort(np.concatenate(parts))  # key and count in one number
            if not len(pairs):
                continue
            low = pairs >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            n = np.add.reduceat((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), starts)
            often = n >= FREQUENT_MIN
            keys = low[starts][often].astype(np.int64) + (bucket << 32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[often])], names=["key", "n"])

    counted = rows.select("rid", "text").mapInArrow(pack, "bucket int, once binary, several binary, counts binary")
    sums = written(counted.repartition(F.col("bucket")).mapInArrow(add, "key long, n long"), "jaccard-frequent")
    # the smallest count that leaves few enough keys: a row for each count
    steps = sums.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()
    total, least = 0, None
    for n, keys in sorted(((r["n"], r["count"]) for r in steps), reverse=True):
        total += keys
        if total > FREQUENT_TOKENS:
            break
        least = n
    found = []
    if least is not None:  # as packed arrays: rows would take the driver many times their bytes
        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0).to_numpy().tobytes()]), pa.array([b.column(1).to_numpy().tobytes()])],
                    names=["keys", "counts"])

        found = (sums.where(F.col("n") >= least).select("key", "n")
                 .mapInArrow(arrays, "keys binary, counts binary").collect())
    keys = np.frombuffer(b"".join(r["keys"] for r in found), np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in found), np.int64)
    discard(sums)
    return keys[np.lexsort((keys, counts))], buckets


def class_sets(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, n, d1, d2, typical, prefix) of each row: set size and digest,
    how frequent its tokens are on average (0 to 1) and its prefix in the global
    order."""
    frequent, buckets = frequent_tokens(rows)
    by_key = np.argsort(frequent)
    known = rows.sparkSession.sparkContext.broadcast((frequent[by_key], by_key.astype(np.int32)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        keys, rank = known.value
        for b in batches:
            out = []
            for rid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = shingle_set(text.as_py())
                n = len(s)
                if not n:
                    out.append((rid, doc_id, 0, 0, 0, 0.0, []))
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d1, d2 = np.frombuffer(digest, np.int64).tolist()
                order, typical = s, 0.0
                if len(keys):
                    mine = token_key(s, buckets)
                    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    often = keys[at] == mine
                    if often.any():  # by rank, then by token: the same order in every set
                        late = s[often]
                        ranks = rank[at[often]]
                        order = np.concatenate([s[~often], late[np.argsort(ranks, kind="stable")]])
                        typical = float((ranks + 1).sum() / len(keys) / n)
                prefix = order[:probe_length(n, percent)].view(np.int64)
                out.append((rid, doc_id, n, d1, d2, typical, prefix))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)],
                    names=["rid", "doc_id", "n", "d1", "d2", "typical", "prefix"])

    return rows.select("rid", F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, "rid long, doc_id long, n int, d1 long, d2 long, typical double, prefix array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the smallest node it
    reaches.  Labels spread to neighbours, then jump to their label's label,
    until nothing changes; each round is a written table."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-0")
    for i in itertools.count(1):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(spread.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-{i}")
        labels = new.select("node", "label")
        if new.where("old <> label").limit(1).count() == 0:
            return labels


def _sized(a, b, percent: int):
    """Sizes that a linked pair can have."""
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def needed(n: int, m: int, percent: int) -> int:
    """Tokens that linked sets of ``n`` and ``m`` tokens share at least."""
    return -(-percent * (n + m) // (100 + percent))


def _bounded(pairs: DataFrame, percent: int, both: bool = True) -> DataFrame:
    """Rows (a, b, n, bits, m, other) whose bits allow the threshold for sets of
    ``n`` and ``m`` tokens; with ``both`` seen from either side."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, x, m, y in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                need = needed(n, m, percent)
                ok.append(most_shared(n, x, y) >= need and (not both or most_shared(m, y, x) >= need))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "n", "bits", "m", "other").mapInArrow(keep, "a long, b long")


def _group_bits(members: DataFrame) -> DataFrame:
    """(label, bits): the token union of each group, over its smallest member's
    cells.  Unions are streamed: first by salted parts of a group,
    then by group."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                names=["label", "bits"])

        for b in batches:
            for label, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(bits, np.uint8)
                if label in held:
                    size = min(len(x), len(held[label]))
                    x = fold(x, size) | fold(held[label], size)
                held[label] = x
            if len(held) > 20_000:
                yield out()
                held.clear()
        if held:
            yield out()

    kind = "label long, bits binary"
    salted = members.repartition(F.col("label"), F.pmod(F.xxhash64("cid"), F.lit(32)))
    parts = salted.select("label", "bits").mapInArrow(union, kind)
    # a flush may leave several rows of one group, each the union of some members;
    # that is as good: a member that a class links to is in one of them
    return parts.repartition(F.col("label")).mapInArrow(union, kind)


def _of_classes(rows: DataFrame, ids: DataFrame, make, name: str) -> DataFrame:
    """(rid, value) for the classes in ``ids``: ``make`` of each one's set, made
    again from its text."""
    asked = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [make(shingle_set(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["rid", "value"])

    # equal rows have equal sets: one of them is enough
    return written(rows.join(asked, "rid", "left_semi").select("rid", "text")
                   .mapInArrow(sets, "rid long, value binary").dropDuplicates(["rid"]), name)


def verified(pairs: DataFrame, rows: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""
    pairs = written(pairs.distinct(), f"{name}-pairs")
    ids = written(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), f"{name}-ids")
    tokens = _of_classes(rows, ids, lambda s: s.tobytes(), f"{name}-sets")
    left = tokens.select(F.col("rid").alias("a"), F.col("value").alias("x"))
    right = tokens.select(F.col("rid").alias("b"), F.col("value").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                    .mapInArrow(check, "a long, b long"), f"{name}-links")
    discard(pairs, ids, tokens)
    return links


def class_links(sets: DataFrame, classes: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) links between classes that give the exact components.  ``classes``
    has cid, n and prefix."""
    tokens = classes.select("cid", "n", F.posexplode("prefix").alias("at", "token"))
    indexed = F.col("at") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    tokens = tokens.select("token", "cid", "n", indexed.alias("indexed"))
    # counts are written before a join: Spark splits a hot key's rows only where
    # no aggregate needs them together
    buckets = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max("indexed").alias("i"))
                      .where("c > 1 and i").select("token"), "jaccard-buckets")
    shared = written(tokens.join(buckets, "token"), "jaccard-shared")
    discard(buckets)
    ids = written(shared.select(F.col("cid").alias("rid")).distinct(), "jaccard-ids")
    bits = _of_classes(rows, ids, cell_bits, "jaccard-bits")
    sizes = sets.select("rid", "n", "typical").dropDuplicates(["rid"])
    cells = written(bits.join(sizes, "rid").select(F.col("rid").alias("cid"), "n", "typical", F.col("value").alias("bits")),
                    "jaccard-cells")
    discard(ids, bits)

    # leaders: of each bucket the class whose whole set is the most frequent; the
    # origin of edited copies has all of their common tokens and no edit's
    ranked = shared.join(cells.select("cid", "typical"), "cid")
    leaders = written(ranked.groupBy("token").agg(F.max(F.struct("typical", "n", "cid")).alias("lead")).select(
        "token", F.col("lead.cid").alias("b"), F.col("lead.n").alias("m")), "jaccard-leaders")
    stars = shared.join(leaders, "token").where(F.col("cid") != F.col("b")).where(_sized(F.col("n"), F.col("m"), percent))
    stars = stars.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()
    mine = cells.select(F.col("cid").alias("a"), "n", "bits")
    other = cells.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    near = _bounded(stars.join(mine, "a").join(other, "b"), percent)  # of each bucket one pair a member
    links = verified(near, rows, percent, "jaccard-stars")

    # groups of a leader's classes, in parts of about GROUP_MEMBERS; what shares a
    # prefix token across groups is asked from the smaller group's side
    labels = components(links, "jaccard-groups").select(F.col("node").alias("cid"), "label")
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    grouped = labels.join(written(counts, "jaccard-sizes"), "label")
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / GROUP_MEMBERS))
    members = written(cells.join(grouped, "cid", "left").select(
        "cid", "n", "bits", F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("label", "cid").alias("label")).alias("label"),
        F.when(F.col("size").isNull(), F.col("cid")).otherwise(F.xxhash64("label", part)).alias("g")), "jaccard-members")
    placed = shared.join(members.select("cid", "label", "g"), "cid")
    open_tokens = written(placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                          .where("lo <> hi").select("token"), "jaccard-open")
    rest = written(placed.join(open_tokens, "token"), "jaccard-rest")
    per_group = written(rest.groupBy("token", F.col("label").alias("other_label"), "g").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("indexed").alias("any_indexed")), "jaccard-tokens")
    met = (rest.drop("g").join(per_group, "token")
           .where((F.col("label") < F.col("other_label")) & (F.col("indexed") | F.col("any_indexed")))
           .where((F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent))
           .select(F.col("cid").alias("a"), F.col("g").alias("b")).distinct())
    unions = _group_bits(members.select(F.col("g").alias("label"), "cid", "bits")).select(
        F.col("label").alias("b"), F.col("bits").alias("other"))
    smallest = written(members.groupBy(F.col("g").alias("b")).agg(F.min("n").alias("least")), "jaccard-least")
    asked = met.join(mine, "a").join(smallest, "b").join(unions, "b").withColumn(
        "m", F.greatest("least", F.ceil(F.col("n") * percent / 100).cast("int")))
    opened = _bounded(asked, percent, both=False).distinct()
    inside = members.select("g", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    pairs = (opened.select("a", F.col("b").alias("g")).join(mine, "a").join(inside, "g")
             .where(_sized(F.col("n"), F.col("m"), percent)))
    more = verified(_bounded(pairs, percent), rows, percent, "jaccard-pairs")
    discard(shared, cells, leaders, members, open_tokens, rest, per_group, smallest)
    return links.unionByName(more)


def similar_components(docs: DataFrame, percent: int = PERCENT, text_col: str = "text",
                       id_col: str = "doc_id") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, first_rid) for each row:
    the smallest doc_id of its component and the row that has it."""
    prepare(docs.sparkSession)
    rows = with_row_id(docs, text_col, id_col)
    full = written(class_sets(rows, percent), "jaccard-full")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = written(full.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min(ident).alias("least"), F.first("prefix").alias("prefix")).select(
        F.col("least.rid").alias("cid"), "n", "prefix"), "jaccard-classes")
    sets = written(full.drop("prefix"), "jaccard-sets")
    discard(full)
    digests = sets.where("n > 0").groupBy("d1", "d2", "n")
    links = class_links(sets, classes, rows, percent)
    discard(classes)
    labels = components(links, "jaccard-labels")
    named = digests.agg(F.min(ident).alias("least")).withColumn("cid", F.col("least.rid"))
    named = named.join(labels, named["cid"] == labels["node"], "left").select(
        "d1", "d2", "n", "least", F.coalesce("label", "cid").alias("label"))
    firsts = named.groupBy("label").agg(F.min("least").alias("first"))
    placed = named.join(firsts, "label").select("d1", "d2", "n", "first")
    out = sets.select("rid", "doc_id", "n", "d1", "d2").join(placed, ["d1", "d2", "n"], "left")
    return out.select("rid", "doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.coalesce("first.rid", "rid").alias("first_rid"))


def oracle_sql() -> str:
    """The registered query as DuckDB SQL: all pairs that share a shingle, and
    everything that links reach."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + {SHINGLE - 1}], ' ')) AS x
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_sets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
              FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_sets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
         WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION
          SELECT reach.doc_id, step.b FROM reach JOIN step ON step.a = reach.r)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM d JOIN reach ON d.doc_id = reach.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""
