"""MinHash near-duplicate groups by a chosen-path set similarity join.

A document is the set of its word shingles and a signature of ``COORDINATES`` minwise tokens.
Each of ``trees`` independent trees starts from all distinct sets.  A node chooses one or two
coordinates (4/3 on average, the inverse of the threshold) and deals its members to children by
their minwise token there, so two sets of the threshold's similarity share one child or more on
average; the first two levels are taken at once.  The join has two passes.

The first proposes a number of pairs linear in the rows, which are confirmed on the full shingle
sets and give groups: each member of a small node with the node's most central member and those it
agrees with most, each member of a large node with the few centres it resembles.  A large node ends
there unless many of its members resemble no centre; then it branches on.

The second looks for links between these groups, in every node that has ended: a small node compares
all of its members; a large one those outside its largest group with all, block against block, or
branches on while those are many.  Members whose signatures leave a similarity of the threshold
possible bring their full sets, the node compares them exactly, and gives a link only where it joins
two groups: fewer than it has members, however many pairs are similar.

Cases: a text without words, or null, has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; equal sets are one node, whatever their number of copies;
repeated rows each get a row; a row without doc_id is linked but never gives its group's id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.components import components
from tapeloom.llm.hashing import mix
from tapeloom.llm.shared import byte_slices, discard, durable, whole_groups
from tapeloom.llm.shingles import shingle_sets

WIDTH, SIMILARITY = 5, (75, 100)
COORDINATES, TREES, SMALL, LEVELS = 64, 5, 512, 5
#: Share of equal coordinates from which a pair is compared on full sets (a pair of exactly the
#: threshold's similarity falls below it once in 100,000), and from which a member of a large node is
#: taken to belong to a centre when it is decided whether the node must branch on.
HOPEFUL, CERTAIN = 0.5, 0.85
#: A node of at most so many times small is compared in blocks at once instead of branching.
BLOCKS = 4
#: Centres of a large node; partners that a member of a small node proposes besides its centre.
CENTRES, PARTNERS = 4, 3
#: Members of a large node among which its centres are chosen, in expectation.
SAMPLE = 64
SLICE_BYTES = 1 << 20
#: Shingles of a set that count as one member; a longer set counts as several, so that the full sets
#: of a small node or block stay within about small * 16 KB.
WEIGHT = 2048
#: Candidate pairs that are confirmed together.
PAIRS_TOGETHER = 500
#: Documents whose ids may be broadcast to pick their texts; beyond it that join is shuffled.
BROADCAST_ROWS = 1_000_000

_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minwise tokens of each set; an empty set has zeros."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)  # the low half of these travels on
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k, m in enumerate(_MULTIPLIERS):
            out[full, k] = np.minimum.reduceat(flat * m, starts).astype(np.uint32)
    return out


def _chosen(node: F.Column) -> tuple[F.Column, F.Column]:
    """The coordinate that a node chooses, and a second one or null."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES))
    step = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDINATES - 1)) + 1
    second = F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(3)) == 0, F.pmod(first + step, F.lit(COORDINATES)))
    return first, second


def _children(rows: DataFrame) -> DataFrame:
    """(node, key, weight) of the children's members for rows (node, key, sig, weight)."""

    def child(k: F.Column) -> F.Column:
        return F.when(k.isNotNull(), F.xxhash64("node", k, F.substring("sig", k * 2 + 1, F.lit(2))))

    at = F.array(*(child(k.cast("int")) for k in _chosen(F.col("node"))))
    return rows.select("key", "weight", F.explode(F.array_compact(at)).alias("node")).select("node", "key", "weight")


def _by_node(rows: DataFrame, work: Callable[[list[bytes], np.ndarray, list], Iterator], schema: str, with_node: bool = False) -> DataFrame:
    """Apply work(keys, signatures, more) to the rows (node, key, sig, more) of each node, with the
    node before each row of the result on request.

    Only for nodes whose size is bounded.
    """
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    fields = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "node"):
            keys, more = table.column("key").to_pylist(), table.column("more").to_pylist()
            sigs, nodes = _sketches(table.column("sig")), table.column("node").to_pylist()
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                found = work(keys[a:b], sigs[a:b], more[a:b])
                out += [(nodes[a], *x) for x in found] if with_node else found
            columns = zip(*out, strict=True) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    ordered = rows.select("node", "key", "sig", "more").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, schema)


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COORDINATES)


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The share of equal coordinates of each of left with each of right."""
    return np.count_nonzero(left[:, None, :] == right[None, :, :], axis=2) / COORDINATES


def _pair(one: bytes, two: bytes) -> tuple[bytes, bytes]:
    return (one, two) if one < two else (two, one)


def _pairs_within(keys: list[bytes], sigs: np.ndarray, more: list) -> Iterator[tuple[bytes, bytes]]:
    """All members are compared; each is paired with the node's most central member and with those
    that it agrees with most, as far as they may be similar enough. For groups that suffices: what
    links a group are its closest pairs."""
    like = _agreement(sigs, sigs)
    np.fill_diagonal(like, -1)
    centre = int(like.sum(1).argmax())
    found = {(min(i, centre), max(i, centre)) for i in np.flatnonzero(like[centre] >= HOPEFUL).tolist()}
    closest = np.argsort(-like, axis=1, kind="stable")[:, :PARTNERS]
    for i, j in zip(np.repeat(np.arange(len(keys)), closest.shape[1]).tolist(), closest.reshape(-1).tolist(), strict=True):
        if like[i, j] >= HOPEFUL:
            found.add((min(i, j), max(i, j)))
    for i, j in found:
        yield _pair(keys[i], keys[j])


#: Marks of a node's rows: it is compared with all rows that have the second mark, it is among
#: those, all of the node is here.
ASKS, ANSWERS, WHOLE = 1, 2, 4


def _unresolved(keys: list[bytes], sigs: np.ndarray, more: list) -> Iterator[tuple[bytes, int, int]]:
    """(key, group, marks) of the rows of different groups that may be similar enough. more is the
    group, and the marks in its three lowest bits."""
    packed = np.array(more, np.int64)
    groups, marks = packed >> 3, packed & 7
    if (groups == groups[0]).all():
        return
    asks, answers = np.flatnonzero(marks & ASKS), np.flatnonzero(marks & ANSWERS)
    if marks[0] & WHOLE:
        names, counts = np.unique(groups, return_counts=True)
        asks = np.flatnonzero(groups != names[counts.argmax()])
    if len(asks) and len(answers):
        near = (groups[asks][:, None] != groups[answers][None, :]) & (_agreement(sigs[asks], sigs[answers]) >= HOPEFUL)
        found = dict.fromkeys(asks[near.any(1)].tolist(), ASKS)
        for i in answers[near.any(0)].tolist():
            found[i] = found.get(i, 0) | ANSWERS
        for i, mark in found.items():
            yield keys[i], int(groups[i]), mark


def _spanning(
    keys: list[bytes], groups: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]
) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of enough similarity, each of which joins two groups that were apart until then."""
    part_of, whole = similarity
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum([0, *sizes[:-1]])
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held, groups = np.zeros(len(tokens), bool), groups.copy()
    answers = (marks & ANSWERS) > 0
    for i in np.flatnonzero(marks & ASKS).tolist():
        apart = answers & (groups != groups[i])
        if apart.any():
            own = flat[starts[i] : starts[i] + sizes[i]]
            held[own] = True
            common = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[own] = False
            for j in np.flatnonzero(apart & (whole * common >= part_of * (sizes[i] + sizes - common))).tolist():
                if groups[j] != groups[i]:
                    groups[groups == groups[j]] = groups[i]
                    yield _pair(keys[i], keys[j])


def _centres(keys: list[bytes], sigs: np.ndarray, more: list) -> Iterator[tuple[int, bytes, bytes]]:
    """The most central of a sample of members, and others far from those before."""
    like = _agreement(sigs, sigs)
    chosen = [int(like.sum(1).argmax())]
    while len(chosen) < min(CENTRES, len(keys)):
        nearest = like[chosen].max(0)
        if nearest.min() >= CERTAIN:
            break
        chosen.append(int(nearest.argmin()))
    for i in chosen:
        yield more[0], keys[i], sigs[i].tobytes()


def _nearest_centre(rows: DataFrame) -> DataFrame:
    """rows (node, key, sig, weight, centres) with like, a member's agreement with its closest
    centre, and partners: the centres that it may be similar enough to."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = _sketches(batch.column("sig"))
            partners, likes = [], []
            for i, centres in enumerate(batch.column("centres").to_pylist()):
                like = _agreement(sigs[i : i + 1], _sketches(pa.array([c["sig"] for c in centres], pa.binary())))[0]
                own = batch.column("key")[i].as_py()
                partners.append([c["key"] for c, x in zip(centres, like, strict=True) if x >= HOPEFUL and c["key"] != own])
                likes.append(float(like.max()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "key", "sig", "weight")), pa.array(partners, pa.list_(pa.binary())), pa.array(likes)],
                ["node", "key", "sig", "weight", "partners", "like"],
            )

    return rows.select("node", "key", "sig", "weight", "centres").mapInArrow(
        compare, "node long, key binary, sig binary, weight long, partners array<binary>, like double"
    )


def _row_key(docs: DataFrame) -> F.Column:
    """A key of doc_id and text in which nulls count."""
    name, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return F.xxhash64(name.isNull(), name, text.isNull(), text)


def document_sets(docs: DataFrame, width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """doc_id, row (a key of doc_id and text), n_shingles, key (a 128-bit fingerprint of the set;
    null if empty), sig, roots."""
    roots = [path for t in range(trees) for path in _first_paths(t)]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(part.column("text"), width)
            sigs = signatures(sets)
            paths = np.empty((len(sets), len(roots)), np.int64)
            for j, (one, two) in enumerate(roots):
                both = sigs[:, one].astype(np.uint64) << np.uint64(32) | sigs[:, two]
                paths[:, j] = mix(both + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "row": part.column("row"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([s.tobytes() for s in sigs.astype(np.uint16)], pa.binary()),
                    "roots": pa.array(paths.tolist(), pa.list_(pa.int64())),
                }
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(sets_of, "doc_id long, row long, n_shingles long, key binary, sig binary, roots array<long>")


def _first_paths(tree: int) -> list[tuple[int, int]]:
    """The coordinates of a tree's first two levels, which are taken at once: 16/9 paths on average,
    as two choices of 4/3 make."""
    order = np.random.default_rng(1000 + tree).permutation(COORDINATES).tolist()
    return [(order[0], order[1]), (order[2], order[3])][: 1 if tree % 5 == 4 else 2]


def _sized(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows (node, key, weight, sig, n, size) of the nodes of more than one member."""
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("size")).where("n > 1")
    return members.join(sizes, "node").join(sigs, "key")


def candidates(sets: DataFrame, small: int = SMALL, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(a, b): pairs of keys that share a small node, or a large node's centre, and whose
    signatures leave a similarity of the threshold possible. sets has key, sig, weight, roots.

    Also the small nodes and the large ones that ended, (node, key, sig, weight), and the tables
    behind all of these.
    """
    sigs = sets.select("key", "sig")
    members = sets.select(F.explode("roots").alias("node"), "key", "weight")
    found: list[DataFrame] = []
    few_nodes: list[DataFrame] = []
    ended: list[DataFrame] = []
    tables: list[DataFrame] = []
    for level in range(levels):
        rows = durable(_sized(members, sigs), f"nodes{level}")
        tables.append(rows)
        few = rows.where(F.col("size") <= small).select("node", "key", "sig", "weight")
        found.append(_by_node(few.withColumn("more", F.lit(0).cast("long")), _pairs_within, "a binary, b binary"))
        few_nodes.append(few)
        large = rows.where(F.col("size") > small)
        if large.isEmpty():
            break
        sample = large.where(F.pmod(F.xxhash64("node", "key"), F.col("n")) < SAMPLE)
        picked = _by_node(
            sample.select("node", "key", "sig", F.col("node").alias("more")), _centres, "node long, key binary, sig binary"
        )
        centres = picked.groupBy("node").agg(F.collect_list(F.struct("key", "sig")).alias("centres"))
        near = durable(_nearest_centre(large.join(centres, "node")), "near")
        tables.append(near)
        pairs = near.select("key", F.explode("partners").alias("centre"))
        found.append(pairs.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")))
        if level + 1 == levels:
            ended.append(near.select("node", "key", "sig", "weight"))
            break
        loose = near.groupBy("node").agg(F.count_if(F.col("like") < CERTAIN).alias("loose"), F.sum("weight").alias("size"))
        branching = loose.where((F.col("loose") > small) & (F.col("size") > BLOCKS * small)).select("node")
        ended.append(near.join(branching, "node", "left_anti").select("node", "key", "sig", "weight"))
        members = durable(_children(near.join(branching, "node", "left_semi")), "members")
        tables.append(members)
        if members.isEmpty():
            break
    return durable(_union(found).distinct(), "candidates"), few_nodes, ended, tables


def _union(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every


def left_out(
    sets: DataFrame, few_nodes: list[DataFrame], ended: list[DataFrame], groups: DataFrame, small: int, levels: int
) -> tuple[DataFrame, list[DataFrame]]:
    """(node, key, group, marks): the rows whose full sets must be compared within node as they may
    link different groups (key, group); and the tables behind. Node ids of all tables are hashes."""

    def packed(rows: DataFrame, marks: int) -> DataFrame:
        return rows.select("node", "key", "sig", F.shiftleft("group", 3).bitwiseOR(F.lit(marks)).alias("more"))

    def grouped(rows: DataFrame) -> DataFrame:
        own = rows.join(groups, "key", "left")
        return own.withColumn("group", F.shiftright(F.coalesce("group", F.xxhash64("key")), 4))

    compared = [packed(grouped(_union(few_nodes)), ASKS | ANSWERS | WHOLE)]
    tables: list[DataFrame] = []
    large = _union(ended) if ended else None
    for level in range(levels):
        if large is None:
            break
        rows = durable(grouped(large), "large")
        tables.append(rows)
        by_group = rows.groupBy("node", "group").agg(F.sum("weight").alias("size"))
        totals = by_group.groupBy("node").agg(
            F.max_by("group", F.struct("size", "group")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most")
        )
        mixed = rows.join(totals.where("size > most"), "node")
        at_once = F.lit(level + 1 == levels) | (F.col("size") - F.col("most") <= small) | (F.col("size") <= BLOCKS * small)
        here = mixed.where(at_once)
        blocks, asking = F.ceil(F.col("size") / small), F.ceil((F.col("size") - F.col("most")) / small)
        up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        own = lambda n: F.pmod(F.xxhash64("key"), n)
        common = ["node", "key", "sig", "group"]
        asks = here.where("group != main").select(*common, own(asking).alias("x"), up_to(blocks).alias("y"))
        answers = here.select(*common, own(blocks).alias("y"), up_to(asking).alias("x"))
        for part, mark in ((asks, ASKS), (answers, ANSWERS)):
            compared.append(packed(part.withColumn("node", F.xxhash64("node", "x", "y")), mark))
        if level + 1 == levels:
            break
        members = durable(_children(mixed.where(~at_once)), "members")
        tables.append(members)
        if members.isEmpty():
            break
        sized = durable(_sized(members, sets.select("key", "sig")), "nodes")
        tables.append(sized)
        compared.append(packed(grouped(sized.where(F.col("size") <= small)), ASKS | ANSWERS | WHOLE))
        large = sized.where(F.col("size") > small).select("node", "key", "sig", "weight")

    return _by_node(_union(compared), _unresolved, "node long, key binary, group long, marks long", with_node=True), tables


def _full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, full) of the wanted keys, computed anew from one text of each. sets has key, doc_id."""
    where = durable(sets.join(wanted, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "wanted")
    ids = where.select("doc_id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(ids, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_slices(batches, "text", SLICE_BYTES):
            own = [s for s in shingle_sets(piece.column("text"), width) if len(s)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "full": pa.array([s.tobytes() for s in own], pa.binary())})

    return texts.mapInArrow(sets_of, "key binary, full binary").join(where.select("key"), "key", "left_semi").dropDuplicates(["key"])


def confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets have the similarity.

    Pairs are confirmed together by the least neighbour of their first key, in parts of about
    PAIRS_TOGETHER pairs, so a set travels once for many pairs.
    """
    both_ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = both_ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("hub"))
    placed = pairs.join(hubs, "a")
    sizes = placed.groupBy("hub").agg(F.ceil(F.count("*") / PAIRS_TOGETHER).alias("parts"))
    part = F.pmod(F.xxhash64("a", "b"), F.col("parts"))
    dealt = durable(placed.join(sizes, "hub").select("a", "b", F.xxhash64("hub", part).alias("part")), "dealt")
    needed = dealt.select("part", F.explode(F.array("a", "b")).alias("key")).distinct()
    full = _full_sets(docs, sets, needed.select("key").distinct(), width)
    rows = needed.join(full, "key").select("part", F.lit(0).alias("kind"), F.col("key").alias("x"), F.col("full").alias("y"))
    rows = rows.unionByName(dealt.select("part", F.lit(1).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y")))
    part_of, whole = similarity

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            out = []
            for p, kind, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != now:
                    now, known = p, {}
                if kind == 0:
                    known[x] = np.frombuffer(y, np.uint64)
                else:
                    one, two = known[x], known[y]
                    if part_of * max(len(one), len(two)) <= whole * min(len(one), len(two)):
                        common = len(np.intersect1d(one, two, assume_unique=True))
                        if whole * common >= part_of * (len(one) + len(two) - common):
                            out.append((x, y))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())}
            )

    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(compare, "a binary, b binary")


def between_groups(docs: DataFrame, sets: DataFrame, rows: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) of the similarity within the nodes of left_out() that join different groups."""
    whole = rows.join(_full_sets(docs, sets, rows.select("key").distinct(), width), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "node"):
            keys = table.column("key").to_pylist()
            groups, marks = (table.column(c).to_numpy() for c in ("group", "marks"))
            column = table.column("full")
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                sets_of = [np.frombuffer(x, np.uint64) for x in column.slice(a, b - a).to_pylist()]
                out += _spanning(keys[a:b], groups[a:b], marks[a:b], sets_of, similarity)
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())}
            )

    ordered = whole.select("node", "key", "group", "marks", "full").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(compare, "a binary, b binary")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component) with those put together that links (a, b) connect."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = ends.select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
    larger = durable(components(between), "larger").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    moved = groups.join(larger, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    # what had no group yet
    alone = larger.join(groups.select(F.col("component")), "component", "left_anti")
    return moved.unionByName(alone.select(F.col("component").alias("node"), F.col("whole").alias("component")))


def _grouped(docs: DataFrame, width: int, similarity: tuple[int, int], trees: int, small: int, levels: int) -> DataFrame:
    """doc_id, row, n_shingles, group (null for an empty set) of every row."""
    rows = durable(document_sets(docs, width, trees), "sets")
    weight = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_shingles") / WEIGHT)).alias("weight")
    sets = durable(rows.where("key is not null").dropDuplicates(["key"]).select("key", "sig", weight, "roots"), "distinct")
    named = rows.select("key", "doc_id").where("key is not null")
    pairs, few_nodes, ended, tables = candidates(sets, small, levels)
    groups = durable(components(durable(confirmed(docs, named, pairs, width, similarity), "links")), "groups")
    of = groups.select(F.col("node").alias("key"), F.xxhash64("component").alias("group"))
    others, more = left_out(sets, few_nodes, ended, of, small, levels)
    others = durable(others, "others")
    discard(*tables, *more, pairs)
    if not others.isEmpty():
        links = durable(between_groups(docs, named, others, width, similarity), "more_links")
        if not links.isEmpty():
            groups = _joined(groups, links)
    own = rows.select("doc_id", "row", "n_shingles", "key").join(groups.withColumnRenamed("node", "key"), "key", "left")
    return durable(own.withColumn("group", F.coalesce("component", "key")).drop("component", "key"), "grouped")


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: tuple[int, int] = SIMILARITY,
    trees: int = TREES,
    small: int = SMALL,
    levels: int = LEVELS,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of its group), kept."""
    own = _grouped(docs, width, similarity, trees, small, levels)
    least = own.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id")
    return own.join(least, "group", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def without_near_copies(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: tuple[int, int] = SIMILARITY,
    trees: int = TREES,
    small: int = SMALL,
    levels: int = LEVELS,
) -> DataFrame:
    """One row of docs of each group, that of the least doc_id (one without doc_id only where no
    row of the group has one); of rows without words each, but repeated ones once."""
    own = _grouped(docs, width, similarity, trees, small, levels)
    first = own.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stays = first.select("first.row").unionByName(own.where("group is null").select("row")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), _row_key(docs).alias("row"))
    return keyed.join(stays, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
