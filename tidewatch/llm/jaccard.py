"""N-gram Jaccard join: a MinHash LSH forest, followed by exact verification.

1. A task reduces each whole text to the set of its word n-grams and that to TREES paths of DEPTH MinHash labels. Texts
   with equal sets form one copy class and are one node from here on.
2. The paths of a tree, sorted, are a prefix trie. Leaves that share no prefix of even the floor depth - the longest at
   which a pair at the threshold meets in some tree with the target probability - can match nothing and go.
3. Matching begins at full depth. Nodes that share a prefix of that length in some tree are compared by sketches of all
   their labels, which rule out pairs far below the threshold. What a node has found, and how likely pairs of those
   similarities were to be found at this depth, gives an estimate of the node's recall, one unseen partner at the
   threshold itself included. Nodes that reach the target are closed; for the others the prefix is shortened by a label,
   and again, down to the floor, where a node without any partner reaches the target too. A prefix is looked at again
   only if it joins different subtrees and holds an open node, so large groups of copies end at long prefixes and lonely
   texts pay for short ones. What the sketches may lose is part of every estimate.
4. What was found is connected. Within a component every pair of sets is intersected exactly. A node's links are counted
   by copies; no pair is written for each of them, only a spanning forest, of which components are the classes.

Large groups. A prefix or a component with many nodes is cut into tiles by a hash of the node; a task gets two tiles at
a time, so all pairs are covered and no task gets a whole group. Tiles are cut by nodes and by bytes of their sets, so
long texts get tiles of few. Copies never leave their class, so a text that is a third of all rows counts as one node.

Defined cases: words are runs of characters that aren't ASCII white space; a text of fewer words than n has one n-gram,
all its words; a text without words (null, empty or white) links to nothing and is a class of its own; a very long text
is used whole, and its set alone may be larger than TILE_BYTES; repeated rows are copies; null ids are kept; of equal
similarities none goes before another; an empty table gives an empty result; only id and text are read, so other columns
never clash. The table must give the same rows in the same order when it is read again, as written tables do; each text
read again is compared with its first digest, and a difference is an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace
from .components import components

N, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET = 32, 8, 0.9999
#: Nodes a tile: of a shared prefix, and of a component; and bytes of the sets of a component's tile.
PREFIX_TILE, TILE, TILE_BYTES = 256, 64, 32 << 20
#: Neighbours on either side, in the order of the trie, that give a node's evidence.
NEAR = 32
_LABEL = 2  # bytes a label
#: Bits of each label in a sketch: unequal labels agree in them by chance once in 2 ** BITS, which comparisons allow for.
BITS = 4


def meets(similarity, depth: int, trees: int = TREES):
    """The probability that a pair of this similarity shares a prefix of `depth` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def agreement(similarity):
    """The share of labels of a pair of this similarity that agree in a sketch."""
    return similarity + (1 - similarity) / 2**BITS


def least_matches(threshold: float, size: int) -> int:
    """Labels of `size` that must agree in a sketch: five standard errors below what pairs at the threshold have."""
    share = agreement(threshold)
    return max(0, math.floor(size * (share - 5 * (share * (1 - share) / size) ** 0.5)))


def sketch_loss(threshold: float, size: int) -> float:
    """The probability that fewer labels than that agree for a pair at the threshold."""
    share = agreement(threshold)
    log = lambda k: math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) + k * math.log(share) + (size - k) * math.log1p(-share)
    return math.fsum(math.exp(log(k)) for k in range(least_matches(threshold, size))) if 0 < threshold < 1 else 0.0


def floor_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree and pass the sketches with the target
    probability: no node needs a shorter one, whatever it has found."""
    for p in range(depth, 0, -1):
        if meets(threshold, p, trees) - sketch_loss(threshold, trees * depth) >= target:
            return p
    raise ValueError("more trees are needed for this recall")


def recall(found: Column, expected: Column, p: int, threshold: float, trees: int = TREES, depth: int = DEPTH) -> Column:
    """A node's estimated recall at a depth: partners found over partners expected (the sum of 1 / probability to be found
    over those found), with one more that no one has seen, at the threshold."""
    unseen = meets(threshold, p, trees) - sketch_loss(threshold, trees * depth)
    return (found + F.lit(unseen)) / (expected + F.lit(1.0))


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return tuple(rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


_MIX = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit digests of the text's word n-grams."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    codes = np.fromiter((known[w] if w in known else known.setdefault(w, digest(w)) for w in words), np.uint64, len(words))
    size = min(n, len(words))
    count = len(codes) - size + 1
    mixed = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        mixed += codes[k : count + k] * _MIX[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[32 + k]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def min_hashes(grams: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, as 32-bit numbers."""
    low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(grams), 256):
        np.minimum(least, (low[i : i + 256, None] * first + high[i : i + 256, None] * second).min(0), out=least)
    return least


def labels_of(grams: np.ndarray, first: np.ndarray, second: np.ndarray) -> bytes:
    """The labels of all trees, big-endian, so that bytes sort as labels do. A label is 16 bits of the mixed smallest
    value: smallest values themselves crowd near zero for large sets."""
    return ((min_hashes(grams, first, second) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def sketch_of(labels: bytes) -> bytes:
    """BITS of each label, two labels a byte."""
    low = np.frombuffer(labels, ">u2").astype(np.uint8) & (2**BITS - 1)
    return (low[::2] << BITS | low[1::2]).tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """A row a sketch, a number a label."""
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.concatenate([packed >> BITS, packed & (2**BITS - 1)], axis=1)


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, seen: a digest of the text, node: digest of the n-gram set or null without words, size: its n-grams, paths:
    the labels of every tree, sketch: BITS of each). row numbers the rows of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _seeds(trees * depth)
        for batch in batches:
            nodes, sizes, paths, sketches = [], [], [], []
            for text in batch.column(3):
                grams = ngrams(text.as_py(), n)
                nodes.append(hashlib.md5(grams.tobytes()).hexdigest() if len(grams) else None)
                sizes.append(len(grams))
                paths.append(labels_of(grams, first, second) if len(grams) else None)
                sketches.append(sketch_of(paths[-1]) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), pa.array(paths, pa.binary()), pa.array(sketches, pa.binary())], ["row", "id", "seen", "node", "size", "paths", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("seen"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"row long, id {kind}, seen long, node string, size long, paths binary, sketch binary")


def _tiles(rows: DataFrame, group: list[str], tiles: Column, *order: str) -> DataFrame:
    """Sends each row to the pairs of tiles (a <= b) that it is needed in; own tells which of the two is its own."""
    rows = rows.withColumn("tiles", tiles.cast("int")).withColumn("own", F.pmod(F.xxhash64("row"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("other", "tiles")
    return rows.repartition(*group, "a", "b").sortWithinPartitions(*group, "a", "b", *order)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `keys` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def spanning(linked, n: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1; linked(i, others) tells which others i has an edge to. Each node is
    compared with those not yet reached, so a dense group costs little more than one pass."""
    rest = np.arange(n)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            for j in rest[hit]:
                yield int(i), int(j)
            queue.extend(rest[hit])
            rest = rest[~hit]


def joining(linked, own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges between two tiles (own: which of the two a node is in) that connect what stays apart with the spanning edges of
    each tile, which its own task gives. A dense group has one edge for two tiles, not one for each node."""
    part = np.arange(len(own))
    for tile in np.unique(own):
        members = np.flatnonzero(own == tile)
        for i, j in spanning(lambda i, others, m=members: linked(m[i], m[others]), len(members)):
            part[members[j]] = part[members[i]]
    rest = np.arange(len(own))
    while len(rest):
        queue = [part[rest[0]]]
        rest = rest[part[rest] != queue[0]]
        while queue and len(rest):
            for i in np.flatnonzero(part == queue.pop()):
                others = rest[own[rest] != own[i]]
                if not len(others):
                    break
                hit = others[linked(i, others)]
                found, first = np.unique(part[hit], return_index=True)
                for j in hit[first]:
                    yield int(i), int(j)
                queue.extend(found)
                rest = rest[~np.isin(part[rest], found)]


def trie(nodes: DataFrame, floor: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """nodes (row, paths, sketch) -> (tree, path, row, sketch) of the leaves that share a prefix of the floor depth with another.
    The joins are merge joins at every size: what they match grows with the input, so it is never broadcast."""
    width = _LABEL * depth
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("paths", t * width + 1, F.lit(_LABEL * floor)))).alias("tree", "prefix")
    keys = nodes.select("row", tree).select("row", "tree", F.xxhash64("tree", "prefix").alias("key"))
    shared = workspace.materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "prefixes")
    live = keys.join(shared.hint("merge"), "key", "left_semi").groupBy("row").agg(F.collect_list("tree").alias("trees"))  # at most `trees` of them
    live = live.join(nodes.select("row", "paths", "sketch").hint("merge"), "row").select("row", "paths", "sketch", F.explode("trees").alias("tree"))
    return workspace.materialize(live.select("tree", F.expr(f"substring(paths, tree * {width} + 1, {width})").alias("path"), "row", "sketch"), "trie")


def _compare(p: int, least: int, threshold: float, trees: int):
    """Rows (tree, prefix, a, b, own, row, sketch) in the order of the trie -> (u, v) edges of a spanning forest of what the
    sketches let pass, and (u, null, found, expected): what a node's neighbours in the trie say of its recall. A tile's own
    edges and evidence come from the task that has it alone; tasks of two tiles give what joins them. Fewer neighbours
    seen lower a node's estimate, so tiles lose no recall."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["u", "v", "found", "expected"])

        for rows in _groups(batches, 4):
            if len(rows) < 2:
                continue
            names, n, same = [r[5] for r in rows], len(rows), rows[0][2] == rows[0][3]
            sketches = unpacked([r[6] for r in rows])
            size = sketches.shape[1]
            linked = lambda i, rest, s=sketches: np.count_nonzero(s[rest] == s[i], axis=1) >= least
            for i, j in spanning(linked, n) if same else joining(linked, np.array([r[4] for r in rows])):
                for k, x in enumerate((names[i], names[j], None, None)):
                    out[k].append(x)
            found, expected = np.zeros(n, np.int64), np.zeros(n)
            for gap in range(1, min(NEAR, n - 1) + 1) if same else ():
                share = (np.count_nonzero(sketches[gap:] == sketches[:-gap], axis=1) / size - 2.0**-BITS) / (1 - 2.0**-BITS)  # without chance
                hit = share >= threshold
                weight = np.where(hit, 1 / meets(np.maximum(share, threshold), p, trees), 0.0)
                for part in (slice(gap, None), slice(None, -gap)):
                    found[part] += hit
                    expected[part] += weight
            for i in np.flatnonzero(found):
                for k, x in enumerate((names[i], None, int(found[i]), float(expected[i]))):
                    out[k].append(x)
            if len(out[0]) > 50_000:
                yield batch()
                out = ([], [], [], [])
        yield batch()

    return task


def candidate_edges(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """nodes (row, paths, sketch) -> edges (u, v) that connect what the forest finds, with the depth they were found at."""
    floor, least = floor_depth(threshold, trees, depth, target), least_matches(threshold, trees * depth)
    leaves = trie(nodes, floor, trees, depth)
    edges, seen, closed = None, None, None
    for p in range(depth, floor - 1, -1):
        rows = leaves.withColumn("prefix", F.substring("path", 1, _LABEL * p)).withColumn("child", F.substring("path", 1, _LABEL * (p + 1)))
        rows = rows.withColumn("open", F.lit(True)) if closed is None else rows.join(closed.hint("merge"), "row", "left").withColumn("open", F.col("done").isNull())
        groups = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.max("open").alias("any"), (F.min("child") != F.max("child")).alias("joins"))
        groups = groups.where("n > 1 and any" + ("" if p == depth else " and joins")).select("tree", "prefix", "n")
        members = rows.join(groups.hint("merge"), ["tree", "prefix"])
        tiled = _tiles(members, ["tree", "prefix"], F.ceil(F.col("n") / PREFIX_TILE), "path", "row").select("tree", "prefix", "a", "b", "own", "row", "sketch")
        made = workspace.materialize(tiled.mapInArrow(_compare(p, least, threshold, trees), "u long, v long, found long, expected double"), f"depth-{p}")
        new = made.where("v is not null").select("u", "v", F.lit(p).alias("depth"))
        edges = new if edges is None else edges.unionByName(new)
        if p == floor:
            break
        # the tree that shows a node the most partners; a longer prefix found them with less probability, so it bounds
        proof = made.where("v is null").select(F.col("u").alias("row"), "found", "expected")
        seen = proof if seen is None else seen.unionByName(proof)
        best = seen.groupBy("row").agg(F.max_by(F.struct("found", "expected"), F.struct("found", -F.col("expected"))).alias("b")).select("row", "b.*")
        closed = best.where(recall(F.col("found"), F.col("expected"), p, threshold, trees, depth) >= target).select("row", F.lit(True).alias("done"))
        closed = workspace.materialize(closed, f"closed-{p}")
        if leaves.join(closed.hint("merge"), "row", "left_anti").isEmpty():
            break
    return edges.groupBy("u", "v").agg(F.max("depth").alias("depth"))


def _exact(threshold: float, counts: bool):
    ratio = Fraction(str(threshold))

    def overlaps(sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of all pairwise intersections."""
        count = np.diag([len(s) for s in sets]).astype(np.int64)
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # only what two sets share matters
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keep = times[place] > 1
        row, column = row[keep], number[place[keep]]
        shared = np.zeros((len(sets), len(sets)))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(sets), width), np.float32)
            part[row[lo:hi], column[lo:hi] - start] = 1
            shared += part @ part.T
        np.fill_diagonal(shared, 0)
        return count + shared.astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            same = rows[0][1] == rows[0][2]
            own, names = np.array([r[3] for r in rows]), [r[4] for r in rows]
            copies = np.array([r[5] for r in rows], np.int64)
            sets = [np.frombuffer(r[6], np.uint64) for r in rows]
            if len(sets) < 2:
                continue
            both, sizes = overlaps(sets), np.array([len(s) for s in sets])
            union = sizes[:, None] + sizes - both
            linked = ratio.denominator * both >= ratio.numerator * union
            np.fill_diagonal(linked, False)
            counted = linked if same else linked & (own[:, None] != own)
            links, texts = counted @ copies, counted.sum(1) * counts
            u = [names[i] for i in np.flatnonzero(texts)]
            hits = lambda i, rest, m=linked: m[i, rest]
            edges = list(spanning(hits, len(names)) if same else joining(hits, own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(u + [names[i] for i, _ in edges], pa.int64()),
                    pa.array([None] * len(u) + [names[j] for _, j in edges], pa.int64()),
                    pa.array(links[texts > 0].tolist() + [0] * len(edges), pa.int64()),
                    pa.array(texts[texts > 0].tolist() + [0] * len(edges), pa.int64()),
                ],
                ["u", "v", "links", "texts"],
            )

    return task


def verify(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, n: int, text_col: str = "text", counts: bool = True) -> DataFrame:
    """Intersects all pairs within each component. nodes (node, row: of a document that has the set, copies, size), groups
    (row, component) -> (u, v): spanning links; and, if counts are asked for, rows (u, v null, links, texts): u's links by
    copies and by texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([ngrams(x.as_py(), n).tobytes() for x in batch.column(4)], pa.binary())
            if any(hashlib.md5(x.as_py()).hexdigest() != y.as_py() for x, y in zip(packed, batch.column(5), strict=True)):
                raise RuntimeError(workspace.REREAD)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed], ["component", "tiles", "row", "copies", "grams"])

    own = groups.join(nodes.select("row", "node", "copies", "size").hint("merge"), "row")
    own = workspace.materialize(own, "to-verify")
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") * 8 / TILE_BYTES))
    # written, so that both sides of the join have an exchange of their own and a large component is split
    tiles = workspace.materialize(own.groupBy("component").agg(tiles.alias("tiles"), F.count("*").alias("nodes")).where("nodes > 1"), "component-tiles")
    wanted = own.join(tiles.select("component", "tiles").hint("merge"), "component")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).join(wanted.hint("merge"), "row")
    packed = rows.select("component", "tiles", "row", "copies", "text", "node").mapInArrow(sets, "component long, tiles long, row long, copies long, grams binary")
    tiled = _tiles(packed, ["component"], F.col("tiles"), "row")
    picked = tiled.select("component", "a", "b", "own", "row", "copies", "grams")
    return workspace.materialize(picked.mapInArrow(_exact(threshold, counts), "u long, v long, links long, texts long"), "verified")


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """Per row of docs: row, id, seen (a digest of the text), node (copy class), copies (rows of the class), links (rows of
    other classes with a similarity of at least threshold), texts (such classes), class_row (the first row of the
    near-duplicate class). links and texts are 0 if counts aren't asked for."""
    workspace.small_batches(docs.sparkSession)
    signed = workspace.materialize(signatures(docs, trees, depth, n, id_col, text_col), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    nodes = workspace.materialize(nodes, "nodes")
    groups = components(candidate_edges(nodes, threshold, trees, depth, target)).withColumnRenamed("node", "row")
    checked = verify(docs, nodes, groups, threshold, n, text_col, counts)
    # a node is its smallest row and a component its smallest node, so a component is the first row of its class
    found = components(checked.where("v is not null").select("u", "v")).select(F.col("node").alias("row"), F.col("component").alias("class_row"))
    linked = checked.where("v is null").groupBy(F.col("u").alias("row")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    more = nodes.select("node", "copies", "row").join(linked, "row", "left").join(found, "row", "left")
    more = more.where("copies > 1 or class_row is not null").select("node", "copies", "links", "texts", F.coalesce("class_row", "row").alias("class_row"))
    more = workspace.materialize(more, "classes")
    workspace.discard(nodes, groups, checked)
    out = signed.select("row", "id", "seen", "node").join(more.hint("merge"), "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("row", "id", "seen", "node", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), zero("links"), zero("texts"), F.coalesce("class_row", "row").alias("class_row"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id: the smallest id of its near-duplicate class, copy_id: the smallest id with its n-grams, n_links:
    other rows with a similarity of at least the threshold, copies included)."""
    rows = workspace.materialize(join(docs, id_col=id_col, text_col=text_col), "joined")
    near = workspace.materialize(rows.groupBy("class_row").agg(F.min("id").alias("class_id")), "class-ids")
    same = workspace.materialize(rows.where("copies > 1").groupBy("node").agg(F.min("id").alias("copy_id")), "copy-ids")
    out = rows.join(near, "class_row").join(same, "node", "left")
    return out.select("id", "class_id", F.coalesce("copy_id", "id").alias("copy_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each near-duplicate class: the first of them in the table."""
    row, seen = workspace.fresh(docs, "jaccard_row"), workspace.fresh(docs, "jaccard_seen")
    stay = workspace.materialize(join(docs, id_col=id_col, text_col=text_col, counts=False).where("row = class_row").select(F.col("row").alias(row), F.col("seen").alias(seen)), "kept")
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(stay.hint("merge"), row)
    return joined.where(workspace.same_row(F.col(seen), F.col(text_col))).select(*docs.columns)
