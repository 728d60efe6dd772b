"""MinHash near-dedup by a chosen-path set similarity join.

A document's set are its word shingles, hashed to 64 bits; equal sets form one class, so copies are never paired. Each
class has COORDS minwise tokens. In each of TREES independent trees every class goes down the path that a chosen
token gives; nodes with more than LEAF classes branch again, by FORK tokens that the node's own id chooses, so that a
class follows all of them and similar classes stay together on some path. Nodes that no longer shrink are dense (groups of
near copies, or texts with a large common part). They are dealt out in chunks first, and a few common members, the same
for all chunks, tie these together: that joins a group of near copies at once. Then each dense node is compared as a whole,
by blocks of two chunks, leaving out only pairs that are in one component already.
Leaves and blocks are compared exhaustively on the minwise tokens and sizes, each pair in one of the nodes that both are in;
what they give are candidates only.

Every link is confirmed on the full sets of both texts. In the first round each class has its best candidate confirmed,
in each later one some spanning forests of each node, without common pairs, likeliest pairs first, over the components so
far and without pairs that failed: GROW forests in the second round, and GROW times as many in each that follows. Rounds end
when no node has a candidate between two components that wasn't judged, so what joins a group early spares most of its pairs.
Components come from alternating large-star and small-star steps over written tables; nothing of this reaches the driver but counts.

A pair at the threshold shares a leaf in one tree with chance about 0.8 (a little less for each further level), in none
of TREES = 8 with about 1e-4, and its estimate falls below threshold - MARGIN with about 1e-3. Nodes that don't shrink to
SHRINK of the one above can't split further without losing such pairs, so they are what is called dense.

Defined results: null and wordless texts have an empty set, no links, and are their own component (component_id =
doc_id); a null doc_id belongs to a component like any other, whose id is the least doc_id that isn't null (null if
there is none); kept is doc_id = component_id, false for null; rows with equal doc_id each get their own set, and all
that have the component's id are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, fingerprint

COORDS, TREES, FORK, LEAF, SHRINK, LEVELS = 512, 8, 2, 2400, 0.7, 12
LEADERS, MARGIN, GROW, MANY = 48, 0.055, 64, 200
CHANCE = 1 / 256
PERMUTE = np.array([xxhash.xxh32_intdigest(b"coordinate", i) | 1 for i in range(COORDS)], np.uint32)


@functools.cache
def _factors(size: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"near", i) | 1 for i in range(size)], np.uint64)


ROOTS = np.array([xxhash.xxh64_intdigest(b"tree", i) | 1 for i in range(TREES)], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = common.WORDS.findall(common.lowered(text or ""))
    return np.unique(fingerprint.shingle_hashes(words, size, _factors(size)))


def minwise(hashes: np.ndarray) -> bytes:
    """COORDS minwise tokens of 8 bits."""
    least = np.full(COORDS, ~np.uint32(0))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 128):
        np.minimum(least, (short[at : at + 128, None] * PERMUTE).min(0), out=least)
    return (fingerprint.mixed(least.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def root_tokens(hashes: np.ndarray) -> list[int]:
    """The minwise token of each tree's root: 64 bits, so that strangers don't meet however many classes there are."""
    return [int(x) for x in fingerprint.mixed((hashes[:, None] * ROOTS).min(0)).view(np.int64)]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """d, tie (hash of the text), n, c (128-bit name of the set; null if empty), sig, roots."""

    def rows(cols):
        for d, tie, text in zip(cols["d"], cols["tie"], cols["text"]):
            s = shingle_set(text, size)
            yield (d, tie, len(s), xxhash.xxh3_128_digest(s.tobytes()), minwise(s), root_tokens(s)) if len(s) else (d, tie, 0, None, None, None)

    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tie"), "text")
    return common.mapped(keyed, "d long, tie long, n long, c binary, sig binary, roots array<long>", rows, 128)


def _token(at):
    return F.substring("sig", at + 1, F.lit(1))


def leaves(classes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written tables: leaf, c of every class in every small leaf that it reaches, leaves of two classes or more; and leaf, c,
    chunks, size of the dense nodes."""
    at = classes.select("c", F.explode(F.transform("roots", lambda x, t: F.xxhash64(t, x))).alias("node"))
    done, stiff, parents, above = [], [], None, []
    for level in range(LEVELS):
        at = common.written(at, "path")
        sizes = at.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        if parents is not None:
            sizes = sizes.join(parents, "node")
        else:
            sizes = sizes.withColumn("above", F.lit(None).cast("long"))
        sizes = common.written(sizes, "path-size")
        common.dropped(*above)
        done.append(common.written(at.join(sizes.filter(F.col("size") <= LEAF).select("node"), "node").select(F.col("node").alias("leaf"), "c"), "leaves"))
        above = [at, sizes]
        stuck = (F.col("size") > SHRINK * F.coalesce("above", F.lit(1 << 62))) | F.lit(level == LEVELS - 1)
        kinds = {r["stuck"] for r in sizes.filter(F.col("size") > LEAF).groupBy(stuck.alias("stuck")).agg(F.count("*")).collect()}  # two rows at most
        large = sizes.filter(F.col("size") > LEAF)
        if True in kinds:
            dense = at.join(large.filter(stuck).select("node", F.ceil(F.col("size") * 2 / LEAF).cast("int").alias("chunks"), "size"), "node")
            stiff.append(common.written(dense.select(F.col("node").alias("leaf"), "c", "chunks", "size"), "dense-node"))
        if False not in kinds:
            break
        # the signatures of these classes only are moved
        wide = common.written(at.join(large.filter(~stuck).select("node", "size"), "node"), "path-large")
        more = wide.join(of_classes(classes.select("c", "sig"), wide), "c")
        child = [F.struct(F.xxhash64("node", F.lit(j), _token(F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDS)).cast("int"))).alias("node"), F.col("size").alias("above")) for j in range(FORK)]
        more = common.written(more.select("c", F.explode(F.array(*child)).alias("to")).select("c", "to.node", "to.above"), "path-child")
        common.dropped(wide, *above)
        above = [more]
        parents = more.select("node", "above").distinct()
        at = more.select("c", "node")
    common.dropped(*above)
    return done, stiff


def of_classes(classes: DataFrame, named: DataFrame) -> DataFrame:
    """classes without most that aren't among named's (c)."""
    return maybe_in(classes.withColumn("key", F.xxhash64("c")), named.select(F.xxhash64("c").alias("key"))).drop("key")


def chunked(dense: DataFrame) -> DataFrame:
    """leaf, c: the dense nodes in chunks of about LEAF / 2 classes, and LEADERS classes, chosen by hash (the same in all nodes
    of a group), in all of them."""
    spread = F.pmod(F.xxhash64("c"), F.lit(1 << 30))
    chunks = F.when(spread < F.lit(LEADERS * (1 << 30)) / F.col("size"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(spread, F.col("chunks")).cast("int")))
    return dense.select("leaf", "c", F.explode(chunks).alias("chunk")).select(F.xxhash64("leaf", "chunk", F.lit("chunk")).alias("leaf"), "c")


def distinct_leaves(placed: DataFrame) -> DataFrame:
    """placed without leaves whose classes are those of another leaf: similar classes meet in most trees, and the same
    classes give the same pairs. Sets are compared by size and 128 bits."""
    sets = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    return placed.join(sets.filter("n > 1").groupBy("n", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf"), "leaf", "left_semi")


def blocks(dense: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """leaf, node, c, side, and the tables that it reads: each two members (leaf, c) of a dense node that have different labels (c, label) meet in one leaf, on
    different sides or on side 0.

    Components of more than LEAF / 2 members make up chunks of their own, which need not meet each other; all others share
    chunks of about LEAF / 2. A leaf is two chunks, or one of several components.
    """
    half = LEAF // 2
    at = dense.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    sizes = sized = common.written(at.groupBy("leaf", "label").agg(F.count("*").alias("size")), "dense-size")
    mixed = sizes.groupBy("leaf").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("size") <= half, F.col("size")).otherwise(0)).alias("small")).filter("labels > 1")
    sizes = sizes.join(mixed.select("leaf", "small"), "leaf").select(F.col("leaf").alias("node"), F.col("label").alias("name"), "size", "small")
    at = at.join(sizes, (F.col("leaf") == F.col("node")) & (F.col("label") == F.col("name"))).drop("leaf", "name")
    large = F.col("size") > half
    deal = lambda key, n: F.pmod(F.xxhash64(key, "node"), F.ceil(n / half)).cast("int")
    chunk = F.struct(F.when(large, F.col("label")).alias("of"), F.when(large, deal("c", F.col("size"))).otherwise(deal("label", F.col("small"))).alias("part"))
    used = [sized, at := common.written(at.select("node", "c", chunk.alias("chunk")), "dense")]
    chunks = at.select("node", "chunk").distinct()
    both = chunks.withColumnRenamed("chunk", "one").join(chunks.withColumnRenamed("chunk", "two"), "node")
    both = both.filter((F.col("one") <= F.col("two")) & ~F.coalesce(F.col("one.of") == F.col("two.of"), F.lit(False)))
    both = both.withColumn("leaf", F.xxhash64("node", "one.of", "one.part", "two.of", "two.part", F.lit("block")))
    same = F.col("one") == F.col("two")
    ends = both.select("node", "leaf", F.col("one").alias("chunk"), F.when(same, 0).otherwise(1).alias("side"))
    ends = ends.unionByName(both.filter(~same).select("node", "leaf", F.col("two").alias("chunk"), F.lit(2).alias("side")))
    ends = ends.select("node", "leaf", "side", F.col("chunk.of").alias("of"), F.col("chunk.part").alias("part"))
    at = at.select("node", "c", F.col("chunk.of").alias("its"), F.col("chunk.part").alias("own"))
    met = at.join(ends.withColumnRenamed("node", "in"), (F.col("node") == F.col("in")) & F.col("its").eqNullSafe(F.col("of")) & (F.col("own") == F.col("part")))
    return met.select("leaf", "node", "c", "side"), used


def met_before(node: int, nodes: list[list[int]]) -> np.ndarray | None:
    """A row of bits for each member of a node: the lesser nodes that it shares with another one (None if there are none)."""
    seen = Counter(x for own in nodes for x in own if x < node)
    shared = {x: i for i, x in enumerate(x for x, n in seen.items() if n > 1)}
    if not shared:
        return None
    bits = np.zeros((len(nodes), -(-len(shared) // 64) * 64), bool)
    for i, own in enumerate(nodes):
        bits[i, [shared[x] for x in own if x in shared]] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def candidates(placed: DataFrame, classes: DataFrame, threshold: float, forests: int, partitions: int) -> DataFrame:
    """leaf, u, v, near, more (whether the leaf has others): candidate pairs of different labels from the leaves; classes: c, n, sig, label, failed, nodes; placed:
    leaf, node (the leaf's, or that of which it is a block), c, and side: members of one side (but 0) aren't to be compared.

    A pair is compared in the least node that both have, if classes know their nodes. Of each leaf: without forests, the best
    candidate of each class; else the pairs of so many spanning forests, best first. A leaf that gives none never will:
    labels only merge, and failed pairs only grow.
    """

    def pairs(n: np.ndarray, sig: np.ndarray, label: np.ndarray, side: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, near = [], [], []
        least = (threshold - MARGIN) * (1 - CHANCE) + CHANCE
        for k in range(len(n) - 1):
            small = np.minimum(n[k], n[k + 1 :])
            ok = small >= (threshold - 1e-9) * np.maximum(n[k], n[k + 1 :])
            ok &= label[k + 1 :] != label[k]
            if side[k]:
                ok &= side[k + 1 :] != side[k]
            if before is not None:
                ok &= ~(before[k + 1 :] & before[k]).any(1)
            at = np.flatnonzero(ok)
            if len(at):
                est = (sig[k + 1 + at] == sig[k]).mean(1)
                ok = est >= least
                at, est = at[ok], est[ok]
                i.append(np.full(len(at), k))
                j.append(k + 1 + at)
                near.append(est)
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (i, j, near))

    def leaf(node: int, members: dict[bytes, tuple]) -> list[tuple[bytes, bytes, float, bool]]:
        names = sorted(members)
        n = np.array([members[c][0] for c in names])
        sig = np.stack([np.frombuffer(members[c][1], np.uint8) for c in names])
        labels = [members[c][2] for c in names]
        failed = [members[c][3] for c in names]
        roots = [{x: x for x in labels}]

        def find(root, x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        group = {x: at for at, x in enumerate(roots[0])}
        if len(group) == 1:
            return []
        i, j, near = pairs(n, sig, np.array([group[x] for x in labels]), np.array([members[c][4] for c in names]), met_before(node, [members[c][5] for c in names]))
        best: set[int] = set()
        out, more = [], not forests
        for k in np.lexsort((j, i, -near)):
            a, b = int(i[k]), int(j[k])
            if names[b] in failed[a]:
                continue
            if not forests:
                if not {a, b} <= best:
                    best |= {a, b}
                    out.append((names[a], names[b], float(near[k])))
                continue
            # what a forest ties together, all before it do: the first that doesn't, by bisection
            at = bisect.bisect_left(roots, True, key=lambda root: find(root, labels[a]) != find(root, labels[b]))
            if at == len(roots) < forests:
                roots.append({x: x for x in roots[0]})
            if at < len(roots):
                roots[at][find(roots[at], labels[a])] = find(roots[at], labels[b])
                out.append((names[a], names[b], float(near[k])))
            else:
                more = True
        return [(*pair, more) for pair in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, members, got = None, None, {}, []

        def flush():
            rows, got[:] = [*got], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.bool_()))], names=["leaf", "u", "v", "near", "more"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                cols = whole.slice(at, 1024).to_pydict()
                for at_leaf, node, c, n, sig, label, failed, side, nodes in zip(*cols.values()):
                    if at_leaf != now:
                        if len(members) > 1:
                            got.extend((now, *pair) for pair in leaf(own, members))
                        now, own, members = at_leaf, node, {}
                    members[c] = (n, sig, label, frozenset(failed or ()), side, nodes or ())
                if got:
                    yield flush()
        if len(members) > 1:
            got.extend((now, *pair) for pair in leaf(own, members))
        if got:
            yield flush()

    placed = placed if "side" in placed.columns else placed.withColumns({"node": F.col("leaf"), "side": F.lit(0)})
    rows = placed.join(classes, "c").select("leaf", "node", "c", "n", "sig", "label", "failed", "side", "nodes")
    return rows.repartition(partitions, "leaf").sortWithinPartitions("leaf").mapInArrow(run, "leaf long, u binary, v binary, near double, more boolean")


def best_of_each(pairs: DataFrame) -> DataFrame:
    """The pairs that are the best one of either end."""
    ends = pairs.select(F.col("u").alias("e"), F.struct("near", "u", "v").alias("p")).unionByName(pairs.select(F.col("v").alias("e"), F.struct("near", "u", "v").alias("p")))
    return ends.groupBy("e").agg(F.max("p").alias("p")).select("p.u", "p.v").distinct()


def maybe_in(rows: DataFrame, names: DataFrame, bits: int = 24) -> DataFrame:
    """rows (key: a hash) without most whose key isn't among names' (key), by a bitmap of 2^bits bits, at most 2^(bits - 6) rows
    that are broadcast whatever the input. It only spares the shuffle of a join that follows; none that joins is lost."""
    bit = F.shiftrightunsigned("key", 64 - bits)
    words = names.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - bits}) & 63 AS INT))").alias("mask"))
    words = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    there = rows.join(F.broadcast(words), F.shiftright(bit, 6) == F.col("word"))
    return there.filter(F.expr(f"shiftrightunsigned(mask, CAST(shiftrightunsigned(key, {64 - bits}) & 63 AS INT)) & 1 = 1")).drop("word", "mask")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v, ok: whether 100 * intersection >= percent * union of the full sets; texts: c, text."""

    def rows(cols):
        for u, v, a, b in zip(cols["u"], cols["v"], cols["a"], cols["b"]):
            x, y = shingle_set(a, size), shingle_set(b, size)
            both = len(np.intersect1d(x, y, assume_unique=True))
            yield u, v, 100 * both >= percent * (len(x) + len(y) - both)

    one = pairs.join(texts.select(F.col("c").alias("u"), F.col("text").alias("a")), "u")
    two = one.join(texts.select(F.col("c").alias("v"), F.col("text").alias("b")), "v")
    return common.mapped(two.select("u", "v", "a", "b"), "u binary, v binary, ok boolean", rows, 64)


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the least of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return not ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").take(1)


def components(edges: DataFrame) -> DataFrame:
    """c, label (the least name in its component) of all ends of edges (u, v); a written table."""
    edges = common.written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct(), "star")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.written(large, "star-large")
        common.dropped(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(least, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = common.written(small.filter("u <> v").distinct(), "star")
        common.dropped(large)
    out = common.written(edges.select(F.col("u").alias("c"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("label")).distinct()), "labels")
    common.dropped(edges)
    return out


def linked(docs: DataFrame, classes: DataFrame, placed: DataFrame, before: tuple[DataFrame, DataFrame] | None, size: int, percent: int, nodes: DataFrame | None = None, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """judged (u, v, ok) and labels (c, label) after the candidates of these leaves, and what was found before them; nodes (c,
    nodes) has all nodes of each class, if a pair is to be compared in one only; not whole: after two rounds, though candidates
    may be left. placed, before and nodes are dropped."""
    threshold = percent / 100
    parts = common.pieces(placed.count(), 20_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def state(members: DataFrame, found: tuple[DataFrame, DataFrame] | None) -> DataFrame:
        if found is None:
            return members.withColumns({"label": F.col("c"), "failed": F.lit(None).cast("array<binary>")})
        judged, labels = found
        no = judged.filter("NOT ok")
        no = no.select(F.col("u").alias("c"), F.col("v").alias("f")).unionByName(no.select(F.col("v").alias("c"), F.col("u").alias("f")))
        out = members.join(labels, "c", "left").join(no.groupBy("c").agg(F.collect_set("f").alias("failed")), "c", "left")
        return out.withColumn("label", F.coalesce("label", "c"))

    def more(turn: DataFrame) -> tuple[DataFrame, DataFrame]:
        if before is None:
            return turn, components(turn.filter("ok"))
        judged, labels = before
        if not turn.filter("ok").take(1):  # the labels stay
            out = common.written(judged.unionByName(turn), "judged"), labels
            common.dropped(judged, turn)
            return out
        merged = labels.select(F.col("c").alias("u"), F.col("label").alias("v")).unionByName(turn.filter("ok").select("u", "v"))
        out = common.written(judged.unionByName(turn), "judged"), components(merged)
        common.dropped(judged, labels, turn)
        return out

    members = common.written(of_classes(classes.select("c", "n", "sig"), placed).join(placed.select("c").distinct(), "c", "left_semi"), "members")  # most classes meet none
    if nodes is None:
        bare, members = members, common.written(members.withColumn("nodes", F.lit(None).cast("array<long>")), "members")
        common.dropped(bare)
    else:
        bare, members = members, common.written(members.join(nodes, "c", "left"), "members")
        common.dropped(bare, nodes)
    found = common.written(candidates(placed, state(members, before), threshold, 0, parts), "pairs")
    if before is not None and not found.take(1):
        common.dropped(placed, members, found)
        return before
    pairs = found.groupBy("u", "v").agg(F.max("near").alias("near"))
    ends = common.written(found.select(F.col("u").alias("c")).unionByName(found.select(F.col("v").alias("c"))).distinct(), "ends")
    reached, placed = placed, common.written(placed.join(found.select("leaf").distinct(), "leaf", "left_semi").join(ends, "c", "left_semi"), "leaves")  # no other has a candidate
    some, members = members, common.written(members.join(ends, "c", "left_semi"), "members")
    named = common.written(classes.select("c", F.col("rep.d").alias("rd"), F.col("rep.tie").alias("rt")).join(ends, "c", "left_semi"), "named")
    common.dropped(reached, some, ends)
    source = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tie"), "text")
    source = maybe_in(source.withColumn("key", F.xxhash64("d", "tie")), named.select(F.xxhash64("rd", "rt").alias("key"))).drop("key")
    texts = named.join(source, F.col("rd").eqNullSafe(F.col("d")) & (F.col("rt") == F.col("tie"))).select("c", "text").dropDuplicates(["c"])
    texts = common.written(texts, "texts")
    before = more(common.written(confirmed(best_of_each(pairs), texts, size, percent), "judged"))
    common.dropped(named, found)
    for forests in (GROW**k for k in itertools.count(1)):
        fresh = common.written(candidates(placed, state(members, before), threshold, forests, parts), "pairs")
        if not fresh.take(1):
            common.dropped(fresh)
            break
        turn = common.written(confirmed(fresh.select("u", "v").distinct(), texts, size, percent), "judged-turn")
        before = more(turn)
        left = fresh.filter("more").select("leaf").distinct()
        if not whole or not left.take(1):
            common.dropped(fresh)
            break
        reached, placed = placed, common.written(placed.join(left, "leaf", "left_semi"), "leaves")
        common.dropped(reached, fresh)
    common.dropped(texts, members, placed)
    return before


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tie (hash of the text), label (of its component; null without words), n_shingles, component_id, kept, n_links
    (confirmed links of its set) of each row."""
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    sketched = common.written(sketches(docs, size), "sketches")
    rep = F.min(F.struct("d", "tie")).alias("rep")
    classes = sketched.filter("c IS NOT NULL").groupBy("c").agg(rep, F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("roots").alias("roots"), F.min("d").alias("least_d"), F.count("*").alias("copies"))
    classes = common.written(classes, "classes")
    drawn = common.written(sketched.select("d", "tie", "n", "c"), "rows")
    common.dropped(sketched)
    reached, stiff = leaves(classes)
    placed = common.written(distinct_leaves(union(reached)), "leaves")
    common.dropped(*reached)
    found, at = None, placed
    if stiff:
        dense = common.written(distinct_leaves(union(stiff)), "dense-node")
        common.dropped(*stiff)
        found = linked(docs, classes, common.written(chunked(dense), "leaves"), None, size, percent, whole=False)  # blocks hold all of its pairs again
        whole, used = blocks(dense.select("leaf", "c"), found[1])
        at = placed.unionByName(dense.select("leaf", "c"))
    nodes = common.written(at.groupBy("c").agg(F.collect_list("leaf").alias("nodes")), "nodes")  # at most TREES * FORK^LEVELS
    if stiff:
        small, placed = placed, common.written(placed.withColumns({"node": F.col("leaf"), "side": F.lit(0)}).unionByName(whole), "leaves")
        common.dropped(small, dense, *used)
    judged, labels = linked(docs, classes, placed, found, size, percent, nodes)
    named = classes.select("c", "least_d", "copies").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    ids = named.groupBy("label").agg(F.min("least_d").alias("component_id"))
    yes = judged.filter("ok")
    links = yes.select(F.col("u").alias("c")).unionByName(yes.select(F.col("v").alias("c"))).groupBy("c").agg(F.count("*").alias("n_links"))
    by_class = named.join(ids, "label").join(links, "c", "left").select("c", "label", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies")
    by_class = common.written(by_class, "by-class")
    common.dropped(classes, judged, labels)
    # classes of more than MANY copies, and of more than a 4096th of all: at most 4096, which is what is broadcast
    many = max(MANY, drawn.count() // 4096)
    heavy, light = by_class.filter(F.col("copies") > many).drop("copies"), by_class.filter(F.col("copies") <= many).drop("copies")
    marked = drawn.filter("c IS NOT NULL").join(F.broadcast(heavy.select(F.col("c").alias("hc"), *[F.col(x).alias(f"h_{x}") for x in ("label", "component_id", "n_links")])), F.col("c") == F.col("hc"), "left")
    alone = F.lit(None).cast("binary").alias("label"), F.col("d").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    out = marked.filter("hc IS NULL").select("d", "tie", "n", "c").join(light, "c").select("d", "tie", "n", "label", "component_id", "n_links")
    out = out.unionByName(marked.filter("hc IS NOT NULL").select("d", "tie", "n", *[F.col(f"h_{x}").alias(x) for x in ("label", "component_id", "n_links")]))
    out = out.unionByName(drawn.filter("c IS NULL").select("d", "tie", "n", *alone))
    kept = F.coalesce(F.col("d") == F.col("component_id"), F.lit(False))
    return out.select(F.col("d").alias("doc_id"), "tie", "label", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "n_links")


def kept_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component (the least doc_id, then hash of the text), and all rows without words."""
    found = common.written(near_duplicates(docs, size, percent).select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t"), "label"), "near")
    one = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("__d").isNull().alias("null"), "__d", "__t")).alias("k")).select("k.__d", "k.__t")
    keys = one.unionByName(found.filter("label IS NULL").select("__d", "__t").distinct())
    out = docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left_semi")
    twice = found.filter("label IS NOT NULL").groupBy("__d", "__t").agg(F.count("*").alias("n")).filter("n > 1")
    return out.dropDuplicates(["doc_id", "text"]) if twice.take(1) else out  # only where doc_id and text repeat


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir), size=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept", "n_links")
