"""Near-duplicates by a chosen-path set similarity join on MinHash tokens.

A document's set holds its distinct five-word shingles. Equal sets become one class. A tree starts with all classes
and branches them by the value of its minwise token; TREES independent trees do so, and each pair at similarity s stays
together in one with probability s: (1 - 0.75) ** 10, under 1e-6, is missed by all.

A node of at most SMALL classes is compared exhaustively on 256-byte sketches. Members that may reach the threshold
(estimates 0.12 below it pass, over four deviations) form groups; groups that several trees find count once. All pairs
of a group are compared on the full sets, but for those that confirmed links have joined already.

A larger node first meets a pivot, the member nearest to its most frequent tokens: members that may be similar to it
form groups with it, of about BLOCK members each, which are compared on the full sets, and those that links join to the
pivot count as anchored to it. Where all are anchored, the node is done; where FEW or fewer are not, each of these is a
pivot as well. Any other branches again, into BRANCHES children, by minwise tokens that it takes from the sketches;
children whose members are all anchored to one pivot are left out. A pair at 0.75 survives LEVELS levels in a tree with
probability 0.75 * 0.89 at least, so ten trees miss it with 2e-5 at most. What is large even then holds members that are
nearly as similar as near-duplicates; it is compared exhaustively too, in pairs of blocks, one task for each. So a large
group of near copies costs some comparisons for each member, tree and level, no step gathers a group that is not small,
and nothing is capped or sampled.

Only ids and sketches are shuffled for the search; texts of the classes in some group are read again for their sets,
which go to each of these groups once.

Defined cases: null and wordless texts have empty sets, link with nothing and are kept; texts under five words have
one shingle, the whole sequence; repeated rows are linked; rows that share a doc_id stay or go together if they are
linked; component_id is null only if no member has a doc_id; other columns are ignored. text_key tells rows that share a
doc_id apart: a row is kept or not with all rows of its doc_id and text_key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

WORDS, PERCENT = 5, 75
TREES, BRANCHES, SMALL, FEW, BLOCK = 10, 2, 4096, 8, 512
#: Shingles that weigh as much as one more class, where the size of a node or group is measured.
SHINGLES = 2048
BINS, MAYBE = 256, 0.63
BIN_BITS = 8
#: Levels of branching after the first; each shrinks nodes by the similarity of their members.
LEVELS = 4
#: Classes whose texts are found by a broadcast of their keys (some 40 bytes each); beyond it by a shuffle.
BROADCAST = 200_000

with np.errstate(over="ignore"):
    _ODD = common.mix64(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)


def shingle_set(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where there are fewer words."""
    words, _, _ = common.word_hashes(text)
    return np.unique(common.run_hashes(words, min(k, len(words)))) if len(words) else words


def sketch(s: np.ndarray) -> bytes:
    """A byte for each range of hashes: of the least one in it, or 0 for none."""
    at = np.searchsorted(s, _EDGES)
    end = np.r_[at[1:], len(s)]
    out = np.zeros(BINS, np.uint8)
    full = at < end
    out[full] = (common.mix64(s[at[full]]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def minwise(s: np.ndarray) -> np.ndarray:
    """The least hash of the set under the order of each tree."""
    return np.array([(s * m).min() for m in _ODD], np.uint64).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.small_batches(whole, 2):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for t in common.blobs(b.column(2)):
                s = shingle_set(t)
                h = xxhash.xxh3_128_digest(s.tobytes())
                row = (len(s), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), sketch(s) if len(s) else None, minwise(s).tolist() if len(s) else None)
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "h1", "h2", "sketch", "mins"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (cid, h1, h2, text): the sets of those whose text is the class's."""
    for whole in batches:
        for b in common.small_batches(whole, 3):
            ids, sets = [], []
            for cid, h1, h2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), common.blobs(b.column(3))):
                s = shingle_set(t).tobytes()
                h = xxhash.xxh3_128_digest(s)
                if (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)) == (h1, h2):
                    ids.append(cid)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "shingles"])


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of sketches (which broadcast)."""
    same = np.count_nonzero((x == y) & (x > 0), axis=-1)
    return same / np.maximum(np.count_nonzero(x | y, axis=-1), 1)


class _Sketches:
    """Sketches of some classes in the order of their numbers of shingles, to be compared with one another."""

    def __init__(self, n: np.ndarray, sk: np.ndarray) -> None:
        self.sk = sk
        self.end = np.searchsorted(PERCENT * n, 100 * n, side="right")  # where the classes that may be similar end
        self.filled, self.low = (np.packbits(x, axis=1).view(np.uint64) for x in (sk > 0, sk & 1))

    def near(self, i: int, labels: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those after i with another label whose estimated similarity is not under least, and the estimates."""
        w = slice(i + 1, self.end[i])
        # equal low bits where both are filled: no estimate is larger
        most = np.bitwise_count(~(self.low[w] ^ self.low[i]) & self.filled[w] & self.filled[i]).sum(axis=1, dtype=np.int64)
        j = i + 1 + np.flatnonzero((most >= least * np.bitwise_count(self.filled[w] | self.filled[i]).sum(axis=1, dtype=np.int64)) & (labels[w] != labels[i]))
        if not len(j):
            return j, np.empty(0)
        est = _similar(self.sk[i], self.sk[j])
        return j[est >= least], est[est >= least]


def likely_parts(n: np.ndarray, sk: np.ndarray) -> list[np.ndarray]:
    """Of classes in the order of n: those which pairs that may reach the threshold connect, as lists of places."""
    labels, all_of = np.arange(len(n)), _Sketches(n, sk)
    for i in range(len(n) - 1):
        j, _ = all_of.near(i, labels, MAYBE)
        if len(j):
            labels[np.isin(labels, labels[j])] = labels[i]
    order = np.argsort(labels, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)
    return [p for p in parts if len(p) > 1]


def _groups_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, cid, n, sketch), whole nodes in the order of n: groups and their classes. A group is named by its members."""
    for t in common.whole_groups(batches, "node"):
        node, cid, n = (t.column(c).to_numpy() for c in ("node", "cid", "n"))
        sk = _rows_of(t.column("sketch"))
        bounds = common.group_bounds(node)
        gids, cids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for part in likely_parts(n[lo:hi], sk[lo:hi]):
                own = cid[lo:hi][part]
                name = np.bitwise_xor.reduce(common.mix64(own.view(np.uint64) + np.uint64(1)))
                gids.append(np.full(len(own), name).view(np.int64))
                cids.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gids)), pa.array(np.concatenate(cids))], ["gid", "cid"])


def reaches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirmed(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of sets in the order of their sizes: links that join all which pairs at the threshold or above it connect."""
    if len(sets) == 2:
        return [(0, 1)] if reaches(*sets) else []
    labels, all_of = np.arange(len(sets)), _Sketches(np.array([len(s) for s in sets]), np.frombuffer(b"".join([sketch(s) for s in sets]), np.uint8).reshape(-1, BINS))
    out = []
    for least in ((PERCENT + 5) / 100, MAYBE):  # what is linked almost certainly comes first, and spares other pairs
        for i in range(len(sets) - 1):
            j, est = all_of.near(i, labels, least)
            for k in j[np.argsort(-est, kind="stable")].tolist():
                if labels[k] != labels[i] and reaches(sets[i], sets[k]):
                    out.append((i, k))
                    labels[labels == labels[k]] = labels[i]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (gid, cid, n, shingles), whole groups in the order of n: confirmed links."""
    for t in common.whole_groups(batches, "gid"):
        cid, blobs = t.column("cid").to_numpy(), t.column("shingles").to_pylist()
        bounds = common.group_bounds(t.column("gid").to_numpy())
        a, b = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo > 1:
                found = confirmed([np.frombuffer(x, np.uint64) for x in blobs[lo:hi]])
                a += [min(int(cid[lo + i]), int(cid[lo + j])) for i, j in found]
                b += [max(int(cid[lo + i]), int(cid[lo + j])) for i, j in found]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (gid, node, pivot, cid, n, shingles), whole groups in the order of n: the members that links join to the pivot."""
    for t in common.whole_groups(batches, "gid"):
        node, pivot, cid = (t.column(c).to_numpy() for c in ("node", "pivot", "cid"))
        blobs = t.column("shingles").to_pylist()
        bounds = common.group_bounds(t.column("gid").to_numpy())
        held = np.zeros(len(cid), bool)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            labels = np.arange(lo, hi)
            for i, j in confirmed([np.frombuffer(x, np.uint64) for x in blobs[lo:hi]]) if hi - lo > 1 else ():
                labels[labels == labels[j]] = labels[i]
            held[lo:hi] = labels == labels[np.flatnonzero(cid[lo:hi] == pivot[lo:hi])[0]]
        yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (node, cid, pivot)], ["node", "cid", "anchor"])


_NEAR = "node long, cid long, n long, sketch binary, pivot long, similar double, children array<long>"


def _near_pivot(level: int):
    """Of (node, cid, n, sketch, pivot: cid, n, sketch): the estimated similarity of each to its pivot, 0 where sizes
    rule it out, and the nodes that it goes to if its node branches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column(2).to_numpy(), b.column(5).to_numpy()
            sk = _rows_of(b.column(3))
            est = np.where(100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m), _similar(sk, _rows_of(b.column(6))), 0.0)
            children, node = [], b.column(0).to_numpy().view(np.uint64)
            for k in range(BRANCHES):
                with np.errstate(over="ignore"):
                    name = common.mix64(node + np.uint64(2 * (level * BRANCHES + k) + 1) * np.uint64(0x9E3779B97F4A7C15))
                # the first filled bin from one that the node chooses holds the token
                at = (name[:, None] + np.arange(BINS, dtype=np.uint64)) % np.uint64(BINS)
                first = np.argmax(np.take_along_axis(sk, at.astype(np.intp), 1) > 0, axis=1)
                bins = at[np.arange(len(at)), first]
                with np.errstate(over="ignore"):
                    children.append(common.mix64(name + (bins * np.uint64(256) + sk[np.arange(len(sk)), bins.astype(np.intp)]) * np.uint64(0xD1342543DE82EF95)))
            flat = pa.array(np.column_stack(children).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BRANCHES * len(n) + 1, BRANCHES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(est), lists], ["node", "cid", "n", "sketch", "pivot", "similar", "children"])

    return run


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class _Join:
    def __init__(self, docs: DataFrame) -> None:
        #: A row is found again by its id and the hash of its text.
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
        self.feats = common.materialise(common.map_arrow(self.docs, _features, "doc_id long, key long, n long, h1 long, h2 long, sketch binary, mins array<long>"), "shingles")
        full = self.feats.where("n > 0")
        classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "key")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mins").alias("mins"))
        self.classes = common.materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def sets_of(self, used: DataFrame) -> DataFrame:
        """cid, n and shingles of the classes in used, a column of distinct cid."""
        wanted = common.materialise(self.classes.join(used, "cid", "left_semi").select("cid", "n", "h1", "h2", "row"), "wanted")
        wanted = wanted.select("cid", "h1", "h2", F.col("row.doc_id").alias("row_id"), F.col("row.key").alias("row_key"))
        if wanted.count() <= BROADCAST:
            wanted = F.broadcast(wanted)
        found = self.docs.join(wanted, (F.col("key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("row_id"))).select("cid", "h1", "h2", "text")
        sets = common.map_arrow(found, _sets, "cid long, shingles binary")
        return common.materialise(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")).withColumn("n", (F.length("shingles") / 8).cast("long")), "sets")

    @staticmethod
    def members(rows: DataFrame) -> DataFrame:
        """Of (node, cid, n, anchor): node, cid and weight of the nodes that are to be looked at; of nodes with equal
        members, one."""
        sizes = rows.groupBy("node").agg(
            F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"),
            F.count("anchor").alias("anchored"), F.min("anchor").alias("p"), F.max("anchor").alias("q"),
        ).where("size > 1 and not (anchored = size and p = q)")
        one = sizes.groupBy("size", "x", "y").agg(F.min("node").alias("node"), F.first("shingles").alias("shingles"))
        weight = F.greatest(F.col("size").cast("double"), F.col("shingles") / SHINGLES)
        return common.materialise(rows.select("node", "cid").join(one.select("node", weight.alias("weight")), "node"), "members")

    def pivots(self, large: DataFrame) -> DataFrame:
        """node and pivot (cid, n, sketch): the member that agrees with the most frequent tokens of its node in most
        trees, so that copies which are similar to their origin only, not to each other, meet in it."""
        counts = large.select("node", F.posexplode("mins").alias("at", "token")).groupBy("node", "at", "token").count()
        often = counts.groupBy("node", "at").agg(F.max(F.struct("count", "token"))["token"].alias("token"))
        often = often.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("often"))
        agree = F.size(F.filter(F.zip_with("mins", "often", lambda x, y: x == y), lambda x: x))
        return large.join(often, "node").groupBy("node").agg(F.max_by(F.struct("cid", "n", "sketch"), F.struct(agree, "cid")).alias("pivot"))

    @staticmethod
    def stars(near: DataFrame) -> DataFrame:
        """gid, node, pivot and cid: groups of each pivot and the members that may be similar to it, about BLOCK of them."""
        near = near.where(F.col("similar") >= MAYBE).where("cid != pivot")
        sizes = near.groupBy("node", "pivot").agg(F.ceil(F.greatest(F.count("*").cast("double"), F.sum("n") / SHINGLES) / BLOCK).alias("blocks"))
        dealt = near.join(sizes, ["node", "pivot"]).select(F.xxhash64("node", "pivot", F.pmod(F.xxhash64("cid"), "blocks")).alias("gid"), "node", "pivot", "cid")
        return dealt.unionByName(dealt.select("gid", "node", "pivot", F.col("pivot").alias("cid")).distinct())

    @staticmethod
    def with_sets(groups: DataFrame, sets: DataFrame) -> DataFrame:
        return groups.join(sets, "cid").repartition("gid").sortWithinPartitions("gid", "n", "cid")

    def branches(self, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of large nodes: links, groups of the few that are far from a pivot, and the rows of the next level."""
        paired = large.join(self.pivots(large), "node").select("node", "cid", "n", "sketch", F.col("pivot.cid").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.sketch").alias("pivot_sketch"))
        near = common.materialise(common.map_arrow(paired, _near_pivot(level), _NEAR), "near")
        stars = self.with_sets(self.stars(near), self.sets).select("gid", "node", "pivot", "cid", "n", "shingles")
        anchored = common.materialise(common.map_arrow(stars, _anchored, "node long, cid long, anchor long").distinct(), "anchored")
        near = common.materialise(near.join(anchored, ["node", "cid"], "left"), "strays")
        counts = near.groupBy("node").agg(F.count_if(F.col("anchor").isNull()).alias("strays"))
        few = near.where("anchor is null").join(counts.where(F.col("strays") <= FEW), "node").select("node", F.col("cid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
        met = near.select("node", "cid", "n", "sketch").join(few, "node").select("node", "cid", "n", "sketch", "pivot", "pivot_n", "pivot_sketch")
        groups = common.materialise(self.stars(common.map_arrow(met, _near_pivot(level), _NEAR)).select("gid", "cid"), "few")
        rows = near.join(counts.where(F.col("strays") > FEW), "node").select(F.explode(F.array_distinct("children")).alias("node"), "cid", "n", "anchor")
        return anchored.where("cid != anchor").select(F.col("cid").alias("a"), F.col("anchor").alias("b")), groups, rows

    @staticmethod
    def in_blocks(large: DataFrame) -> DataFrame:
        """node and cid: a node for each pair of blocks of a large one, of weight SMALL together."""
        blocks = F.ceil(2 * F.col("weight") / SMALL).cast("int")
        rows = large.select("node", "cid", F.pmod(F.xxhash64("cid"), blocks).alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "cid")

    def links(self) -> DataFrame:
        """Links (a, b) that join all members of every component, and no others."""
        rows = self.classes.select("cid", "n", F.posexplode("mins").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "cid", "n", F.lit(None).cast("long").alias("anchor"))
        small, links, groups = [], [], []
        for level in range(LEVELS + 1):
            members = self.members(rows)
            small.append(members.where(F.col("weight") <= SMALL).select("node", "cid"))
            large = members.where(F.col("weight") > SMALL)
            if large.isEmpty():
                break
            if level == LEVELS:
                small.append(self.in_blocks(large))
                break
            large = common.materialise(large.select("node", "cid").join(self.classes.select("cid", "n", "sketch", "mins"), "cid"), "large")
            if not level:
                self.sets = self.sets_of(large.select("cid").distinct())
            found = self.branches(large, level)
            links.append(found[0])
            groups.append(found[1])
            rows = found[2]
        near = _all(small).join(self.classes.select("cid", "n", "sketch"), "cid").select("node", "cid", "n", "sketch").repartition("node").sortWithinPartitions("node", "n", "cid")
        found = common.materialise(_all([common.map_arrow(near, _groups_of_nodes, "gid long, cid long"), *groups]).distinct(), "groups")
        used = found.select("cid").distinct()
        sets = self.sets_of(used.join(self.sets, "cid", "left_anti")).unionByName(self.sets) if links else self.sets_of(used)
        rows = self.with_sets(found, sets).select("gid", "cid", "n", "shingles")
        return _all([common.map_arrow(rows, _links, "a long, b long"), *links])

    def result(self) -> DataFrame:
        roots = common.components(self.links()).withColumnRenamed("node", "cid")
        linked = self.classes.join(roots, "cid").select("h1", "h2", "low", "root")
        joined = linked.join(linked.groupBy("root").agg(F.min("low").alias("component")), "root").select("h1", "h2", "component")
        by_class = self.classes.select("h1", "h2", "low").join(joined, ["h1", "h2"], "left").select("h1", "h2", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("low")).alias("component"))
        out = self.feats.select("doc_id", "key", "n", "h1", "h2").join(by_class, ["h1", "h2"], "left")
        component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("key").alias("text_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (a hash of the text): a row per row of docs."""
    return _Join(docs).result()


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept. Texts stay where they are while the rows to drop are few enough to broadcast."""
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_key").alias("dropped_key")).distinct()
    dropped = common.materialise(dropped, "dropped")
    if dropped.count() <= BROADCAST:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col("dropped_id")) & (F.xxhash64("text") == F.col("dropped_key")), "left_anti")
