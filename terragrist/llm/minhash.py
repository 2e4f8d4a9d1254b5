"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes a set of distinct word shingles and a signature of K MinHash coordinates.
   Equal sets are one class from here on, so that copies cost one row each.
2. A class is posted under each (coordinate, value). Coordinate values held by one class alone match
   nothing and go. A class that shares c values can reach T matches only if it meets its partner among its
   c - T + 1 rarest shared ones (prefix filter), and not at all if c < T; the long lists of frequent values
   are thus skipped and only looked at again when signatures are compared.
3. In each remaining list the class with the most frequent values is the hub, and its members are its family. Sketches,
   the lowest bits of each coordinate (64 bytes), tell which members are alike: those that agree in fewer than T
   coordinates tell of signatures that do so, so no pair with T equal coordinates is passed over. A member is compared on
   full shingle sets with one hub that it is like. Members of a family that this leaves in different components are then
   compared with each other, in blocks of bounded size: by sketches, and only those that are alike, in the largest family that
   both are in, send their sets (kilobytes) and are compared on them. So a list whose members all join its hub
   costs its length, not its square, a set is sent to one family or few, and no link is left out.
4. Links become components.

The chance that a pair at exactly the similarity s is missed is P(Binomial(K, s) < T): with K = 128, T = 77 and
s = 0.8 about 8e-8. Links are confirmed on the full sets of 64-bit shingle hashes, the same that are counted as n_shingles.

A class is known by the number of its first row, written with the features, so ids may repeat, also with different texts.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist.llm.components import connected_components
from terragrist.llm.shared import Scratch, boxed, free, unboxed
from terragrist.llm.words import mix, shingle_set, utf8_views, word_hashes

#: Documents of one side of a block whose sets, or whose sketches, are compared in one go.
BLOCK, SKETCH_BLOCK = 256, 1024
#: Bits of each coordinate in a sketch.
PLANES = 4
#: Sides of a block's rows: on the left such as have been compared with the hub, too; on the right such as stand on the left as well.
TRIED_LEFT, LEFT, RIGHT, APART_RIGHT = -1, 0, 1, 2
#: Rounds in which signature coordinates are posted at most, and classes for each of them at least.
ROUNDS, ROUND_ROWS = 4, 5_000
#: Members of a hub that meet one copy of its signature.
MEMBERS = 1024
#: Ids that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    best = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            x = shingles[None, at : at + 512] * mul[:, None] + add[:, None]
            np.minimum(best, (x >> np.uint64(32)).astype(np.uint32).min(axis=1), out=best)
    return best


def _features(width: int, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        mul = rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(0, 2**64, k, dtype=np.uint64)
        for batch in batches:
            n, fa, fb, sig = [], [], [], []
            for view in utf8_views(batch.column(1)):
                s = _shingles(view, width)
                n.append(len(s))
                for out, x in zip((fa, fb), fingerprint(s)):
                    out.append(x)
                sig.append(_signature(s, mul, add).view(np.int32))
            flat = np.concatenate(sig) if sig else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, k, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), lists], ["doc_id", "n", "fa", "fb", "sig"])

    return run


def _shingles(view: np.ndarray | None, width: int) -> np.ndarray:
    return shingle_set(word_hashes(view), width) if view is not None else np.empty(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of one size apart."""
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))))


def _sets(width: int):
    """(doc_id, n, fa, fb, shingles): the whole set of each text, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(v, width) for v in utf8_views(batch.column(1))]
            marks = [(len(x), *fingerprint(x)) for x in found]
            columns = [pa.array([m[i] for m in marks], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], ["doc_id", "n", "fa", "fb", "shingles"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) of (node, sig): the lowest bits of each coordinate, a plane after the other in words of 64 coordinates."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        sig = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        words = -(-sig.shape[1] // 64)
        bits = np.zeros((len(sig), PLANES, 64 * words), dtype=np.uint8)
        for b in range(PLANES):
            bits[:, b, : sig.shape[1]] = (sig >> b) & 1
        flat = np.packbits(bits, axis=2).reshape(len(sig), -1).view(np.int64)
        sketch = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), sketch], ["node", "sketch"])


def _different(a: str, b: str, coordinates: int) -> Column:
    """Coordinates in which two sketches differ."""
    words = -(-coordinates // 64)
    planes = lambda w: [F.col(a)[p * words + w].bitwiseXOR(F.col(b)[p * words + w]) for p in range(PLANES)]
    return reduce(operator.add, (F.bit_count(reduce(Column.bitwiseOR, planes(w))) for w in range(words)))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set (rows) and each right set (columns), by an inverted list of the left."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if len(left) == 1:
        a = left[0]
        for j, b in enumerate(right):
            at = np.searchsorted(a, b)
            at[at == len(a)] = 0
            out[0, j] = np.count_nonzero(a[at] == b)
        return out
    flat = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), [len(s) for s in left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for j, b in enumerate(right):
        lo, hi = np.searchsorted(flat, b), np.searchsorted(flat, b, side="right")
        lens = hi - lo
        hit = lens > 0
        lo, lens = lo[hit], lens[hit]
        if len(lo):
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            out[:, j] = np.bincount(owner[at], minlength=len(left))
    return out


def _in_blocks(value: str, read: Callable, compare: Callable, names: tuple[str, ...]):
    """The columns `names` of what compare() finds in the rows of each block; rows come sorted by block key, left rows (sides up to 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("family", "side", "node", "comp")
        key, rows = None, {x: [] for x in (*columns, value)}
        found: list[tuple[int, ...]] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], list(names))
        for batch in batches:
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("family", "lb", "rb"))))
            cols = {x: batch.column(x).to_pylist() for x in columns}
            raw = read(batch.column(value))
            for i, now in enumerate(keys):
                if now != key:
                    found += compare(rows)
                    key, rows = now, {x: [] for x in (*columns, value)}
                for x in columns:
                    rows[x].append(cols[x][i])
                rows[value].append(raw[i])
            yield told()
            found = []
        found += compare(rows)
        yield told()

    return run


def _sides(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    side = np.asarray(rows["side"])
    return np.asarray(rows["node"]), np.asarray(rows["comp"]), np.flatnonzero(side <= 0), np.flatnonzero(side > 0)


def _verify(percent: int):
    """Links of blocks, by full sets, that join the same components as all links do."""

    def links(rows: dict) -> Iterator[tuple[int, int]]:
        ids, comp, le, ri = _sides(rows)
        sets = rows["shingles"]
        if not len(le) or not len(ri):
            return
        a, b = [sets[i] for i in le], [sets[i] for i in ri]
        na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        inter = _overlaps(a, b)
        union = na[:, None] + nb[None, :] - inter
        good = (100 * inter >= percent * union) & (comp[le][:, None] != comp[ri][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        # Links that join nothing new within the block go: at most one for each row stays, not one for each pair.
        for i, j in zip(*np.nonzero(good)):
            u, v = root(comp[le[i]]), root(comp[ri[j]])
            if u != v:
                parent[u] = v
                yield int(ids[le[i]]), int(ids[ri[j]])

    return _in_blocks("shingles", lambda c: [np.frombuffer(x.as_buffer(), dtype="<u8") for x in c], links, ("u", "v"))


def _alike(most: int, length: int):
    """(family, node, side) of the rows of blocks that are alike one of the other side: sketches differ in at most `most` coordinates, components differ,
    and no larger family has both. `sketch` has the sketch in its first `length` numbers, then the row's families, the largest first."""

    def members(rows: dict) -> Iterator[tuple[int, int, int]]:
        ids, comp, le, ri = _sides(rows)
        if not len(le) or not len(ri):
            return
        family, side = rows["family"][0], np.asarray(rows["side"])
        sketch = np.stack([x[:length] for x in rows["sketch"]]).reshape(len(ids), PLANES, -1).view(np.uint64)  # of a signed number the bits of its absolute value are counted
        of = np.full((len(ids), max(len(x) for x in rows["sketch"]) - length), -1, dtype=np.int64)
        for i, x in enumerate(rows["sketch"]):
            of[i, : len(x) - length] = x[length:]
        right, hit = sketch[ri], np.zeros(len(ri), dtype=bool)
        for i in le:
            differ = np.bitwise_count(np.bitwise_or.reduce(right ^ sketch[i], axis=1)).sum(axis=1, dtype=np.int64)
            # Of two that are apart from the hub each is on both sides: the pair counts once.
            alike = (differ <= most) & (comp[ri] != comp[i]) & ((side[ri] == APART_RIGHT) <= (ids[ri] > ids[i]))
            if side[i] == TRIED_LEFT:
                alike &= ids[ri] != family
            at = np.flatnonzero(alike)
            if len(at):
                shared = np.isin(of[ri[at]], rows["sketch"][i][length:])
                at = at[of[ri[at], shared.argmax(axis=1)] == family]
            if len(at):
                hit[at] = True
                yield family, int(ids[i]), LEFT
        for j in ri[hit]:
            yield family, int(ids[j]), RIGHT

    return _in_blocks("sketch", lambda c: np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))[:-1]), members, ("family", "node", "side"))


def _blocks(left: DataFrame, right: DataFrame, values: DataFrame, block: int) -> DataFrame:
    """left and right: (family, node, comp, side, n_left, n_right), the latter two the family's rows on each side. values: a column for each node."""
    nl, nr = (F.ceil(F.col(c) / block).cast("int") for c in ("n_left", "n_right"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = left.select("family", "node", "comp", own(nl).alias("lb"), every(nr).alias("rb"), "side")
    rows = rows.unionByName(right.select("family", "node", "comp", every(nl).alias("lb"), own(nr).alias("rb"), "side"))
    return rows.join(values, "node").repartition("family", "lb", "rb").sortWithinPartitions("family", "lb", "rb", "side", "node")


def _block_links(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of rows of the left with rows of the right, see _blocks()."""
    return _blocks(left, right, sets, BLOCK).mapInArrow(_verify(percent), "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, coordinates: int = 128, matches: int | None = None, seed: int = 20
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    `width`: words of a shingle. `percent`: two documents are linked if 100 * intersection >= percent * union of
    their shingle sets. `matches`: coordinates that must match before sets are compared; by default 5.5 standard deviations
    below what a pair at the threshold has on average.

    Defined results: null, empty and wordless texts have n_shingles 0 and are linked with nothing; fewer words than
    `width` make one shingle. Every row of `docs` has a row of its own in the result. Rows with equal texts share a component, whatever their ids; one
    id with different texts is answered for each of them. component_id is the smallest id in the component; `kept` where it is the
    row's own. Rows with a null id are linked with nothing, have a null component_id and are kept. An empty table gives an empty result. Other
    columns of `docs` are not looked at.
    """
    classes, feats, named, scratch = _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, percent, coordinates, matches, seed)
    members = _in_classes(feats.filter("n > 0 and doc_id is not null").select("doc_id", "n", "fa", "fb"), classes, named).select("doc_id", "n", "component_id")
    members = members.unionByName(feats.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    out = scratch.table(members.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")), "result")
    scratch.drop_all_but("result")
    return out


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, coordinates: int = 128, matches: int | None = None, seed: int = 20) -> DataFrame:
    """The rows of `docs`, with all columns, but one row of each group of near copies.

    Texts are grouped whatever their ids. Of a group the row with the smallest id stays (null ids last); where that id has several
    texts of the group, the one with the smallest hash; of equal rows one. Texts without words are no copies of anything and all stay. An
    empty table stays empty.
    """
    marks = {"of": F.xxhash64(text_col), "no_id": F.col(id_col).isNull(), "id": F.coalesce(F.col(id_col).cast("long"), F.lit(0))}
    key = list(marks)
    marked = boxed(docs, **marks)
    texts = docs.select(marks["of"].alias("doc_id"), F.col(text_col).alias("text"))
    classes, feats, named, scratch = _components(texts, width, percent, coordinates, matches, seed)
    groups = _in_classes(feats.filter("n > 0").select("doc_id", "n", "fa", "fb").distinct(), classes, named)
    rows = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    rows = scratch.table(rows.join(groups.select(F.col("doc_id").alias("of"), F.col("component_id").alias("group")), "of"), "rows")
    # Groups of one row need no decision; those of several are few enough to go to every task, or are joined by a shuffle.
    firsts = rows.groupBy("group").agg(F.min(F.struct("no_id", "id", "of")).alias("first"), F.count(F.lit(1)).alias("members"), F.max("times").alias("most"))
    firsts = scratch.table(firsts.filter("members > 1 or most > 1").select("group", "first"), "firsts")
    rows = scratch.table(rows.join(_small(firsts), "group").withColumn("gone", F.struct("no_id", "id", "of") != F.col("first")).filter("gone or times > 1").select(*key, "gone"), "marked")
    scratch.drop_all_but("marked")
    gone, repeated = _small(rows.select(*key)), _small(rows.filter("not gone").select(*key))
    once = unboxed(marked.join(gone, key, "left_anti"), docs.columns)
    return once.unionByName(unboxed(marked.join(repeated, key, "left_semi").dropDuplicates(key), docs.columns))


def _in_classes(rows: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """`rows` (doc_id, n, fa, fb) with the smallest id of their component."""
    of_class = classes.join(named, "node", "left").select("n", "fa", "fb", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(of_class, ["n", "fa", "fb"])


def _components(docs: DataFrame, width: int, percent: int, coordinates: int, matches: int | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """(classes, features, (node, component_id) of classes with links, scratch) of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    p = percent / 100
    if matches is None:
        matches = max(1, math.floor(coordinates * p - 5.5 * math.sqrt(coordinates * p * (1 - p))))

    feats = docs.mapInArrow(_features(width, coordinates, seed), "doc_id long, n long, fa long, fb long, sig array<int>")
    feats = scratch.table(feats.withColumn("row", F.monotonically_increasing_id()), "features")
    sized = feats.filter("n > 0 and doc_id is not null")
    # Written, so that joins with it shuffle both sides plainly and a hot class can be split.
    classes = sized.groupBy("n", "fa", "fb").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = scratch.table(classes.select("n", "fa", "fb", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("node")), "classes")
    # Sets of n and n + 1 shingles cannot be linked below this n; such sets are linked with equal sets only.
    least = math.ceil(p / (1 - p) - 1e-9) if p < 1 else 1 << 62
    reps = sized.filter(F.col("n") >= least).select(F.col("row").alias("node"), "sig")
    copies = sized.select("row", "n", "fa", "fb").join(classes, ["n", "fa", "fb"]).filter("row <> node").select(F.col("row").alias("node"))
    reps = reps.join(_small(scratch.table(copies, "copies")), "node", "left_anti")

    star, sketches = _star(reps, scratch, coordinates, matches)
    edges = _links(docs, classes, star, sketches, scratch, width, percent, coordinates, matches)
    comps = scratch.table(connected_components(edges, scratch, "final"), "components")
    least = scratch.table(comps.join(classes, "node").groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.table(comps.join(_small(least), "component").select("node", "component_id"), "named")
    scratch.drop("copies", "star", "sketches", "first", "second")
    return classes, feats.drop("sig"), named, scratch


def _small(ids: DataFrame) -> DataFrame:
    """Marks a table of ids for broadcasting if it is short enough; otherwise it is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _star(reps: DataFrame, scratch: Scratch, coordinates: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """(hub, node, near), (node, sketch): the members that meet a hub in a prefix list; near, if their sketches agree in enough coordinates."""
    # Coordinates go in rounds, so that a part of all values is shuffled at a time; frequencies are grouped counts, not windows.
    parts, n = [], reps.count()
    each = max(1, -(-coordinates // max(1, min(ROUNDS, n // ROUND_ROWS))))
    for at in range(0, coordinates, each):
        tokens = reps.select("node", F.posexplode(F.slice("sig", at + 1, each)).alias("at", "value"))
        token = F.shiftleft((F.col("at") + at).cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        tokens = tokens.select("node", token.alias("token"))
        shared = scratch.table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), f"shared-{at}")
        free()
        # Any order of values serves, as long as it is the same for all: by frequency in eighths of an octave, then value, in one number.
        ranked = F.shiftleft(F.floor(F.log2("freq") * 8).cast("long"), 48).bitwiseOR(F.col("token"))
        parts.append(scratch.table(tokens.join(shared, "token").select("node", ranked.alias("ranked"), "freq"), f"ranked-{at}"))
        scratch.drop(f"shared-{at}")
        free()
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    lists = rows.repartition("node").groupBy("node").agg(F.sort_array(F.collect_list("ranked")).alias("shared"), F.sum("freq").alias("weight"))
    lists = lists.filter(F.size("shared") >= matches)
    postings = lists.select("node", "weight", F.explode(F.slice("shared", F.lit(1), F.size("shared") - (matches - 1))).alias("token"))
    postings = scratch.table(postings, "postings")
    scratch.drop(*[f"ranked-{at}" for at in range(0, coordinates, each)])
    free()
    hubs = postings.groupBy("token").agg(F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("size"))
    hubs = hubs.filter("size > 1").select("token", (-F.col("best.neg")).alias("hub"), "size")
    star = postings.join(hubs, "token").filter("node <> hub").groupBy("hub", "node").agg(F.max("size").alias("size"))
    # Sketches decide on pairs that stand alone in their lists; members of longer lists stay, for each other's sake.
    star = scratch.table(star, "met")
    ids = scratch.table(star.select("node").unionByName(star.select(F.col("hub").alias("node"))).distinct(), "known")
    sketches = reps.join(_small(ids), "node", "left_semi").select("node", "sig").mapInArrow(_sketches, "node long, sketch array<long>")
    sketches = scratch.table(sketches, "sketches")
    # The members of a hub are dealt to as many copies of it as they need.
    copies = star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("copies"))
    hubs = sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")).join(copies, "hub")
    hubs = hubs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    many = scratch.table(copies.filter("copies > 1"), "many")
    star = star.join(_small(many), "hub", "left").withColumn("copy", F.pmod(F.xxhash64("node"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    star = star.join(sketches, "node").join(hubs.drop("copies"), ["hub", "copy"])
    near = _different("sketch", "hub_sketch", coordinates) <= coordinates - matches
    star = scratch.table(star.withColumn("near", near).filter("near or size > 2").select("hub", "node", "near"), "star")
    scratch.drop("postings", "met", "known", "many")
    free()
    return star, sketches


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(node, shingles): the full sets of `nodes` (node)."""
    nodes = scratch.table(nodes.distinct().join(classes, "node").select("node", F.col("rep").alias("doc_id"), "n", "fa", "fb"), "nodes")
    texts = docs.join(_small(nodes.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(width), "doc_id long, n long, fa long, fb long, shingles binary")
    sets = scratch.table(sets.join(_small(nodes), ["doc_id", "n", "fa", "fb"]).select("node", "shingles"), "sets")
    scratch.drop("nodes")
    return sets


def _links(docs: DataFrame, classes: DataFrame, star: DataFrame, sketches: DataFrame, scratch: Scratch, width: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    """(u, v): confirmed links between classes that connect whatever links of any two members of a list connect."""
    near = star.filter("near")
    sizes = scratch.table(near.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "hubs")
    best = near.join(_small(sizes), "hub").groupBy("node").agg(F.max(F.struct("size", (-F.col("hub")).alias("neg"))).alias("best"))
    best = scratch.table(best.select("node", (-F.col("best.neg")).alias("hub")), "best")
    sizes = scratch.table(best.groupBy("hub").agg(F.count(F.lit(1)).alias("n_right")).withColumn("n_left", F.lit(1)), "centres")
    right = best.join(_small(sizes), "hub").select(F.col("hub").alias("family"), "node", F.col("node").alias("comp"), F.lit(RIGHT).alias("side"), "n_left", "n_right")
    left = sizes.select(F.col("hub").alias("family"), F.col("hub").alias("node"), F.col("hub").alias("comp"), F.lit(LEFT).alias("side"), "n_left", "n_right")
    sets = _sets_of(best.select("node").unionByName(sizes.select(F.col("hub").alias("node"))), docs, classes, scratch, width)
    first = scratch.table(_block_links(left, right, sets, percent), "first")
    scratch.drop("sets", "hubs", "centres")
    free()

    comps = scratch.table(connected_components(first, scratch, "round"), "joined")
    tried = best.select("node", F.col("hub").alias("family"), F.lit(True).alias("tried"))
    family = star.select(F.col("hub").alias("family"), "node").unionByName(star.select(F.col("hub").alias("family"), F.col("hub").alias("node")).distinct())
    family = family.join(comps, "node", "left").join(tried, ["node", "family"], "left").select("family", "node", F.coalesce("component", "node").alias("comp"), F.coalesce("tried", F.lit(False)).alias("tried"))
    family = scratch.table(family, "families")
    of_hub = family.filter("node = family").select("family", F.col("comp").alias("hub_comp"))
    family = family.join(_small(of_hub), "family").withColumn("apart", F.col("comp") != F.col("hub_comp"))
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("n_right"), F.count_if("apart").alias("n_left"), F.count_if(F.col("apart") & F.col("tried")).alias("n_tried"))
    sizes = sizes.filter("n_left > 1 or n_left = 1 and (n_right > 2 or n_tried = 0)").drop("n_tried")
    family = family.join(_small(scratch.table(sizes, "apart")), "family")
    # Sketches go first, as they are small: the sets of a family's members are many times larger, and most members are like nobody.
    lists = family.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_right")).alias("neg"), "family"))).getField("family").alias("of"))
    values = sketches.join(lists, "node").select("node", F.concat("sketch", "of").alias("sketch"))
    left = family.filter("apart").withColumn("side", F.when(F.col("tried"), TRIED_LEFT).otherwise(LEFT))
    right = family.withColumn("side", F.when(F.col("apart"), APART_RIGHT).otherwise(RIGHT))
    alike = _blocks(left, right, values, SKETCH_BLOCK).mapInArrow(_alike(coordinates - matches, PLANES * -(-coordinates // 64)), "family long, node long, side long")
    alike = scratch.table(alike.distinct(), "alike")
    scratch.drop("families", "apart", "best")
    free()
    sizes = alike.groupBy("family").agg(F.count_if(F.col("side") == LEFT).alias("n_left"), F.count_if(F.col("side") == RIGHT).alias("n_right"))
    members = alike.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).join(_small(scratch.table(sizes, "paired")), "family")
    sets = _sets_of(alike.select("node"), docs, classes, scratch, width)
    second = scratch.table(_block_links(members.filter(F.col("side") == LEFT), members.filter(F.col("side") == RIGHT), sets, percent), "second")
    scratch.drop("sets", "joined", "alike", "paired")
    free()
    return first.unionByName(second)
