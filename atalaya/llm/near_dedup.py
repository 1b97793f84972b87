"""Near duplicates by a chosen-path set similarity join over word shingles.

A document's set is its distinct five-word shingles. Equal sets form a class, and only classes are joined. TREES
independent trees start each class at a node named by one minwise value of its set; deeper nodes branch on the places of
a sketch (PLACES minwise values, one byte each) that the node's own path chooses: one place, and a second one in a third
of the nodes, so that a class of similarity 0.75 is expected to stay with another once a level, whatever the depth.

Nodes of at most SMALL classes are compared exhaustively by their sketches. What may be linked (AGREE places or more: 3.7
standard deviations below 0.75) is confirmed on full sets, recomputed from the texts of just those classes, in two rounds:
first each node's spanning forest of the most similar pairs; then, in nodes where components of the first round may still
be linked, the classes in question meet with their sets, and the node's exact links between components are found by
counting shared shingles. Either round gives less than one pair a class and node, so a group of near copies costs its
size in rows, and no possible link is left out. Larger nodes are branched further. From level FREE on they are also
compared with a leader, another one each level, and nodes whose classes are all in one component end; what is still
large after LEVELS is compared across components.

Recall of a link of similarity exactly 0.75 over 16 trees is above 0.999 where nodes are small by the second level;
links of higher similarity are surer. Confirmed links are exact.

Defined results: null texts, and texts without words, have empty sets, are linked with nothing and are their own
component; texts of fewer than five words have one shingle, the whole sequence; a null doc_id has a component of null
if nothing else is in it; repeated rows are in one class. Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DOC_COLUMNS, batches, documents, materialize, row_key, sized
from ._words import U, mix, shingle_sets
from .components import components

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
PLACES = 128
TREES = 16
SMALL = 4096
FREE = 4
LEVELS = 10
#: Sketches that agree in fewer places rule a pair out.
AGREE = 78

_SEEDS = mix(np.arange(1, PLACES + TREES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, __row (a key of the row's values), n (set size), cls (hash of the set; null if empty), sig, roots."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows, 2 << 20):
            sets = shingle_sets(data, offsets, size)
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            classes, sigs, roots = np.zeros(len(sets), np.int64), np.zeros((len(sets), PLACES), np.uint8), np.zeros((len(sets), TREES), np.int64)
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                starts = np.cumsum(sizes[full]) - sizes[full]
                classes[full] = mix(np.add.reduceat(mix(flat + U(1)), starts) + sizes[full].astype(U)).view(np.int64)
                for k in range(PLACES + TREES):
                    least = mix(np.minimum.reduceat(flat * _SEEDS[k], starts) + U(k))
                    if k < PLACES:
                        sigs[full, k] = least.astype(np.uint8)
                    else:
                        roots[full, k - PLACES] = least.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("__row"), pa.array(sizes), pa.array(classes, mask=sizes == 0),
                    pa.array([x.tobytes() for x in sigs], pa.binary()), pa.ListArray.from_arrays(np.arange(0, roots.size + 1, TREES, dtype=np.int32), roots.ravel()),
                ],
                names=["doc_id", "__row", "n", "cls", "sig", "roots"],
            )

    keyed = documents(docs).withColumn("__row", row_key(F.col("doc_id"), F.col("text")))
    return keyed.mapInArrow(run, "doc_id long, __row long, n long, cls long, sig binary, roots array<long>")


def _children(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cls): each node branched on the places that its path chooses."""
    value = lambda k: F.substring(F.col("sig"), F.pmod(F.xxhash64("node", F.lit(k)), F.lit(PLACES)).cast("int") + 1, F.lit(1))
    child = lambda k: F.xxhash64("node", F.lit(k), value(k))
    deeper = F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(3)) == 0, F.array(child(0), child(1))).otherwise(F.array(child(0)))
    return nodes.select("node", "cls").join(classes.select("cls", "sig"), "cls").select(F.explode(deeper).alias("node"), "cls").distinct()


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes do not rule a link out."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            sigs = [np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, PLACES) for k in ("sig_a", "sig_b")]
            yield part.select(["a", "b"]).filter(pa.array((sigs[0] == sigs[1]).sum(1) >= AGREE))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _agreement(sizes: np.ndarray, sigs: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """In how many places the classes of a node agree (a square, at most SMALL wide); 0 where no new link is possible."""
    out = np.zeros((len(sizes), len(sizes)), np.uint8)
    step = max(1, (1 << 23) // (PLACES * len(sizes)))
    for at in range(0, len(sizes), step):
        rows = slice(at, at + step)
        agree = (sigs[rows, None, :] == sigs[None, :, :]).sum(2).astype(np.uint8)
        possible = (agree >= AGREE) & (tops[rows, None] != tops[None, :])
        possible &= 100 * np.minimum.outer(sizes[rows], sizes) >= PERCENT * np.maximum.outer(sizes[rows], sizes)
        out[rows] = np.where(possible, agree, 0)
    return out


def _join(labels: np.ndarray, i: int, near: np.ndarray, weight: np.ndarray) -> list[int]:
    """Join i with the heaviest of near in each component that is not i's; the ones taken."""
    near = near[np.argsort(-weight.astype(np.int64), kind="stable")]
    found, first = np.unique(labels[near], return_index=True)
    labels[np.isin(labels, found)] = labels[i]
    return near[first].tolist()


def _forest(agree: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the possible pairs, the most similar first, in steps of six places."""
    labels, kept = np.arange(len(agree)), []
    rows = np.flatnonzero(agree.any(1)).tolist()
    for least in range(PLACES - 6, AGREE - 6, -6):
        for i in rows:
            near = np.flatnonzero((agree[i] >= max(least, AGREE)) & (labels != labels[i]))
            if len(near):
                kept += [(i, j) for j in _join(labels, i, near, agree[i, near])]
    return kept


def _node_rows(nodes: DataFrame, classes: DataFrame, first: bool) -> DataFrame:
    """Over nodes (node, cls, top). If first, (node, a, b): the forest of possible pairs, and (node, null, null) where there
    are more of them; else (node, a, null): the classes that may be linked with another component's."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for node, ids, sizes, tops, sigs in zip(*(part.column(k) for k in ("node", "ids", "sizes", "tops", "sigs")), strict=True):
                c, n, t = (x.values.to_numpy() for x in (ids, sizes, tops))
                order = np.argsort(c)
                agree = _agreement(n[order], np.frombuffer(b"".join(sigs.values.to_pylist()), np.uint8).reshape(-1, PLACES)[order], t[order])
                if not agree.any():
                    continue
                c, a, b = c[order], [], []
                if first:
                    kept = _forest(agree)
                    a, b = [int(c[min(p)]) for p in kept], [int(c[max(p)]) for p in kept]
                    if 2 * len(kept) < np.count_nonzero(agree):
                        a.append(None)
                        b.append(None)
                else:
                    a = c[agree.any(1)].tolist()
                    b = [None] * len(a)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["node", "a", "b"])

    lists = nodes.join(classes.select("cls", "n", "sig"), "cls").groupBy("node")
    lists = lists.agg(F.collect_list("cls").alias("ids"), F.collect_list("n").alias("sizes"), F.collect_list("top").alias("tops"), F.collect_list("sig").alias("sigs"))
    return lists.mapInArrow(run, "node long, a long, b long")


def _exact_links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links between components within nodes (node, cls, top), by full sets."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for ids, tops, items in zip(*(part.column(k) for k in ("ids", "tops", "sets")), strict=True):
                c, t, lists = ids.values.to_numpy(), tops.values.to_numpy(), items.values
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(c)), sizes)
                _, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                held = owner[np.argsort(place, kind="stable")]  # owners by shingle
                end = np.cumsum(np.bincount(place))
                begin, ends, kept = end - np.bincount(place), np.cumsum(sizes), []
                labels = np.unique(t, return_inverse=True)[1]
                for i in range(len(c)):
                    own = place[ends[i] - sizes[i] : ends[i]]
                    both = np.bincount(np.concatenate([held[begin[s] : end[s]] for s in own]), minlength=len(c))
                    near = np.flatnonzero((100 * both >= PERCENT * (sizes[i] + sizes - both)) & (labels != labels[i]))
                    if len(near):
                        kept += [(c[i], c[j]) for j in _join(labels, i, near, both[near])]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(np.min(kept, 1)), pa.array(np.max(kept, 1))], names=["a", "b"])

    lists = nodes.join(sets, "cls").groupBy("node").agg(F.collect_list("cls").alias("ids"), F.collect_list("top").alias("tops"), F.collect_list("items").alias("sets"))
    return lists.select("ids", "tops", "sets").mapInArrow(run, "a long, b long")


def _sets(wanted: DataFrame, sketches: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(cls, items): the full sets of the classes in wanted (cls), written out."""
    # One row stands for its class; its text is found by the row's key.
    wanted = sketches.where("cls IS NOT NULL").join(wanted.distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("__row").alias("__row"))
    wanted = sized(materialize(wanted, "wanted"))
    keyed = documents(docs).withColumn("__row", row_key(F.col("doc_id"), F.col("text")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows):
            sets = [x.view(np.int64) for x in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets))], names=["cls", "items"])

    return materialize(keyed.join(wanted, "__row").select("cls", "text").mapInArrow(run, "cls long, items array<long>"), "sets")


def _confirmed(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked by their full sets."""
    pairs = materialize(pairs, "pairs")
    sets = _sets(pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))), sketches, docs, size)
    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return joined.where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b")


def _named(nodes: DataFrame, tops: DataFrame | None) -> DataFrame:
    """(node, cls, top): the component of each class so far; itself if it has none."""
    if tops is None:
        return nodes.select("node", "cls", F.col("cls").alias("top"))
    return nodes.select("node", F.col("cls").alias("__cls")).join(tops.withColumnRenamed("node", "__node"), F.col("__cls") == F.col("__node"), "left").select("node", F.col("__cls").alias("cls"), F.coalesce("root", "__cls").alias("top"))


def link_classes(sketches: DataFrame, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, root): components of linked classes that are not alone."""
    classes = sketches.where("cls IS NOT NULL").groupBy("cls").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("roots").alias("roots"))
    classes = materialize(classes, "classes")
    nodes, links, tops = classes.select(F.explode("roots").alias("node"), "cls"), None, None
    small: list[DataFrame] = []

    def add(new: DataFrame) -> None:
        nonlocal links, tops
        links = materialize(new if links is None else links.unionAll(new), "links")
        tops = materialize(components(links), "tops")

    def confirm(pairs: DataFrame) -> None:
        add(_confirmed(pairs.select("a", "b").distinct(), sketches, docs, size))

    for level in range(1, LEVELS + 1):
        named = _named(nodes, tops)
        if tops is None:
            sizes = named.groupBy("node").agg(F.count("*").alias("size"), F.min("cls").alias("leader"), F.max("cls").alias("last"))
            sizes = sizes.where("leader <> last").select("node", "size", "leader", F.col("leader").alias("led"))
        else:
            named = materialize(named, "named")
            order = F.struct(F.xxhash64("cls", F.lit(level)), "cls", "top")
            sizes = named.groupBy("node").agg(F.count("*").alias("size"), F.min(order).alias("first"), F.min("top").alias("t0"), F.max("top").alias("t1"))
            sizes = sizes.where("t0 <> t1").select("node", "size", F.col("first.cls").alias("leader"), F.col("first.top").alias("led"))
        live = materialize(named.join(sizes, "node"), "nodes")
        small.append(live.where(F.col("size") <= SMALL).select("node", "cls"))
        large = live.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if level >= FREE:
            stars = large.where("cls <> leader AND top <> led").select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
            confirm(_possible(stars.distinct(), classes))
        if level == LEVELS:  # the exact rest: across components, within the nodes that no level could split
            rest = materialize(_named(large, tops), "named")
            x, y = (rest.select("node", F.col("cls").alias(c), F.col("top").alias(f"top_{c}")) for c in "ab")
            confirm(_possible(x.join(y, "node").where("a < b AND top_a <> top_b").select("a", "b").distinct(), classes))
        else:
            nodes = materialize(_children(large, classes), "children")

    leaves = small[0]
    for x in small[1:]:
        leaves = leaves.unionAll(x)
    forest = materialize(_node_rows(_named(leaves, tops), classes, first=True), "forest")
    confirm(forest.where("a IS NOT NULL"))
    again = forest.where("a IS NULL").select("node").distinct()
    if not again.isEmpty():
        named = materialize(_named(leaves.join(again, "node", "left_semi"), tops), "named")
        several = named.groupBy("node").agg(F.min("top").alias("t0"), F.max("top").alias("t1")).where("t0 <> t1").select("node")
        open_rows = materialize(_node_rows(named.join(several, "node", "left_semi"), classes, first=False).select("node", F.col("a").alias("cls")), "open")
        if not open_rows.isEmpty():
            sets = _sets(open_rows.select("cls"), sketches, docs, size)
            add(_exact_links(_named(open_rows, tops), sets))
    return tops


def _labelled(docs: DataFrame, size: int) -> DataFrame:
    """near_duplicates() with the rows' keys."""
    sketches = materialize(sketch(docs, size), "sketch")
    roots = link_classes(sketches, docs, size)
    slim = sketches.select("doc_id", "__row", "n", "cls")
    of_class = slim.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = of_class.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    named = materialize(named, "named")
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(by_root, "root").select("cls", "component_id")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = slim.join(labels, "cls", "left").select("doc_id", "__row", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; see the module."""
    return _labelled(docs, size).drop("__row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one of each group: that with the least doc_id. Repeated rows of it all stay."""
    flat = docs.select(*DOC_COLUMNS)
    gone = sized(materialize(_labelled(flat, SHINGLE).where("NOT kept").select("__row").distinct(), "gone"))
    return flat.withColumn("__row", row_key(F.col("doc_id"), F.col("text"))).join(gone, "__row", "left_anti").select(*DOC_COLUMNS)
