"""Jaccard join on word shingles: an LSH forest over MinHash signatures, and exact verification.

Texts with one set of shingles are a class and travel as one. Each class stands in every tree of the forest by a row
of its signature's values, and classes that share a prefix of it are at one node of that tree. Nodes at the full depth
are looked at first: classes there whose whole signatures are alike form loose groups, which are compared exactly, by
their sets. The links found tell what share the prefix finds (`forest_recall`); while that is below the target, the
prefix is shortened, only nodes with classes of different groups are looked at again, and only groups that grew are
compared anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelake.llm.components import connected_components
from racelake.llm.groups import block_pairs, by_unit, roots
from racelake.llm.words import mix, row_slices, windows, words_of
from racelake.sources.scratch import stable

TREES, DEPTH = 16, 8
SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.9995
#: Recall is measured in bands of similarity, on so many links of a class in a unit of work.
BANDS, AUDITED = 3, 16
_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
SKETCH = "row bigint, shingles int, s1 bigint, s2 bigint, signature binary"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of rows: all rows' sorted distinct shingle hashes, one row after the other, and their number in
    each row. A text of fewer than `size` words is one shingle, a text without words has none."""
    for start, end in row_slices(texts):
        words = words_of(texts.slice(start, end - start))
        first, per_row = words.first_of_row(), words.per_row()
        hashes = words.hashes()
        at, found = windows(hashes, first, size)
        row = words.row[at]
        for short in range(1, size):
            rows = np.flatnonzero(per_row == short)
            if len(rows):
                begin = first[rows]
                whole = np.zeros(len(rows), np.uint64)
                for k in range(short):
                    whole = mix(whole * np.uint64(3) + hashes[begin + k])
                row, found = np.concatenate([row, rows]), np.concatenate([found, whole])
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        yield found[new], np.bincount(row[new], minlength=words.rows)


def _set_hash(hashes: np.ndarray, sizes: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """One number for each row's set; 0 for an empty one."""
    found, has = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(has):
        found[has] = mix(np.add.reduceat(mix(hashes ^ salt), (np.cumsum(sizes) - sizes)[has]))
    return found.view(np.int64)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashes, sizes in shingle_sets(batch.column(1), size):
                ids = batch.column(0).slice(at, len(sizes))
                at += len(sizes)
                has = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[has]
                values = np.empty((len(has), len(_SEEDS)), np.uint16)
                if len(has):
                    for k, seed in enumerate(_SEEDS):
                        least = np.minimum.reduceat(hashes * seed >> np.uint64(16), starts)
                        values[:, k] = mix(least).astype(np.uint16)
                signature = [None] * len(sizes)
                for k, row in enumerate(has):
                    signature[row] = values[k].tobytes()
                yield pa.record_batch(
                    [
                        ids,
                        pa.array(sizes.astype(np.int32)),
                        pa.array(_set_hash(hashes, sizes)),
                        pa.array(_set_hash(hashes, sizes, _SEEDS[0])),
                        pa.array(signature, pa.binary()),
                    ],
                    names=["row", "shingles", "s1", "s2", "signature"],
                )

    return run


def meeting_chance(similarity: float, prefix: int, trees: int = TREES) -> float:
    """Chance that two sets share a prefix in some tree."""
    return 1.0 - (1.0 - similarity**prefix) ** trees


def band_edges(threshold: float) -> np.ndarray:
    """Lower ends of the bands; the last band is twice as wide."""
    return threshold + (1.0 - threshold) * np.arange(BANDS) / (BANDS + 1)


def forest_recall(audit: np.ndarray, depth: int, threshold: float, target: float) -> float:
    """The share of links that meet at a node of `depth`, in the band where it is smallest.

    `audit[band, depth - 1]` counts verified links that meet in no, one, two and any trees. Links that met nowhere are
    known only where others held their group together, so what is missing is taken from the links met once and twice
    (Chao's estimate for capture and recapture), if that is more. A band with too few links to tell `target` from 1
    has the chance that is calculated for its lower end.
    """
    shares = []
    for lower, (none, once, twice, found) in zip(band_edges(threshold), audit[:, depth - 1].tolist(), strict=True):
        if (none + found) * (1.0 - target) < 1.0:
            shares.append(meeting_chance(lower, depth))
        else:
            missing = max(none, (TREES - 1) / TREES * once * (once - 1) / (2 * (twice + 1)))
            shares.append(found / (found + missing))
    return min(shares)


def next_depth(audit: np.ndarray, depth: int, threshold: float, target: float) -> int | None:
    """None if `depth` reaches the target, else the longest shorter prefix that is expected to. Links that a long
    prefix found make shorter ones look better than they are, so the step may be too small, never too large."""
    if depth == 1 or forest_recall(audit, depth, threshold, target) >= target:
        return None
    shorter = range(depth - 1, 0, -1)
    return next((d for d in shorter if forest_recall(audit, d, threshold, target) >= target), 1)


def _nodes(depth: int):
    """`group, rep, part` for each tree: the node at `depth` that a class is at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, TREES, DEPTH)
            keys = np.tile(np.arange(TREES, dtype=np.uint64), (n, 1))
            for k in range(depth):
                keys = mix(keys * _SEEDS[1] + raw[:, :, k] + np.uint64(1))
            times = pa.array(np.repeat(np.arange(n), TREES))
            ids, parts = batch.column(0).take(times), batch.column(2).take(times)
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), ids, parts], names=["group", "rep", "part"])

    return run


def _alike(least: float):
    """Groups that meet at one node in classes whose signatures agree in at least that share, as edges to a root."""

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        unit = unit.sort_by("part").combine_chunks()
        n, part = unit.num_rows, unit.column("part").to_numpy()
        begin, end = np.searchsorted(part, part), np.searchsorted(part, part, side="right")
        values = np.frombuffer(b"".join(unit.column("signature").to_pylist()), np.uint16).reshape(n, -1)
        left, right = [], []
        for k in range(n):
            if end[k] == n:
                break
            near = np.flatnonzero((values[end[k] :] == values[k]).mean(axis=1) >= least) + end[k]
            left.append(np.full(len(near), begin[k]))
            right.append(begin[near])
        if not left:
            return None
        root = roots(n, (np.concatenate(left), np.concatenate(right)))
        joined = np.flatnonzero(root != np.arange(n))
        if not len(joined):
            return None
        ids = unit.column("component").combine_chunks()
        return pa.record_batch([ids.take(pa.array(joined)), ids.take(pa.array(root[joined]))], names=["a", "b"])

    return work


def _audit(values: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: np.ndarray, threshold: float) -> np.ndarray:
    """Links by band and depth: how many meet in no, one, two and any trees."""
    counts = np.zeros((BANDS, DEPTH, 4), np.int64)
    if len(left):
        same = (values[left] == values[right]).reshape(-1, TREES, DEPTH)
        trees = np.logical_and.accumulate(same, axis=2).sum(axis=1)
        band = np.searchsorted(band_edges(threshold), similarity + 1e-9, side="right") - 1
        np.add.at(counts, band.clip(0), np.stack([trees == 0, trees == 1, trees == 2, trees > 0], axis=2).astype(np.int64))
    return counts


def _exact(threshold: float):
    """Links inside a unit: for each class an edge to a root and the texts it is linked with (`links`). The first row
    carries the unit's `audit`."""

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        # Rows with one id and one text come once each; one of them stands for the class.
        _, once = np.unique(unit.column("s1").to_numpy(), return_index=True)
        unit = unit.take(pa.array(once))
        n = unit.num_rows
        sets = [np.frombuffer(x, np.uint64) for x in unit.column("shingles").to_pylist()]
        own, texts = unit.column("own").to_numpy(), unit.column("texts").to_numpy()
        inner = unit.column("i")[0].as_py() == unit.column("j")[0].as_py()
        sizes = np.array([len(s) for s in sets])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        flag = np.zeros(len(values), bool)
        links, left, right, looked = np.zeros(n, np.int64), [], [], []
        for k in range(n - 1):
            mine = codes[starts[k] : starts[k] + sizes[k]]
            flag[mine] = True
            shared = np.add.reduceat(flag[codes[starts[k + 1] :]].astype(np.int64), starts[k + 1 :] - starts[k + 1])
            flag[mine] = False
            union = sizes[k] + sizes[k + 1 :] - shared
            linked = shared >= threshold * union - 1e-9
            if not inner:
                linked &= own[k + 1 :] != own[k]
            near = np.flatnonzero(linked)
            links[k] += texts[near + k + 1].sum()
            links[near + k + 1] += texts[k]
            left.append(np.full(len(near), k))
            right.append(near + k + 1)
            some = near[:AUDITED]
            looked.append((np.full(len(some), k), some + k + 1, shared[some] / union[some]))
        pairs = (np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)]))
        if not len(pairs[0]):
            return None
        root = roots(n, pairs)
        used = np.flatnonzero(links)
        ids = unit.column("rep").combine_chunks()
        values = np.frombuffer(b"".join(unit.column("signature").to_pylist()), np.uint16).reshape(n, -1)
        audit = _audit(values, *map(np.concatenate, zip(*looked, strict=True)), threshold).reshape(-1).tolist()
        return pa.record_batch(
            [ids.take(pa.array(used)), ids.take(pa.array(root[used])), pa.array(links[used]),
             pa.array([audit, *[None] * (len(used) - 1)], pa.list_(pa.int64()))],
            names=["a", "b", "links", "audit"],
        )

    return work


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            texts = batch.column(batch.schema.get_field_index("text"))
            for hashes, sizes in shingle_sets(texts, size):
                part = batch.slice(at, len(sizes))
                at += len(sizes)
                ends = np.cumsum(sizes)
                sets = [hashes[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
                names = ("rep", "group", "size", "texts", "s1", "signature")
                columns = {n: part.column(part.schema.get_field_index(n)) for n in names}
                made = pa.record_batch({**columns, "shingles": pa.array(sets, pa.binary())})
                # A row of the same id with another text belongs to another class.
                yield made.filter(pa.array(_set_hash(hashes, sizes) == columns["s1"].to_numpy()))

    return run


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    node_block: int = 512,
    set_block: int = 256,
) -> DataFrame:
    """One row for each row of `docs`: id, `copy_id` (smallest id with the same set of shingles), `class_id`
    (smallest id reachable by links), `n_links` (other rows linked directly) and `kept` (id = class_id).

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least `threshold`; words are
    taken as they are, shingles compared by 64-bit hashes. A text with fewer words than a shingle is one shingle; a
    null text or one without words links with nothing, and its class is its own id. A row with a null id links with
    nothing either, and has no class and `kept` true. Rows with one id are one document: if their texts differ, all
    of them are compared. Copies are not expanded into pairs. A long text gives all its shingles, as one row. Other columns are not looked at; an empty table gives
    an empty one.

    The forest's prefixes are shortened until recall, measured on the links found, is `target_recall` in every band of
    similarity. A link outside loose groups may be missed with a chance of at most about 1 - `target_recall`.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketches = rows.mapInArrow(_sketch(shingle), SKETCH.replace("row bigint", f"row {kind}"))
    sketches = stable(sketches.withColumnRenamed("row", "id"))
    usable = sketches.filter("id is not null and signature is not null")
    classes = stable(
        usable.groupBy("s1", "s2").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("texts"), F.first("signature").alias("signature")
        )
    )

    links, _ = forest_links(rows, classes, shingle, threshold, target_recall, node_block, set_block)
    joined = connected_components(links.select("a", "b"))
    counted = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    named = joined.join(counted, "node", "left").withColumnRenamed("node", "rep")
    of_class = classes.select("s1", "s2", "rep", "texts").join(named, "rep", "left")
    known = of_class.select("s1", "s2", "rep", "texts", "component", "links", F.lit(True).alias("usable"))
    every = sketches.select("id", "s1", "s2", (F.col("id").isNotNull() & (F.col("shingles") > 0)).alias("usable"))
    full = every.join(known, ["s1", "s2", "usable"], "left")
    class_id = F.coalesce("component", "rep", "id")
    return full.select(
        F.col("id").alias(id_col),
        F.coalesce("rep", "id").alias("copy_id"),
        F.when(F.col("id").isNotNull(), class_id).alias("class_id"),
        F.coalesce(F.col("links") + F.col("texts") - 1, F.col("texts") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"),
    )


def forest_links(
    rows: DataFrame,
    classes: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    node_block: int = 512,
    set_block: int = 256,
) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Verified links `a, b, links, audit` of `classes`, and the depths looked at with the recall found for each."""
    depth, passes, links = DEPTH, [], None
    state = classes.withColumn("component", F.col("rep"))
    while True:
        merged = stable(connected_components(_meetings(state, depth, threshold, node_block)))
        grown = state.withColumnRenamed("component", "node").join(merged, "node").drop("node")
        fresh = _verified(rows, grown, shingle, threshold, set_block)
        if links is not None:
            again = grown.select(F.col("rep").alias("a"))
            fresh = stable(links.join(again, "a", "left_anti").unionByName(fresh))
        links = fresh
        audit = np.zeros(BANDS * DEPTH * 4, np.int64)
        for place, n in links.select(F.posexplode("audit")).groupBy("pos").agg(F.sum("col")).collect():
            audit[place] = n
        audit = audit.reshape(BANDS, DEPTH, 4)
        passes.append((depth, forest_recall(audit, depth, threshold, target_recall)))
        shorter = next_depth(audit, depth, threshold, target_recall)
        if shorter is None:
            return links, passes
        depth = shorter
        renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        joined = state.join(renamed, "component", "left")
        state = stable(joined.withColumn("component", F.coalesce("whole", "component")).drop("whole"))


def _meetings(state: DataFrame, depth: int, threshold: float, node_block: int) -> DataFrame:
    """Edges `a, b` between groups that have classes with like signatures at one node of `depth`."""
    kind = state.schema["rep"].dataType.simpleString()
    parts = state.select("rep", "signature", F.xxhash64("component").alias("part"))
    nodes = stable(parts.mapInArrow(_nodes(depth), f"group bigint, rep {kind}, part bigint"))
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    shared = sizes.filter("lo < hi").select("group", "size")
    members = nodes.join(shared, "group").join(state.select("rep", "signature", "component"), "rep")
    # Four deviations of the estimate below the threshold; what is let through is compared exactly later.
    least = threshold - 4 * (threshold * (1 - threshold) / len(_SEEDS)) ** 0.5
    units = block_pairs(members, "size", node_block, "rep").select("group", "i", "j", "part", "component", "signature")
    return by_unit(units, _alike(least), f"a {kind}, b {kind}")


def _verified(rows: DataFrame, grown: DataFrame, shingle: int, threshold: float, set_block: int) -> DataFrame:
    """Verified links inside the groups of `grown`."""
    kind = grown.schema["rep"].dataType.simpleString()
    grown = stable(grown.select("rep", "component", "texts", "s1", "signature"))
    sizes = grown.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = grown.join(sizes, "component").withColumn("group", F.xxhash64("component")).drop("component")
    sets = rows.select(F.col("id").alias("rep"), "text").join(named, "rep").mapInArrow(
        _set_rows(shingle),
        f"rep {kind}, group bigint, size bigint, texts bigint, s1 bigint, signature binary, shingles binary",
    )
    pairs = block_pairs(sets, "size", set_block, "rep")
    return stable(by_unit(pairs, _exact(threshold), f"a {kind}, b {kind}, links bigint, audit array<bigint>"))
