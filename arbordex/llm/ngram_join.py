"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of SIZE words; documents link when 100 * common >= PERCENT * all. Then the
symmetric difference has at most (100 - PERCENT) / (100 + PERCENT) of both sizes together.

Sketch. For each size band that a document's partners can be in, its shingles flip one bit each in a sketch of M
blocks of 2**32 bits; equal shingles flip the same bit, so the Hamming distance of two sketches is at most the symmetric
difference k. A block is kept as the XOR of the codes of its set bits. With M = k + 1 + slack blocks, linked documents
have slack + 1 equal blocks at least, by the pigeonhole principle.

Join. Blocks meet by (band, number, value); how many classes share a block is its frequency. A document may leave out its slack most
frequent blocks: of the blocks that two linked documents share, the rarest is among the k + 1 rarest of either. Empty
blocks and those that only hold a passage of many documents are left out that way, and documents with slack or fewer shared blocks altogether.

Verify. Documents with the same set are one class. First, each class meets the one pivot of its blocks' groups with which it shares
the most blocks; texts of pairs are compared exactly, and linked classes become components. Groups whose members are all in
one component are done: a link more would change nothing. In the open groups, those outside of the largest component look for their nearest
member of another one by sketches of BITS bits, whose Hamming distance must allow a link; rounds go on while they find links. At the end, all
pairs across components that the sketches still allow are compared, so components are exact. A group of copies is never expanded into pairs.

Large groups. What is known of a block meets its rows by a broadcast if it has a share of 1 / HOT of all rows or more (so HOT at most do),
and by a join otherwise. An open group of over GROUP classes is dealt into parts: each class is in one, and those outside of the largest component
look into all.

Null and empty texts have no shingles and are linked with nothing; fewer than SIZE words make one shingle. Null doc_id is no
component's smallest unless it is alone (null then). Rows that repeat are documents of the same class. Ties between pivots go to the larger hash.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .packed import SCHEMA, deal, pack, unpack
from .shared import discard, documents, free, row_key, shards, tune, written
from .words import Rolling, U, hashed, heads, mix, pieces, raw, salted, split

SIZE, PERCENT = 4, 85
#: Bits of the sketches that classes of open groups are compared by.
BITS = 2048
HOT, GROUP = 1000, 512
_TILE = 1 << 19
_INFO = ["<i8", "<i8", "<i8", "<u8"]  # doc, row, shingles, class
_BLOCKS = ["<u8", "<u8"]  # block, class
_MET = "kind int, x long, y long, doc long, row long, n long"
_IS_INFO, _IS_GROUP = range(2)
_NULL = -(1 << 63)


@cache
def bands(percent: int) -> np.ndarray:
    """Where the size bands start: partners' sizes differ by one band at most."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(100 * starts[-1] // percent + 1)
    return np.array(starts, np.int64)


@cache
def block_counts(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sketches for sizes from each band to the next: how many blocks, and how many of them may be left out."""
    top = bands(percent)[1:] - 1
    both = top + 100 * top // percent
    k = both * (100 - percent) // (100 + percent)
    slack = 5 + k
    return np.where(k > 0, k + 1 + slack, 0), slack  # k = 0: only equal sets link, which are one class


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted: text number and hash."""
    data, offsets = raw(texts, lower=True)
    starts, ends = split(data, offsets)
    cuts = np.searchsorted(starts, offsets)
    h = hashed(data, starts, ends)
    words = np.diff(cuts)
    doc = np.repeat(np.arange(len(texts)), words)
    at = np.flatnonzero(np.arange(len(h)) + size <= cuts[1:][doc]) if len(h) else np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < size))
    text = np.concatenate([doc[at], short])
    s = Rolling(h, 21).of(np.concatenate([at, cuts[:-1][short]]), np.concatenate([at + size, cuts[1:][short]]))
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    new = heads(text, s)
    return text[new], s[new]


def sketch_blocks(text: np.ndarray, s: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each text: text number and code. The code's last byte is the band."""
    starts, (blocks, _) = bands(percent), block_counts(percent)
    out = []
    band = np.searchsorted(starts, n, "right") - 1  # -1: no shingles
    for joint in (band, band - 1):
        m = np.where(joint >= 0, blocks[np.maximum(joint, 0)], 0)
        base = np.cumsum(m) - m
        used = m[text] > 0
        of, h = text[used], s[used]
        slot = base[of] + ((mix(h ^ salted(31)) >> U(32)) * m[of].astype(np.uint64) >> U(32)).astype(np.int64)
        value = np.zeros(int(m.sum()), np.uint64)
        np.bitwise_xor.at(value, slot, mix(h ^ salted(32)))
        owner = np.repeat(np.arange(len(n)), m)
        number = (np.arange(len(value)) - base[owner]) | joint[owner] << 40
        code = mix(value ^ mix(number.astype(np.uint64) + salted(33)))
        out.append((owner, code & ~U(255) | joint[owner].astype(np.uint64)))
    return np.concatenate([o for o, _ in out]), np.concatenate([c for _, c in out])


def _sent(texts: DataFrame, n: int, size: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_blocks, to_info = deal(n)
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, end, part in pieces(batch.column(2)):
                text, s = shingle_sets(part, size)
                count = np.bincount(text, minlength=len(part))
                sums = np.concatenate([[U(0)], np.cumsum(mix(s ^ salted(34)))])
                edge = np.concatenate([[0], np.cumsum(count)])
                class_ = mix((sums[edge[1:]] - sums[edge[:-1]]) + count.astype(np.uint64) * U(0x9E3779B97F4A7C15))
                to = to_info[(mix(ids[first:end].astype(np.uint64) + U(7)) % U(n)).astype(np.int64)]
                yield pack(to, [ids[first:end], rows[first:end], count.astype(np.int64), class_])
                # copies within the piece send their class's blocks once
                once = np.zeros(len(part), bool)
                once[np.unique(class_, return_index=True)[1]] = True
                pick = once[text]
                owner, code = sketch_blocks(text[pick], s[pick], np.where(once, count, 0), percent)
                yield pack(to_blocks[((code >> U(8)) % U(n)).astype(np.int64)], [code, class_[owner]])

    return texts.mapInArrow(run, SCHEMA)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: what is known of documents; blocks of several classes, with their number."""
    infos, blobs = [], []
    for batch in batches:
        for shard, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (infos if shard < 0 else blobs).append(rows)
    out = lambda kind, x, y, doc, row, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(doc), pa.array(row), pa.array(n)], names=["kind", "x", "y", "doc", "row", "n"])
    doc, row, n, class_ = unpack(infos, _INFO)
    if len(doc):
        yield out(_IS_INFO, class_, class_, doc, row, n)
    code, class_ = unpack(blobs, _BLOCKS)
    order = np.lexsort((class_, code))
    code, class_ = code[order], class_[order]
    new = heads(code, class_)
    code, class_ = code[new], class_[new]
    first = np.flatnonzero(heads(code))
    size = np.diff(np.concatenate([first, [len(code)]]))
    several = np.repeat(size > 1, size)
    code, class_, size = code[several], class_[several], size[size > 1]
    if not len(code):
        return
    yield out(_IS_GROUP, code, class_, np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), np.repeat(size, size).astype(np.int64))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts' sets are similar enough. texts: class, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, first = np.unique(b, return_index=True)  # a pivot's text is parsed once a batch
            sets: dict[int, np.ndarray] = {}
            for lo, hi, part in pieces(batch.column(3).take(pa.array(first))):
                text, s = shingle_sets(part, size)
                sets.update(zip(own[lo:hi].tolist(), np.split(s, np.cumsum(np.bincount(text, minlength=hi - lo))[:-1]), strict=True))
            good = np.zeros(len(a), bool)
            for lo, hi, part in pieces(batch.column(2)):
                text, s = shingle_sets(part, size)
                for i, mine in zip(range(lo, hi), np.split(s, np.cumsum(np.bincount(text, minlength=hi - lo))[:-1]), strict=True):
                    other = sets[int(b[i])]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    good[i] = both > 0 and 100 * both >= percent * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _spread(rows: DataFrame, per: DataFrame, total: int, key: str = "block", count: str = "n") -> DataFrame:
    """rows (key, ...) of total rows, with what per (key, count of its rows, ...) says of their keys; no task gets a large group. Both are written tables."""
    hot = F.col(count) * HOT >= total
    large = per.where(hot)  # HOT rows at most
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(rest.join(per.where(~hot), key))


def _kept(blocks: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """Without each class's most frequent blocks, as many in each band as may be left out, and without blocks of one class: block, class,
    pivot (the block's first class); and the number of rows. blocks: block, class, n."""
    band = F.col("block").bitwiseAND(F.lit(255)).cast("int")
    slack = F.element_at(F.array(*[F.lit(int(x)) for x in block_counts(percent)[1]]), F.col("band") + 1)
    frequent = Window.partitionBy("class", "band").orderBy(F.desc("n"), F.desc("block"))
    rare = written(blocks.withColumn("band", band).withColumn("place", F.row_number().over(frequent)).where(F.col("place") > slack).select("block", "class"), "rare")
    several = written(rare.groupBy("block").agg(F.count("*").alias("n"), F.min("class").alias("pivot")).where("n > 1"), "several")
    total = rare.count()
    groups = written(_spread(rare, several, total).select("block", "class", "pivot"), "groups")
    discard(rare, several)
    return groups, total


def _best(pairs: DataFrame) -> DataFrame:
    """For each class, the pivot with which it shares the most blocks. pairs: a, b, n."""
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return summed.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """class, n and a parity sketch of the whole set. texts: class, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in pieces(batch.column(1)):
                text, s = shingle_sets(part, size)
                bit = mix(s ^ salted(35)) & U(BITS - 1)
                flips = np.bincount(text * BITS + bit.astype(np.int64), minlength=(hi - lo) * BITS).reshape(hi - lo, BITS) & 1
                rows = [x.tobytes() for x in np.packbits(flips.astype(np.uint8), axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(text, minlength=hi - lo).astype(np.int64)), pa.array(rows, pa.binary())], names=["class", "n", "sketch"])

    return texts.select("class", "text").mapInArrow(run, "class long, n long, sketch binary")


def _near(class_: np.ndarray, component: np.ndarray, n: np.ndarray, sketch: np.ndarray, role: np.ndarray, percent: int, all_: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of one group: pairs across components that the sketches allow; the nearest one of each class, or all."""
    _, number, size = np.unique(component, return_inverse=True, return_counts=True)
    whole = (role == _WHOLE).any()
    from_ = np.flatnonzero(number != size.argmax()) if whole else np.flatnonzero(role == _LOOKS)
    to = np.arange(len(class_)) if whole else np.flatnonzero(role == _IS_THERE)
    a, b = [], []
    step = max(1, _TILE // max(1, len(to) * sketch.shape[1]))
    for i in range(0, len(from_) if len(to) else 0, step):
        x = from_[i : i + step]
        apart = np.bitwise_count(sketch[x][:, None, :] ^ sketch[to][None, :, :]).sum(2, dtype=np.int64)
        both = n[x][:, None] + n[to][None, :]
        ok = (apart <= both - 2 * -(-percent * both // (100 + percent))) & (number[x][:, None] != number[to][None, :])
        if all_:
            k, y = np.nonzero(ok)
        else:
            y = np.where(ok, apart, 1 << 40).argmin(1)
            k = np.flatnonzero(ok[np.arange(len(x)), y])
            y = y[k]
        a.append(class_[x[k]])
        b.append(class_[to[y]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


_WHOLE, _IS_THERE, _LOOKS = range(3)


def _parts(open_: DataFrame, total: int) -> DataFrame:
    """open_ (block, class, component, n) with group (a block, or a part of it) and role, before sketches are joined."""
    small = open_.where(F.col("n") <= GROUP).select("class", "component", F.xxhash64("block").alias("group"), F.lit(_WHOLE).alias("role"))
    large = open_.where(F.col("n") > GROUP)
    if large.isEmpty():
        return small
    sizes = large.groupBy("block", "component").agg(F.count("*").alias("k"))
    per = written(sizes.groupBy("block").agg(F.sum("k").alias("n"), F.max_by("component", F.struct("k", "component")).alias("largest")), "largest")
    rows = _spread(large.select("block", "class", "component"), per, total).withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))
    there = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("role", F.lit(_IS_THERE))
    looks = rows.where("component <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(_LOOKS))
    return small.unionByName(there.unionByName(looks).select("class", "component", F.xxhash64("block", "part").alias("group"), "role"))


def _across(open_: DataFrame, n: int, percent: int, all_: bool) -> DataFrame:
    """Pairs (a, b) of classes of open groups. open_: group, class, component, role, n, sketch. A group streams by in the order of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            group, class_, component, role, size = (t.column(i).to_numpy() for i in range(5))
            sketch = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(len(group), -1)
            first = np.flatnonzero(heads(group))
            a, b = [], []
            for f, e in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True):
                x, y = _near(class_[f:e], component[f:e], size[f:e], sketch[f:e], role[f:e], percent, all_)
                a.append(x)
                b.append(y)
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

        for batch in batches:
            group = batch.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0  # where the batch's last group starts
            if cut:  # a group ends in this batch: what came before is whole
                held.append(batch.slice(0, cut))
                yield from pairs()
                held = []
            elif held and len(group) and held[-1].column(0)[0].as_py() != group[0]:
                yield from pairs()
                held = []
            if len(group):
                held.append(batch.slice(cut))
        yield from pairs()

    dealt = open_.repartition(n, "group").sortWithinPartitions("group", "class")
    return dealt.select("group", "class", "component", "role", "n", "sketch").mapInArrow(run, "a long, b long").distinct()


def _prepared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """What is known of documents (doc, row, n, class), their groups and the groups' rows, and a text for each class of a group."""
    tune(docs.sparkSession)
    n = shards(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), row_key("text").alias("row"), "text")
    met = written(_sent(texts, n, size, percent).repartition(n, "shard").mapInArrow(_met, _MET), "blocks")
    info = met.where(F.col("kind") == _IS_INFO).select("doc", "row", "n", F.col("x").alias("class"))
    groups, total = _kept(met.where(F.col("kind") == _IS_GROUP).select(F.col("x").alias("block"), F.col("y").alias("class"), "n"), percent)
    some = groups.select("class").distinct()
    standing = info.where("n > 0").groupBy("class").agg(F.min(F.struct("doc", "row")).alias("of")).join(some, "class", "left_semi").select("class", "of.*")
    candidates = written(texts.join(standing, ["doc", "row"]).select("class", "text").dropDuplicates(["class"]), "candidates")
    return info, groups, total, candidates


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All verified links between classes of equal sets (a, b: each pair once), and each row's class (doc_id, row, n_shingles, class).

    Unlike linked(), this compares every pair of a group that the sketches allow: a group of m different near copies costs m * m / 2 comparisons.
    """
    info, groups, total, candidates = _prepared(docs, size, percent)
    per = written(groups.groupBy("block").agg(F.count("*").alias("n")), "block-sizes")
    open_ = written(_spread(groups.select("block", "class", F.col("class").alias("component")), per, total), "open")
    sketches = written(_sketches(candidates, size), "sketches")
    pairs = _across(_parts(open_, total).join(sketches, "class"), shards(docs.sparkSession), percent, True)
    rows = info.select(F.nullif(F.col("doc"), F.lit(_NULL)).alias("doc_id"), "row", F.col("n").alias("n_shingles"), "class")
    return written(_verified(pairs, candidates, size, percent), "links"), rows


def link_counts(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, row, n_shingles, class, n_links (other rows that it links with, copies among them)."""
    found, rows = links(docs, size, percent)
    rows = written(rows, "rows")
    copies = rows.groupBy("class").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = ends.join(copies.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    n_links = F.when(F.col("n") > 0, F.coalesce("others", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    per = written(copies.join(other, "class", "left").select("class", "copies", n_links.cast("long").alias("n_links")), "class-links")
    return _spread(rows, per, rows.count(), "class", "copies").select("doc_id", "row", "n_shingles", "class", "n_links")


def linked(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, row (a hash of its text), n_shingles, component_id, component (a hash that the rows of one share)."""
    n = shards(docs.sparkSession)
    info, groups, total, candidates = _prepared(docs, size, percent)
    pairs = groups.where("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"), F.lit(1).cast("long").alias("n"))
    of = written(components(_verified(_best(pairs), candidates, size, percent)), "components")
    sketches = all_ = None
    while True:
        # groups that are still open: their members are in several components
        now = written(groups.join(of.withColumnRenamed("node", "class"), "class", "left").select("block", "class", F.coalesce("component", "class").alias("component")), "now")
        per = now.groupBy("block").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
        per = written(per.where("least < most").select("block", "n"), "open-blocks")
        if per.isEmpty():
            break
        open_ = written(_spread(now, per, total), "open")
        groups = open_.select("block", "class")
        sketches = written(_sketches(candidates.join(groups.select("class").distinct(), "class", "left_semi"), size), "sketches") if sketches is None else sketches
        pairs = _across(_parts(open_, total).join(sketches, "class"), n, percent, bool(all_))
        more = written(_verified(pairs, candidates, size, percent), "links")
        none = more.isEmpty()
        if not none:
            stars = of.select(F.col("node").alias("a"), F.col("component").alias("b"))
            of = written(components(stars.unionByName(more)), "components")
        if all_:
            break
        all_ = none
    class_ = info.select("class", F.nullif(F.col("doc"), F.lit(_NULL)).alias("doc")).groupBy("class").agg(F.min("doc").alias("doc"), F.count("*").alias("docs"))
    class_ = written(class_.join(of.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "classes")
    least = class_.groupBy("component").agg(F.min("doc").alias("least"))
    of_class = written(class_.join(least, "component").select("class", "least", "component", "docs"), "of-classes")
    own = F.nullif(F.col("doc"), F.lit(_NULL))
    rows = _spread(info, of_class, info.count(), "class", "docs")
    return rows.select(own.alias("doc_id"), "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("component_id"), "component")


def keep_one(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id (null last), of these the one with the smallest hash of its text.

    Of rows that repeat (same doc_id and text) the first of a written table stays. Texts without words are no one's copies and all stay.
    Columns of any names are kept.
    """
    doc, row, copy, least = free(docs.columns, "doc", "row", "copy", "least")
    found = written(linked(docs, size, percent).where("n_shingles > 0"), "linked")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = found.where(first).groupBy("component").agg(F.min("row").alias("best"))
    same_id = found.where(first).join(best, "component").where("row <> best")
    gone = found.where(~first).select("doc_id", "row").unionByName(same_id.select("doc_id", "row")).distinct().toDF(doc, row)
    rows = docs.withColumns({row: row_key("text"), doc: F.col("doc_id")})
    kept = rows.join(gone, rows[doc].eqNullSafe(gone[doc]) & (rows[row] == gone[row]), "left_anti")
    again = found.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(doc), F.col("row").alias(row))
    again = written(again, "repeats")
    if again.isEmpty():
        return kept.select(*docs.columns)
    twice = lambda kind: kept.join(again, kept[doc].eqNullSafe(again[doc]) & (kept[row] == again[row]), kind)
    copies = written(twice("left_semi").withColumn(copy, F.monotonically_increasing_id()), "copies")
    firsts = copies.groupBy(doc, row).agg(F.min(copy).alias(least)).select(F.col(least).alias(copy))
    return twice("left_anti").select(*docs.columns).unionByName(copies.join(firsts, copy, "left_semi").select(*docs.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, hash(concat_ws(' ', word, lead(word) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d)) AS x FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, list_sort(list(DISTINCT x)) AS set FROM g WHERE i + 3 <= n OR i = 1 GROUP BY doc_id),
s AS MATERIALIZED (SELECT w.doc_id, coalesce(h.set, []) AS set FROM w LEFT JOIN h USING (doc_id)),
c AS MATERIALIZED (SELECT min(doc_id) AS doc_id, set, len(set) AS n FROM s WHERE len(set) > 0 GROUP BY set),
t AS MATERIALIZED (SELECT doc_id, n, unnest(set) AS x FROM c),
f AS (SELECT x, count(*) AS docs FROM t GROUP BY x HAVING count(*) > 1),
o AS (SELECT t.doc_id, t.n, t.x, f.docs, row_number() OVER (PARTITION BY t.doc_id ORDER BY coalesce(f.docs, 1), t.x) AS place FROM t LEFT JOIN f USING (x)),
q AS MATERIALIZED (SELECT doc_id, n, x FROM o WHERE docs > 1 AND place <= n - (85 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM q a JOIN q b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
links AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, x.n AS n, y.n AS m, len(list_intersect(x.set, y.set)) AS common FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b) WHERE 100 * common >= 85 * (n + m - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM c WHERE doc_id IN (SELECT a FROM edges) UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.set) AS BIGINT) AS n_shingles, coalesce(least.component, c.doc_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.set = s.set LEFT JOIN least ON least.a = c.doc_id
"""
