"""N-gram Jaccard join by set-relation skipping.

Every text is the set of its distinct word n-grams.  Sets are put in one global order, rare grams first, and only a
prefix of each set is indexed: two sets of similarity t share a gram within both prefixes.  The index lists are then
read with two kinds of skipping:

* By position: a list is sorted by set size and by the gram's position in the set, and sets of one size and position
  are a block.  For a set, only blocks of sizes within t and 1 / t of its own can hold a partner, and of each size only
  the blocks up to a position that follows from the two sizes.  So what is read of a list is one run for each size, found
  by binary search; all other blocks are skipped unread.  No pair is filtered afterwards.
* By answers: where a list has more possible pairs than a few for each set, as lists of many near copies have, its sets
  are first compared with a few of them, the leaders.  The answers of all others follow from these: sets of one
  component are done, whatever they share; of a set's overlap with its reference R, |X & R| + |Y & R| - |R| bounds
  |X & Y| from below and min(|X & R|, |Y & R|) + min(|X - R|, |Y - R|) from above, so pairs are links or not without
  reading a set.  Only sets outside a list's largest component are read again, against what is left, a few partners at
  first and, when components have grown, all.

The order comes from a count sketch of fixed size over all grams of all texts.  Any common order gives the same
links; the sketch only decides how long the lists get.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import words as W
from spindrift.llm.common import forget, lists, slices, utf8, written
from spindrift.llm.components import components
from spindrift.llm.index_lists import changes, first_pairs, open_pairs

SKETCH_BITS = 22
BLOCK_BITS = 18
#: A list with up to so many possible pairs for each of its sets gives them all at once.
DENSE = 4
#: Leaders that the sets of another list are first compared with, of each class of sizes.
LEADERS = 2
#: Leaders that the sets outside its list's largest component are compared with in each turn; after these turns, all.
TURNS = (8, 64)
#: Entries that a reader holds at a time, and entries of a list that are compared with others in one task.
HELD = 1 << 17
PART = 1 << 11
#: Partners of one set that one task compares.
PARTNERS = 4096
U = np.uint64


def grams(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, starts of the rows in them): all n-grams of a column, slice by slice, repeats included."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        body = data[offsets[lo] : offsets[hi]]
        starts, ends, at = W.bounds(body, own)
        hashed = W.hashes(body, starts, ends, fold=True)
        per = np.diff(at)
        whole = W.windows(hashed, width)
        keep = np.zeros(len(hashed), bool)
        full = per >= width
        # a window may start at all but the last width - 1 words of a row
        edge = np.zeros(len(hashed) + 1, np.int64)
        np.add.at(edge, at[:-1][full], 1)
        np.add.at(edge, at[1:][full] - width + 1, -1)
        keep = np.cumsum(edge[:-1]) > 0
        sizes = np.where(full, per - width + 1, np.minimum(per, 1))
        out_at = np.zeros(len(per) + 1, np.int64)
        np.cumsum(sizes, out=out_at[1:])
        out = np.zeros(out_at[-1], np.uint64)
        longer = np.repeat(full, sizes)
        out[longer] = whole[np.flatnonzero(keep)]
        for row in np.flatnonzero(~full & (per > 0)):  # fewer words than a gram: the whole sequence
            out[out_at[row]] = W.windows(hashed[at[row] : at[row + 1]], int(per[row]), 1)[0]
        yield lo, out, out_at


def sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct grams)."""
    for first, out, at in grams(column, width):
        for row in range(len(at) - 1):
            one = np.sort(out[at[row] : at[row + 1]])
            yield first + row, one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, waiting, any_rows = np.zeros(1 << SKETCH_BITS, np.int64), [], False

        def add() -> None:
            nonlocal counters
            if waiting:
                counters += np.bincount(np.concatenate(waiting), minlength=1 << SKETCH_BITS)
                waiting.clear()

        for batch in batches:
            for _, out, _ in grams(batch["text"], width):
                any_rows = True
                waiting.append((out & U((1 << SKETCH_BITS) - 1)).astype(np.int64))
                if sum(map(len, waiting)) > 1 << 20:
                    add()
        add()
        if any_rows:
            blocks = np.minimum(counters, 2**32 - 1).astype(np.uint32).reshape(-1, 1 << BLOCK_BITS)
            yield pa.record_batch({"block": pa.array(range(len(blocks)), pa.int32()), "counters": pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())})

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counters in zip(batch["block"].to_pylist(), batch["counters"], strict=True):
            own = np.frombuffer(zlib.decompress(counters.as_py()), np.uint32)
            total[block] = total.get(block, 0) + own.astype(np.int64)
    if total:
        quantised = [np.minimum(np.log2(total[b] + 1.0) * 4, 255).astype(np.uint8).tobytes() for b in sorted(total)]
        yield pa.record_batch({"block": pa.array(sorted(total), pa.int32()), "counters": pa.array(quantised, pa.binary())})


def gram_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """Quarter-octave counts of all grams in 2**SKETCH_BITS slots: 4 MB, whatever the input."""
    parts = docs.select("text").mapInArrow(_count(width), "block int, counters binary")
    parts = parts.repartition("block").mapInArrow(_add_up, "block int, counters binary").collect()
    ranks = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for block, counters in parts:
        ranks[block] = np.frombuffer(bytes(counters), np.uint8)
    return ranks.ravel()


def _prefixes(width: int, percent: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(ranks.value, np.uint8)
        for batch in batches:
            n, hi, lo = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            heads, lengths = [], np.zeros(batch.num_rows, np.int64)
            for row, own in sets(batch["text"], width):
                n[row] = len(own)
                if not len(own):
                    continue
                hi[row], lo[row] = W.mix(own).sum(dtype=np.uint64), W.mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                by = np.argsort(order[(own & U((1 << SKETCH_BITS) - 1)).astype(np.int64)], kind="stable")
                head = own[by[: len(own) - -(-percent * len(own) // 100) + 1]]
                heads.append(head)
                lengths[row] = len(head)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "n": pa.array(n), "hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)), "head": lists(flat.view(np.int64), lengths, pa.int64())})

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hi, lo, n, doc): each with the first of its equals in this task, and the set's head on that only.

    The firsts of a task's first and last class come once more as border rows, as others of the class may be elsewhere."""
    keys = ("hi", "lo", "n")
    held: tuple | None = None  # key and first of the class that may go on
    borders: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {k: batch[k].to_numpy() for k in (*keys, "doc")}
        start = changes(*(cols[k] for k in keys))
        same = held is not None and held[:3] == tuple(cols[k][0] for k in keys)
        first = np.repeat(cols["doc"][start], np.diff(np.append(start, batch.num_rows)))
        head = np.ones(batch.num_rows, bool)
        head[start] = False
        if same:
            first[: start[1] if len(start) > 1 else None] = held[3]
            head[0] = True
        held = (*(cols[k][-1] for k in keys), first[-1])
        if not borders:
            borders.append((*(cols[k][0] for k in keys), first[0]))
        yield pa.record_batch({**{k: batch[k] for k in (*keys, "doc")}, "first": pa.array(first), "border": pa.array(np.zeros(len(head), bool)), "head": pc.if_else(pa.array(head), pa.scalar(None, batch["head"].type), batch["head"])})
    if held is not None:
        borders = list(dict.fromkeys([*borders, held]))
        cols = [pa.array(list(c), pa.int64()) for c in zip(*borders, strict=True)]
        n = len(borders)
        yield pa.record_batch([*cols, cols[3], pa.array([True] * n), pa.nulls(n, pa.list_(pa.int64()))], names=[*keys, "doc", "first", "border", "head"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Columns of sorted rows, about HELD at a time, cut between groups of equal keys; whether the first group may have
    begun before these rows of the task, and whether the last may go on.  Only a group beyond HELD is cut."""
    parts: list[dict[str, np.ndarray]] = []
    size, open_before = 0, True

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([p[k] for p in parts]) for k in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append({k: batch[k].to_numpy(zero_copy_only=False) for k in names})
        size += batch.num_rows
        if size >= HELD:
            rows = joined()
            cut = int(changes(*(rows[k] for k in keys))[-1])
            if cut:
                yield {k: v[:cut] for k, v in rows.items()}, open_before, False
                parts, size, open_before = [{k: v[cut:] for k, v in rows.items()}], size - cut, False
            else:
                yield rows, True, True
                parts, size, open_before = [], 0, True
    if size:
        yield joined(), open_before, True


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """A running number for each group of equal rows."""
    first = changes(*columns)
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, len(columns[0]))))


_READ = "token long, a long, b long, n long, pos long"


def _read_lists(percent: int):
    """Reads index lists sorted by gram, set size and position: pairs (a, b) to compare, and entries (token, a, n, pos) of the
    lists that go on.  A list that may go on in another task does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, before, after in _groups(batches, ("token",), ("token", "n", "pos", "doc")):
            rows["of"] = _numbers(rows["token"])
            border = [*([0] if before else []), *([int(rows["of"][-1])] if after else [])]
            pairs, more = first_pairs(rows, np.array(border, np.int64), percent, DENSE, LEADERS)
            for x, y in pairs:
                none = pa.nulls(len(x), pa.int64())
                yield pa.record_batch([none, pa.array(rows["doc"][x]), pa.array(rows["doc"][y]), none, none], names=["token", "a", "b", "n", "pos"])
            if more.any():
                yield pa.record_batch([pa.array(rows["token"][more]), pa.array(rows["doc"][more]), pa.nulls(int(more.sum()), pa.int64()), pa.array(rows["n"][more]), pa.array(rows["pos"][more])], names=["token", "a", "b", "n", "pos"])

    return run


def _read_open(percent: int, leading: int | None, seed: int):
    """Reads what is open of lists sorted by (token, p, q), size and position: pairs that are links (sure), or to compare."""
    names = ("token", "p", "q", "n", "pos", "doc", "component", "major", "visitor", "ref", "n_ref", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in _groups(batches, ("token", "p", "q"), names):
            rows["of"] = _numbers(rows["token"], rows["p"], rows["q"])
            pairs, more = open_pairs(rows, percent, DENSE, leading, seed)
            for x, y, sure in pairs:
                yield pa.record_batch({"a": pa.array(rows["doc"][x]), "b": pa.array(rows["doc"][y]), "sure": pa.array(sure), "more": pa.array(np.zeros(len(x), bool))})
            if more:
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([False]), pa.array([True])], names=["a", "b", "sure", "more"])

    return run


def _wanted(bitmap):
    """Passes on the rows whose slot is in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch["slot"].to_numpy(zero_copy_only=False) - 1]))
            yield pa.record_batch({"doc": batch["doc_id"].cast(pa.int64()), "text": batch["text"]})

    return run


WANTED_BITS = 23


def _slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << WANTED_BITS)) + 1


def _overlaps(width: int):
    """Rows of (a, salt), the texts of a first (more than one if its doc_id is repeated), then its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            a, salt, b = (batch[k].to_pylist() for k in ("a", "salt", "b"))
            out: list[tuple[int, int, int, int, int]] = []
            for i, own in sets(batch["text"], width):
                if b[i] is None:
                    if key != (a[i], salt[i]):
                        key, held = (a[i], salt[i]), []
                    if not any(np.array_equal(own, h) for h in held):
                        held.append(own)
                elif key == (a[i], salt[i]):
                    for h in held:
                        at_held = np.searchsorted(h, own)
                        at_held[at_held == len(h)] = 0
                        out.append((a[i], b[i], len(h), len(own), int((h[at_held] == own).sum()) if len(h) else 0))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n_a", "n_b", "shared"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, n_a, n_b, shared): for distinct pairs the sizes of the sets and of the intersection.

    Only texts in a pair are dealt out: a bitmap of fixed size first passes over the others, then a join is exact.  Each
    partner's text, which is smaller than its set, goes to the text that it is paired with; one with many partners is
    salted."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).select(_slot("doc").alias("s"))
    bitmap = ids.groupBy(F.expr("bitmap_bucket_number(s)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits")).collect()
    bits = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for k, own in bitmap:  # bucket k holds one bit for each of the slots 32768 * (k - 1) + 1 to 32768 * k
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(own), np.uint8)
    wanted = spark.sparkContext.broadcast(bits.tobytes())
    whole = docs.where("doc_id is not null").select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(_wanted(wanted), "doc long, text string")
    salts = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / PARTNERS) + 1).alias("salts"))
    left = whole.join(salts.withColumnRenamed("a", "doc"), "doc").select(F.col("doc").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b").join(whole, F.col("b") == F.col("doc")).select("a", "salt", "b", "text")
    rows = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_overlaps(width), "a long, b long, n_a long, n_b long, shared long")


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select("b", "a"))


def _distinct(pairs: DataFrame) -> DataFrame:
    """Each pair once, the set of smaller hash first: leaders have small ones, so their partners come to them."""
    ahead = F.xxhash64("a") <= F.xxhash64("b")
    return pairs.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def _references(tested: DataFrame, percent: int) -> DataFrame:
    """(doc, ref, n_ref, shared): of the sets that each was compared with, one that is rather similar and of smallest hash,
    so that the sets of a group mostly have the same.  Pairs with a repeated doc_id, which have several rows, are left out."""
    sole = tested.groupBy("a", "b").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n_a", "n_b", "shared"))).where("rows = 1")
    both = sole.select(F.col("a").alias("doc"), F.col("b").alias("ref"), F.col("n_b").alias("n_ref"), "shared", F.col("n_a").alias("n"))
    both = both.union(sole.select("b", "a", "n_a", "shared", "n_b"))
    rank = F.struct(F.expr(f"shared * {200 + percent} < {percent} * (n + n_ref)"), F.xxhash64("ref", F.lit(0)))
    return both.groupBy("doc").agg(F.min_by(F.struct("ref", "n_ref", "shared"), rank).alias("r")).select("doc", "r.ref", "r.n_ref", "r.shared")


def _dealt(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """Entries of lists of several components, dealt to cells (token, p, q): a home to its part p, and to each part q of the
    visitors; a set outside the major component also as a visitor to each part of the homes."""
    rows = members.join(mixed, "token")
    home = lambda q: F.struct(F.pmod(F.xxhash64("doc"), F.col("homes")).alias("p"), q.alias("q"), F.lit(False).alias("visitor"))
    guest = lambda p: F.struct(p.alias("p"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("guests")).alias("q"), F.lit(True).alias("visitor"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cells = F.when(F.col("component") == F.col("major"), F.transform(upto("guests"), home)).otherwise(F.concat(F.transform(upto("guests"), home), F.transform(upto("homes"), guest)))
    return rows.withColumn("cell", F.explode(cells)).select("token", "cell.p", "cell.q", "n", "pos", "doc", "component", "major", "cell.visitor", "ref", "n_ref", "shared")


def link_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text, anything more).

    Two documents link when their sets of distinct ``width``-word n-grams (A-Z lower-cased; the whole sequence where
    there are fewer words) have 100 * |intersection| >= percent * |union|; component_id is the smallest doc_id
    reachable.  A null or empty text has no gram and links with nothing.  A null doc_id links with nothing and keeps
    component_id null.  Rows that repeat a doc_id count as one node and come out as often as they came in.  Other
    columns are not read.

    Copies and index lists are dealt by range, so one class or list of very many sets is read by several tasks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranks = spark.sparkContext.broadcast(gram_ranks(docs, width).tobytes())
    own = written(docs.mapInArrow(_prefixes(width, percent, ranks), "doc_id long, n long, hi long, lo long, head array<long>"), "sets")
    # equal sets: each task links its rows of a class to the first of them, and the firsts of classes that tasks share meet
    by = ("hi", "lo", "n", "doc")
    usable = own.where("n > 0 and doc_id is not null").select("hi", "lo", "n", F.col("doc_id").alias("doc"), "head")
    firsts = written(usable.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_firsts, "hi long, lo long, n long, doc long, first long, border boolean, head array<long>"), "classes")
    shared_firsts = firsts.where("border").groupBy("hi", "lo", "n").agg(F.min("doc").alias("b"), F.collect_set("doc").alias("firsts"))
    copies = firsts.where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")).union(shared_firsts.select(F.explode("firsts").alias("a"), "b"))

    index = firsts.where("head is not null").select(F.posexplode("head").alias("pos", "token"), "doc", "n").select("token", "n", F.col("pos").cast("long").alias("pos"), "doc")
    order = ("token", "n", "pos", "doc")
    found = written(index.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_read_lists(percent), _READ), "lists")
    tested = written(_verified(docs, written(_distinct(found.where("b is not null")), "pairs"), width), "overlaps")
    enough = f"shared * {100 + percent} >= {percent} * (n_a + n_b)"
    at = components(tested.where(enough).select("a", "b"))

    open_lists = found.where("b is null").select("token", "n", "pos", F.col("a").alias("doc"))
    for turn, leading in enumerate((*TURNS, None), 1):
        about = at.withColumnRenamed("node", "doc").join(_references(tested, percent), "doc", "full")
        members = open_lists.join(about, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        # a set that was compared with nothing is its own reference
        members = members.withColumns({"n_ref": F.coalesce("n_ref", "n"), "shared": F.coalesce("shared", "n"), "ref": F.coalesce("ref", "doc")})
        members = written(members.select("token", "n", "pos", "doc", "component", "ref", "n_ref", "shared"), "members")
        mixed = members.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("major")).where("most < m")
        parts = lambda n: F.floor((F.col(n) - 1) / PART) + 1
        mixed = written(mixed.withColumn("rest", F.expr("m - most")).select("token", "major", parts("m").alias("homes"), parts("rest").alias("guests")), "mixed")
        if mixed.isEmpty():
            break
        dealt = _dealt(members, mixed).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "n", "pos", "doc")
        met = written(dealt.mapInArrow(_read_open(percent, leading, turn), "a long, b long, sure boolean, more boolean"), "open")
        more = met.where("not sure and a is not null").select("a", "b").join(_either_way(tested), ["a", "b"], "left_anti")
        fresh = written(_verified(docs, written(_distinct(more), "pairs"), width), "overlaps")
        new = met.where("sure").select("a", "b").union(fresh.where(enough).select("a", "b"))
        tested = tested.unionByName(fresh)
        at = components(at.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))
        done = met.where("more").isEmpty()
        forget(met)
        if done:
            break
        open_lists = members.join(mixed.select("token"), "token", "left_semi").select("token", "n", "pos", "doc")
    final = components(at.select(F.col("node").alias("a"), F.col("component").alias("b")).union(copies))
    return own.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest: one document of each near-duplicate group.

    Rows with a null doc_id stay; of rows that repeat a kept doc_id one stays, that of smallest text hash."""
    keep = link_components(docs, width, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, F.col("doc_id") == F.col("_keep"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
