"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source is cut into shards and each shard, as one stream of its texts in a seeded order, into blocks of equally
many words.  Blocks are the seats: highest quotients (votes / (2 * seats + 1)) give every source an integer number of
blocks for its target, every group of a source's shards its part of these, and every shard its part of the group's.  A
shard with more seats than blocks takes all of them as often as that goes, and a seeded choice of its blocks for the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import words as W
from spindrift.llm.common import HEAVY_ROWS, all_but_text, forget, repeated, sliced, slices, utf8, written

BLOCK_WORDS = 64
#: Words and rows of a shard, about: what one task holds of the plan.
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 17
#: Groups that a source's shards are dealt to; the driver holds one number for each group, tasks those of its shards.
GROUPS = 1024
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def apportion(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Sainte-Lague: seats go one by one to the highest votes / (2 * seats so far + 1), ties to the earlier.

    Found by bisection on the quotient, so it takes a few steps per list, none per seat.  ``most`` closes a list at that many seats."""
    v = np.asarray(votes, float)
    cap = np.asarray(most if most is not None else [seats] * len(v), np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(v)
    won = lambda quotient: np.minimum(np.floor(np.minimum((v / quotient + 1) / 2, 2.0**52)).astype(np.int64), cap)
    low, high = v[v > 0].min() / (2.0 * seats + 3), v.max() * 2.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if won(mid).sum() >= seats else (low, mid)
    # bisection may be off by rounding: the last seats of each are given one by one
    out = np.maximum(won(high) - 2, 0).tolist()
    v, cap = v.tolist(), cap.tolist()
    next_up = [(-v[i] / (2 * n + 1), i) for i, n in enumerate(out) if n < cap[i]]
    heapq.heapify(next_up)
    for _ in range(seats - sum(out)):
        i = next_up[0][1]
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heapreplace(next_up, (-v[i] / (2 * out[i] + 1), i))
        else:
            heapq.heappop(next_up)
    return out


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above ``most`` times its size, the excess shared again by weight."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        n = [W.counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
        more = {c: batch[c] for c in batch.schema.names if c not in ("doc_id", "text", "source")}
        yield pa.record_batch({"doc_id": batch["doc_id"], "source": batch["source"], "size": pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()), **more})


def _chosen(seed: int, marks: list[str]):
    """Of one shard: for each text whole takes, chosen words, and where they lie in it."""

    def run(rows: pa.Table) -> pa.Table:
        quota = rows["quota"][0].as_py()
        rows = rows.sort_by([(c, "ascending") for c in ("place", "doc_id", "size", *marks)])
        size = rows["size"].to_numpy()
        end = np.cumsum(size)
        start, words = end - size, int(end[-1])
        blocks = -(-words // BLOCK_WORDS)
        rounds, rest = divmod(quota, blocks) if blocks else (0, 0)
        order = W.mix(np.arange(blocks, dtype=np.uint64) + W.mix(np.array([seed ^ (rows["shard"][0].as_py() << 20) ^ len(rows)], np.uint64)))
        taken = np.zeros(blocks, bool)
        taken[np.argsort(order, kind="stable")[:rest]] = True
        edges = np.arange(blocks + 1, dtype=np.int64) * words // max(blocks, 1)  # of equal size, to a word
        held = np.concatenate(([0], np.cumsum(np.where(taken, np.diff(edges), 0))))

        def upto(x: np.ndarray) -> np.ndarray:
            block = np.clip(np.searchsorted(edges, x, "right") - 1, 0, max(blocks - 1, 0))
            return held[block] + np.where(taken[block], x - edges[block], 0) if blocks else x * 0

        part = upto(end) - upto(start)
        spans = []
        for s, e, p in zip(start.tolist(), end.tolist(), part.tolist(), strict=True):
            own: list[int] = []
            if p:
                for k in range(int(np.searchsorted(edges, s, "right")) - 1, int(np.searchsorted(edges, e, "left"))):
                    if taken[k]:
                        a, b = max(s, int(edges[k])) - s, min(e, int(edges[k + 1])) - s
                        if own and own[-1] == a:
                            own[-1] = b
                        else:
                            own += [a, b]
            spans.append(own)
        passed = {c: rows[c] for c in ("doc_id", "source", "size", "source_size", "target", "copies")}
        made = {"taken": pa.array(rounds * size + part), "rounds": pa.array([rounds] * len(rows), pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))}
        return pa.table({**passed, **made, **{c: rows[c] for c in marks}})

    return run


def _shard_quotas(most: int):
    """Of one group: its seats apportioned to its shards."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        blocks = rows["blocks"].to_pylist()
        quota = apportion(blocks, rows["seats"][0].as_py(), [most * n for n in blocks])
        return pa.table({"_source": rows["source"], "_shard": rows["shard"], "quota": pa.array(quota, pa.int64())})

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, rounds, spans) for each row of ``docs`` (doc_id, text, source).

    size counts words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources, in code point order with null last, have the
    weights in turn; a source's target is its share of all words, at most ``most`` times its own.  taken is the number of
    words that the mix takes: ``rounds`` times the whole text and the words of ``spans`` (start, end, ...).  The choice
    depends on seed and rows alone, so reruns agree; ids pass as they are, null and repeated ones too.  A source has as many
    shards as its words and rows need; the driver holds one number a source and GROUPS more for each.  Sources without words
    have target 0 and keep their place in the order of weights.  Of columns other than these three only digests are taken.
    """
    return _plan(docs, weights, most, seed).drop("copies", *MARKS)


#: 128 bits of a whole row.
MARKS = ("_mark_a", "_mark_b")


def _marked(docs: DataFrame) -> DataFrame:
    # maps have no hash, so what stands beside the text is hashed as it is written
    beside = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    return docs.withColumns({"_mark_a": F.xxhash64("text", beside), "_mark_b": F.xxhash64(F.lit(1), F.col("text"), beside)})


def _plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """mix, with MARKS and copies, the number of rows that are equal in them.  Such rows are counted, numbered from their
    count and placed by their number, so they lie in many shards."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = "".join(f", {c} long" for c in MARKS)
    sized = written(_marked(docs).select("doc_id", "text", "source", *MARKS).mapInArrow(_sizes, f"doc_id {kind}, source string, size long{marked}"), "sizes")
    alike = sized.groupBy("doc_id", "source", "size", *MARKS).agg(F.count("*").alias("copies"))
    place = F.xxhash64(F.lit(seed), *MARKS, "nth")
    sized, read = written(repeated(alike, "copies", "nth").withColumn("place", place).drop("nth"), "numbered"), sized
    forget(read)
    totals = sorted(((s, int(n), int(rows)) for s, n, rows in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    own = [weights[i % len(weights)] for i in range(len(totals))]
    goal = targets([n for _, n, _ in totals], own, most)
    shards = [max(1, -(-n // SHARD_WORDS), -(-rows // SHARD_ROWS)) for _, n, rows in totals]
    plan = spark.createDataFrame([(s, n, t, k) for (s, n, _), t, k in zip(totals, goal, shards, strict=True)], "_source string, source_size long, target double, shards long")
    key = F.col("source").eqNullSafe(F.col("_source"))
    dealt = sized.join(plan, key).drop("_source").withColumn("shard", F.pmod(F.shiftrightunsigned("place", 8), F.col("shards"))).drop("shards")
    per_shard = dealt.groupBy("source", "shard").agg(F.floor((F.sum("size") + (BLOCK_WORDS - 1)) / BLOCK_WORDS).alias("blocks"))
    per_shard = written(per_shard.withColumn("group", F.pmod("shard", F.lit(GROUPS))), "shards")
    groups: dict = {}
    for s, group, n in per_shard.groupBy("source", "group").agg(F.sum("blocks")).collect():
        groups.setdefault(s, []).append((group, int(n)))
    blocks = {s: sum(n for _, n in own) for s, own in groups.items()}
    wanted = [t * blocks[s] / n if n else 0.0 for (s, n, _), t in zip(totals, goal, strict=True)]
    seats = apportion(wanted, round(sum(wanted)), [most * blocks[s] for s, _, _ in totals])
    of_groups = []
    for (s, _, _), n in zip(totals, seats, strict=True):
        own = sorted(groups[s])
        of_groups += [(s, k, q) for (k, _), q in zip(own, apportion([m for _, m in own], n, [most * m for _, m in own]), strict=True)]
    of_groups = spark.createDataFrame(of_groups, "_source string, _group long, seats long")
    quotas = per_shard.join(of_groups, key & (F.col("group") == F.col("_group"))).drop("_source", "_group")
    quotas = quotas.groupBy("source", "group").applyInArrow(_shard_quotas(most), "_source string, _shard long, quota long")
    dealt = dealt.join(quotas, key & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    return dealt.groupBy("source", "shard").applyInArrow(_chosen(seed, list(MARKS)), f"doc_id {kind}, source string, size long, source_size long, target double, copies long, taken long, rounds long, spans array<long>{marked}")


_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a text is taken whole, and one with the
    chosen stretches of words, joined by a line end, where a part is taken; n_chars, if there, is of the new text.

    Each row takes what mix plans for it, also where its doc_id is null or repeated; rows that the mix does not take go.
    Plans and rows meet by 128 bits of the whole row.  Rows that are equal in these are alike, so one stands for all of
    them, as several rows where they are many.
    """
    names = docs.columns
    marked = _marked(docs)
    plan = written(_plan(docs, **how).select(*MARKS, "taken", F.col("copies").alias("_copies"), F.col("rounds").alias("_rounds"), F.col("spans").alias("_spans")), "plan")
    several = plan.where("_copies > 1")
    repeats = not several.isEmpty()
    plan = plan.where("taken > 0").drop("taken")
    parts = F.floor((F.col("_copies") - 1) / HEAVY_ROWS) + 1
    if repeats:
        of_key = several.groupBy(*MARKS).agg(F.max("_copies").alias("_copies"))
        marked = marked.dropDuplicates(list(MARKS)).join(of_key, list(MARKS), "left")
        marked = marked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)) - 1))).drop("_copies")
        plan = plan.withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts))
    rows = marked.join(plan.drop("_copies"), [*MARKS, "_part"] if repeats else list(MARKS))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rounds")))).where("_copy < _rounds or size(_spans) > 0")
    row = all_but_text(names)
    kind = rows.select(row.alias("row")).schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for text, spans, copy, rounds in zip(batch["text"], batch["_spans"], batch["_copy"].to_pylist(), batch["_rounds"].to_pylist(), strict=True):
                own = text.as_py()
                if copy == rounds:
                    at, span = [m.span() for m in _WORD.finditer(own or "")], spans.as_py()
                    own = "\n".join(own[at[s][0] : at[e - 1][1]] for s, e in zip(span[0::2], span[1::2], strict=True))
                texts.append(own)
            yield pa.record_batch({"row": batch["row"], "text": pa.array(texts, pa.string())})

    packed = rows.select(row.alias("row"), "text", "_spans", "_copy", "_rounds")
    out = packed.mapInArrow(cut, f"row {kind}, text string")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*((new[c] if new.get(c) is not None else F.col("row").getField(c)).alias(c) for c in names))
