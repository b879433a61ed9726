"""Mixing sources to target weights by proportionate-fair scheduling.

Every source owes the mix a share of its tokens. The mix is laid out in quanta of equal size, eight to a block; the
j-th quantum of a source with weight w may start at slot j / w and is due by slot (j + 1) / w. Serving the earliest
deadline among the released quanta gives every slot to one source and keeps each source within one quantum of its
share. Documents stay whole: each goes to the slot of its middle, so a long one lags by half its length before it and
leads by half after it, and the slots it covers stay empty. With weights as whole parts of a period the schedule
repeats, so one period is computed and every quantum finds its slot by arithmetic: nothing in it depends on the size
of the corpus.
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.session import cut


def whole_parts(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts of the period, by largest remainder; positive weights keep at least one part. Parts are reduced by their common divisor."""
    if not any(w > 0 for w in weights.values()):
        return {}
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items() if w > 0}
    parts = {s: max(1, int(x + 1e-9)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (parts[s] - exact[s], s))
    i = 0
    while sum(parts.values()) < period:
        parts[order[i % len(order)]] += 1
        i += 1
    while sum(parts.values()) > period:
        most = max(parts, key=lambda s: (parts[s] - exact[s], parts[s], s))
        parts[most] -= 1
    d = gcd(*parts.values())
    return {s: n // d for s, n in parts.items()}


def schedule(parts: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks, ties by name.

    Block j of a source with n of D parts is released at floor(j D / n) and due at ceil((j + 1) D / n).
    """
    size = sum(parts.values())
    release = [(j * size // n, -(-(j + 1) * size // n), s) for s, n in parts.items() for j in range(n)]
    release.sort()
    ready: list[tuple[int, str]] = []
    out, i = [], 0
    for slot in range(size):
        while i < len(release) and release[i][0] <= slot:
            heapq.heappush(ready, release[i][1:])
            i += 1
        out.append(heapq.heappop(ready)[1])
    return out


def capacity(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[dict[str, float], float]:
    """(weights that can be met, tokens of the largest mix). Sources without tokens cannot be met: their weight goes to the others in proportion."""
    usable = {s: (w, r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and sizes.get(s, 0) > 0}
    total = sum(w for w, _ in usable.values())
    weights = {s: w / total for s, (w, _) in usable.items()}
    return weights, min((sizes[s] * r / weights[s] for s, (_, r) in usable.items()), default=0.0)


def running_starts(docs: DataFrame, per_bucket: int = 2_000_000, span: int = 4096) -> DataFrame:
    """docs (source, h, id, tokens, total) with `start`: the tokens of the source before each document, by order of (h, id).

    Sums run within buckets by hash of about per_bucket tokens, over the buckets of a span, and over spans, so that
    no window sees more than a bucket's documents or `span` lines of sums until a source has span squared buckets.
    """
    buckets = F.greatest(F.lit(1), F.expr(f"total div {per_bucket}"))
    # buckets are ranges of the order's hash, so that the order runs through them
    at = F.floor(F.shiftrightunsigned("h", 11).cast("double") / 2.0**53 * buckets).cast("long")
    d = docs.withColumn("bucket", F.least(at, buckets - 1)).withColumn("span", F.expr(f"bucket div {span}"))
    sums = d.groupBy("source", "span", "bucket").agg(F.sum("tokens").alias("n"))
    spans = sums.groupBy("source", "span").agg(F.sum("n").alias("n"))
    before = lambda w: F.sum("n").over(w) - F.col("n")
    spans = spans.select("source", "span", before(Window.partitionBy("source").orderBy("span")).alias("_s"))
    offsets = sums.select("source", "span", "bucket", before(Window.partitionBy("source", "span").orderBy("bucket")).alias("_b")).join(spans, ["source", "span"])
    inside = Window.partitionBy("source", "span", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "span", "bucket"])
    return d.withColumn("start", F.col("_s") + F.col("_b") + F.col("_in")).drop("span", "bucket", "_s", "_b", "_in")


def mix(docs: DataFrame, targets: DataFrame, block: int = 2048, period: int = 10_000, per_bucket: int = 2_000_000, seed: int = 7, fills: int = 6) -> DataFrame:
    """(position, slot, source, id, repeat, tokens): the order of the mix; repeat counts from 0.

    docs: id, source, tokens; targets: source, target_share, max_repeats, a small table of named sources. The mix
    is as long as the caps allow: the scarcest source, repeated max_repeats times, sets its length. Documents go
    whole, in an order of their hashes that is the same on every run; a source repeats only when all its documents
    have been used. A document that would pass the share of its source gives way: what is missing is filled, in at
    most `fills` rounds, with the longest unused document that fits. Sources without a target, null sources,
    documents without tokens and targets without documents take no part; of targets named twice the first by order
    counts. position is (slot, place in the slot) as one number: it grows along the mix, with gaps. Running tokens of
    a source stay within a block of its share of all so far, while documents are no longer than half a block; a
    longer one adds half its length around its place.

    Only one line per source and round and one per span of buckets reach the driver or a single task.
    """
    spark = docs.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).collect()
    goals = {r.source: (r.t.target_share, r.t.max_repeats) for r in wanted}
    docs = docs.where(F.col("source").isin(*goals) if goals else F.lit(False)).where("tokens > 0").select("id", "source", F.col("tokens").cast("long"))
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    weights, length = capacity(sizes, goals)
    parts = whole_parts(weights, period)
    size, quantum = sum(parts.values()), max(1, block // 8)
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for i, s in enumerate(schedule(parts)):
        slots[s].append(i)
    plan = [(s, sizes[s], int(weights[s] * length + 1e-6), int(goals[s][1]), parts[s], slots[s]) for s in sorted(parts)]
    plan = spark.createDataFrame(plan, "source string, total long, quota long, most int, n int, slots array<int>")
    # the plan has one line per named source, of at most `period` numbers in all
    d = docs.join(F.broadcast(plan.drop("n", "slots")), "source").withColumn("h", F.xxhash64(F.col("id"), F.lit(seed)))
    # pass k of the source starts at k times its total; a document goes in as long as it ends within the quota
    times = F.least(F.floor((F.col("quota") - F.col("start") - F.col("tokens")) / F.col("total")) + 1, F.col("most"))
    d = cut(running_starts(d, per_bucket).withColumn("times", F.greatest(times, F.lit(0))), "mix")
    have = {r.source: r.n for r in d.groupBy("source").agg(F.sum(F.col("times") * F.col("tokens")).alias("n")).collect()}
    quota = {s: int(weights[s] * length + 1e-6) for s in parts}
    extra: list[tuple] = []
    for _ in range(fills):
        gaps = [(s, quota[s] - have[s]) for s in have if quota[s] > have[s]]
        if not gaps:
            break
        gap = F.create_map(*(F.lit(x) for g in gaps for x in g))
        used = [(s, i, 1) for s, i, *_ in extra]
        spare = d.where((F.col("times") < F.col("most")) & (F.col("tokens") <= F.try_element_at(gap, F.col("source"))))
        if used:
            kind = docs.schema["id"].dataType.simpleString()
            spare = spare.join(F.broadcast(spark.createDataFrame(used, f"source string, id {kind}, one int").groupBy("source", "id").agg(F.sum("one").alias("more"))), ["source", "id"], "left")
            spare = spare.where(F.col("times") + F.coalesce("more", F.lit(0)) < F.col("most")).withColumn("times", F.col("times") + F.coalesce("more", F.lit(0)))
        best = spare.groupBy("source").agg(F.max(F.struct("tokens", (-F.col("times")).alias("t"), "h", "id")).alias("b")).collect()
        if not best:
            break
        for r in best:
            extra.append((r.source, r.b.id, int(-r.b.t), have[r.source], r.b.tokens))
            have[r.source] += r.b.tokens
    d = d.where("times > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("times") - 1).cast("long"))))
    d = d.select("source", "id", F.col("repeat").cast("int").alias("repeat"), (F.col("start") + F.col("repeat") * F.col("total")).alias("at"), "tokens")
    if extra:
        more = spark.createDataFrame(extra, f"source string, id {docs.schema['id'].dataType.simpleString()}, repeat int, at long, tokens long")
        d = d.unionByName(more)
    d = d.join(F.broadcast(plan.select("source", "n", "slots")), "source").withColumn("middle", F.col("at") + F.expr("tokens div 2"))
    j = F.floor(F.col("middle") / quantum)
    slot = F.floor(j / F.col("n")) * size + F.element_at("slots", (F.pmod(j, F.col("n")) + 1).cast("int"))
    d = d.withColumn("slot", slot.cast("long"))
    return d.select((F.col("slot") * quantum + F.col("middle") % quantum).alias("position"), "slot", "source", "id", "repeat", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, docs, share, most): what each target source has of the mix, and how often one of its documents occurs at most."""
    each = mixed.groupBy("source", "id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("times"))
    by = each.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("times").alias("docs"), F.max("times").alias("most"))
    goals = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    out = goals.select("source", "t.target_share").join(by, "source", "left").fillna(0, ["tokens", "docs", "most"])
    total = F.sum("tokens").over(Window.partitionBy())
    return out.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
