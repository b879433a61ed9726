"""One surviving record per content: which records are of one content, which survives, and the best value of each field.

Values are chosen by iterative truth discovery: the reliability of each source and the support of each claimed
value are estimated by turns until they settle; the value with the highest support wins its field.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.lets import let
from darkslide.session import cut

_SPACE = r"[\s\u00a0\u200b\ufeff]"


def blank(c: F.Column) -> F.Column:
    """True for null, empty and blank texts."""
    return F.coalesce(F.rlike(c, F.lit(f"^{_SPACE}*$")), F.lit(True))


def hex_digits(sha: F.Column) -> F.Column:
    """The hex digits of a hash, however written: lower case, without prefix, blanks and separators; null if that is not 8 to 64 hex digits."""
    # nearly all hashes are written plainly, and pass by one test
    plain = (F.length(sha) == 64) & F.rlike(sha, F.lit("^[0-9a-f]{64}$"))
    s = F.regexp_replace(F.lower(sha), rf"^{_SPACE}*(?:sha-?256)?[:=]?|[\s:\-]+|(?<=^0)x", "")
    s = F.regexp_replace(s, "^0x", "")
    return F.when(plain, sha).when(sha.isNotNull() & (sha != ""), let(s, lambda h: F.when(F.rlike(h, F.lit("^[0-9a-f]{8,64}$")), h)))


def contents(records: DataFrame, shortest: int = 8) -> DataFrame:
    """records with one column more, `content`: the full hash, or null where it cannot be told.

    records: rec_id, id, sha, any others. A full hash stands for itself. A shortened hash stands for the one full
    hash of the table that begins with it; where several do, the one that the record's id has elsewhere, else
    none. A record without a hash has the one hash that its id has elsewhere; an id with several hashes tells
    none. Hot hashes and ids cost nothing: what is joined are distinct hashes and distinct ids.
    """
    r = records.withColumn("_hex", hex_digits(F.col("sha")))
    full = F.length("_hex") == 64
    hashes = r.where(full).select(F.col("_hex").alias("_full")).distinct().withColumn("_head", F.substring("_full", 1, shortest))
    short = r.where(F.col("_hex").isNotNull() & ~full).select("_hex").distinct().withColumn("_head", F.substring("_hex", 1, shortest))
    long = short.join(hashes, "_head").where(F.startswith(F.col("_full"), F.col("_hex"))).groupBy("_hex").agg(F.collect_set("_full").alias("_fulls"))
    told = r.where(F.col("_hex").isNotNull()).select("id", "_hex").where("id is not null").distinct()
    of_id = told.where(F.length("_hex") == 64).select("id", F.col("_hex").alias("_full"))
    one = long.where(F.size("_fulls") == 1).select("_hex", F.get("_fulls", F.lit(0)).alias("_full"))
    of_id = of_id.unionByName(told.where(F.length("_hex") < 64).join(one, "_hex").select("id", "_full"))
    # an id that has many hashes tells none, so two are enough to know
    of_id = of_id.groupBy("id").agg(F.min("_full").alias("_first"), F.max("_full").alias("_last"))
    open_ = r.where(~F.coalesce(full, F.lit(False))).join(long, "_hex", "left").join(of_id, "id", "left")
    single = F.when(F.col("_first") == F.col("_last"), F.col("_first"))
    by_short = F.when(F.size("_fulls") == 1, F.get("_fulls", F.lit(0))).when(F.array_contains("_fulls", single), single)
    told_open = open_.withColumn("content", F.when(F.col("_hex").isNull(), single).otherwise(by_short))
    told_full = r.where(full).withColumn("content", F.col("_hex"))
    keep = [*records.columns, "content"]
    return told_full.select(*keep).unionByName(told_open.select(*keep))


def survivors(records: DataFrame, fields: list[str], lists: list[str], when: str) -> DataFrame:
    """(content, rec_id, n) of each content with at least two records: the surviving record.

    It has the most of the fields filled (not null, empty or blank), then the latest `when` (null is earliest),
    then the highest rec_id. Repeated rows count as records. Aggregates combine before they are shuffled, so a
    content may hold any share of the rows.
    """
    filled = [F.when(blank(F.col(f)), 0).otherwise(1) for f in fields]
    filled += [F.when(F.coalesce(F.exists(F.col(f), lambda x: ~blank(x)), F.lit(False)), 1).otherwise(0) for f in lists]
    rank = F.struct(sum(filled[1:], filled[0]).alias("filled"), F.col(when).isNotNull().alias("dated"), F.col(when).alias("when"), F.col("rec_id").alias("rec_id"))
    best = records.where("content is not null").groupBy("content").agg(F.max(rank).alias("best"), F.count("*").alias("n"))
    return best.where("n >= 2").select("content", F.col("best.rec_id").alias("rec_id"), "n")


def best_values(records: DataFrame, fields: list[str], source: str, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(content, field, value, support): the value of each field that truth discovery supports most.

    A claim is a filled value of a record; claims of equal value are one line with counts by source, so a content
    that holds a third of all rows is still a few lines. Reliability of a source is -log of its share of claims
    against the current truth; support of a value is the sum of its claims' reliabilities, each source's claims
    for one field of one content counting as shares of one. Fields without contradiction are settled once; rounds
    go over the others only, and only the sums per source reach the driver. Ties go to the greater value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields)))
    claims = records.where("content is not null").select("content", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), pairs.alias("p"))
    claims = claims.select("content", "source", "p.field", "p.value").where(~blank(F.col("value"))).groupBy("content", "field", "value", "source").agg(F.count("*").alias("n"))
    items = claims.groupBy("content", "field", "value").agg(F.map_from_entries(F.collect_list(F.struct("source", F.col("n").cast("double")))).alias("by"))
    items = items.groupBy("content", "field").agg(F.collect_list(F.struct("value", "by")).alias("claims"))
    items = cut(items, "claims")
    plain, open_ = items.where(F.size("claims") == 1), items.where(F.size("claims") > 1)
    sums = plain.select(F.explode(F.get("claims", F.lit(0))["by"]).alias("source", "n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    agree = {r.source: r.n for r in sums}
    weights: dict[str, float] = {}

    def supported(weights: dict[str, float]) -> DataFrame:
        w = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv)) if weights else F.create_map().cast("map<string,double>")
        # a source that has claimed several values splits its one vote among them
        total = F.aggregate("claims", F.create_map().cast("map<string,double>"), lambda m, c: F.map_zip_with(m, c["by"], lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
        one = lambda c, t: F.aggregate(F.map_entries(c["by"]), F.lit(0.0), lambda s, e: s + F.coalesce(F.try_element_at(w, e["key"]), F.lit(1.0)) * e["value"] / F.try_element_at(t, e["key"]))
        d = open_.withColumn("_t", total)
        scored = F.transform("claims", lambda c: F.struct(one(c, F.col("_t")).alias("support"), c["value"].alias("value"), c["by"].alias("by")))
        best = F.array_sort(scored, lambda a, b: F.when(a["support"] > b["support"], -1).when(a["support"] < b["support"], 1).when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
        return d.withColumn("best", F.get(best, F.lit(0)))

    for _ in range(rounds):
        d = supported(weights)
        said = d.select(F.explode("_t").alias("source", "all"), F.col("best.by").alias("by")).select("source", "all", F.coalesce(F.try_element_at("by", F.col("source")), F.lit(0.0)).alias("ok"))
        rows = said.groupBy("source").agg(F.sum("all").alias("all"), F.sum("ok").alias("ok")).collect()
        new = {}
        for r in rows:
            fine, every = r.ok + agree.get(r.source, 0.0), r["all"] + agree.get(r.source, 0.0)
            new[r.source] = -math.log((every - fine + 1) / (every + 2))
        moved = max((abs(new[s] - weights.get(s, 1.0)) for s in new), default=0.0)
        weights = new
        if moved < tolerance:
            break
    settled = plain.select("content", "field", F.get("claims", F.lit(0))["value"].alias("value"), F.lit(1.0).alias("support"))
    chosen = supported(weights)
    chosen = chosen.select("content", "field", F.col("best.value").alias("value"), F.col("best.support").alias("support"))
    return settled.unionByName(chosen)


def all_items(records: DataFrame, field: str) -> DataFrame:
    """(content, items): the distinct filled items of a list field over all records of a content, sorted."""
    one = records.where("content is not null").select("content", F.explode(field).alias("item")).where(~blank(F.col("item"))).distinct()
    return one.groupBy("content").agg(F.sort_array(F.collect_list("item")).alias("items"))
