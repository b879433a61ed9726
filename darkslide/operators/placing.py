"""Where files go, under which names, and which are taken for a sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.functions.names import stem as stem_of
from darkslide.functions.names import with_index
from darkslide.functions.text import fold_key
from darkslide.session import cut


def directory(placeholder: F.Column, not_importable: F.Column, year: F.Column, kind: F.Column) -> F.Column:
    """placeholders, not-importable (documents and videos that were not converted), unknown (no date), else the local year."""
    return F.when(placeholder, "placeholders").when(not_importable | (kind == "webm"), "not-importable").when(year.isNull(), "unknown").otherwise(F.lpad(year.cast("string"), 4, "0"))


def number_names(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(id, dir, base, n, name): collision-free names for files (id, dir, name, ord, and pair where files belong together).

    Within a folder, files of one folded stem (extensions do not count) are numbered in order: the first keeps its
    name, the next is ` (2)`. Of two files of one pair with one stem and folder and unlike extensions the later takes
    the number of the earlier. Names that look numbered themselves may clash with given numbers, and so may names
    that are taken (dir, name) already: stems of a folder that could, and only those, are numbered one after the other,
    each taking the first number that is free. The others are numbered in ranges of the order with offsets, so that one
    stem may hold any share of the files.
    """
    f = files.select("id", "dir", "name", "ord", F.col("pair").cast("string").alias("pair") if "pair" in files.columns else F.lit(None).cast("string").alias("pair"))
    stem = fold_key(stem_of(F.col("name")))
    family = F.regexp_replace("_stem", r" \(\d+\)$", "")
    f = f.withColumn("_stem", stem).withColumn("_family", family)
    ext = lambda c: F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))
    halves = f.where("pair is not null").groupBy("pair", "dir", "_stem").agg(F.min("ord").alias("_first"), F.count("*").alias("_k"), F.count_distinct(ext(F.col("name"))).alias("_e"))
    halves = halves.where("_k = 2 and _e = 2").select("pair", "dir", "_stem", "_first")
    f = f.join(halves, ["pair", "dir", "_stem"], "left").withColumn("_second", F.coalesce(F.col("ord") > F.col("_first"), F.lit(False))).drop("_first")
    risky = f.where(F.col("_family") != F.col("_stem")).select("dir", "_family")
    if taken is not None:
        t = taken.select("dir", "name").distinct().withColumn("_stem", stem).withColumn("_family", family)
        risky = risky.unionByName(t.select("dir", "_family"))
    f = cut(f.join(risky.distinct().withColumn("_risky", F.lit(True)), ["dir", "_family"], "left"), "names")
    plain = f.where("_risky is null")
    own = plain.where("not _second").repartitionByRange("dir", "_stem", "ord").withColumn("_p", F.spark_partition_id())
    own = cut(own.withColumn("_i", F.row_number().over(Window.partitionBy("_p", "dir", "_stem").orderBy("ord"))), "numbers")
    counts = own.groupBy("dir", "_stem", "_p").agg(F.count("*").alias("_c"))
    before = counts.select("dir", "_stem", "_p", (F.sum("_c").over(Window.partitionBy("dir", "_stem").orderBy("_p")) - F.col("_c")).alias("_before"))
    own = own.join(before, ["dir", "_stem", "_p"]).withColumn("n", (F.col("_i") + F.col("_before")).cast("int"))
    second = plain.where("_second").join(own.where("pair is not null").select("pair", "dir", "_stem", "n"), ["pair", "dir", "_stem"])
    numbered = own.select("id", "dir", "name", "n").unionByName(second.select("id", "dir", "name", "n"))

    def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["_held"].to_numpy(bool)
        used = {name.lower() for name in pdf.loc[held, "name"]}
        count: dict[str, int] = {}
        of_pair: dict[str, int] = {}
        out = []
        todo = pdf[~held]
        for _, id_, dir_, name, s, pair in sorted(zip(todo["ord"], todo["id"], todo["dir"], todo["name"], todo["_stem"], todo["pair"]), key=lambda r: r[0]):
            ext = f".{name.rsplit('.', 1)[1]}".lower() if "." in name else ""
            spelled = lambda n, s=s, ext=ext: (s if n == 1 else f"{s} ({n})") + ext
            n = of_pair.get(pair, 0) if pair is not None else 0
            if not n or spelled(n) in used:
                n = count.get(s, 0) + 1
                while spelled(n) in used:
                    n += 1
                count[s] = n
                if pair is not None:
                    of_pair.setdefault(pair, n)
            used.add(spelled(n))
            out.append((id_, dir_, name, n))
        return pd.DataFrame(out, columns=["id", "dir", "name", "n"])

    kinds = dict(f.dtypes)
    slow = f.where("_risky").withColumn("_held", F.lit(False))
    if taken is not None:
        fill = {c: F.lit(None).cast(kinds[c]) for c in ("id", "ord", "pair")}
        slow = slow.select("id", "dir", "name", "ord", "pair", "_stem", "_family", "_held").unionByName(t.withColumns(fill).withColumn("_held", F.lit(True)).select("id", "dir", "name", "ord", "pair", "_stem", "_family", "_held"))
    slow = slow.groupBy("dir", "_family").applyInPandas(one_by_one, f"id {kinds['id']}, dir string, name string, n int")
    every = numbered.unionByName(slow)
    return every.select("id", "dir", F.col("name").alias("base"), "n", with_index(F.col("name"), F.col("n")).alias("name"))


def number_folders(folders: DataFrame) -> DataFrame:
    """(folder, name): distinct names for the folders (folder, name: sanitized), in order of folder; a name whose folded form is taken gets the first free ` (n)` at its end.

    Names that could clash, those equal but for a number at the end, are settled together; others need no company.
    """
    f = folders.select("folder", "name").distinct().withColumn("_key", fold_key(F.col("name")))
    f = f.withColumn("_family", F.regexp_replace("_key", r"( \(\d+\))+$", ""))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for folder, name, key in sorted(zip(pdf["folder"], pdf["name"], pdf["_key"])):
            n = 1
            while (key if n == 1 else f"{key} ({n})") in used:
                n += 1
            used.add(key if n == 1 else f"{key} ({n})")
            out.append((folder, name if n == 1 else f"{name} ({n})"))
        return pd.DataFrame(out, columns=["folder", "name"])

    alone = Window.partitionBy("_family")
    f = f.withColumn("_n", F.count("*").over(alone))
    return f.where("_n = 1").select("folder", "name").unionByName(f.where("_n > 1").groupBy("_family").applyInPandas(settle, "folder string, name string"))


def stride_sample(df: DataFrame, order: str, n: int, buckets: int = 64) -> DataFrame:
    """At most n rows, evenly spread by order: rows 0, step, 2 step ... with step = rows / n, at least 1. Positions come from counts of ranges, so no task sees more than a range."""
    ranged = df.repartitionByRange(buckets, order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    out = ranged.withColumn("_i", at).join(F.broadcast(before), "_p").withColumn("_i", F.col("_i") + F.col("_before"))
    step = F.greatest(F.floor(F.col("_all") / n), F.lit(1))
    return out.where((F.col("_i") % step == 0) & (F.col("_i") / step < n)).drop("_p", "_i", "_before", "_all")


def one_per_album(members: DataFrame, group: str, folder: str, order: str) -> DataFrame:
    """(group, folder, order): each group once in each album folder that has it, by its first member there."""
    return members.groupBy(group, folder).agg(F.min(order).alias(order))


