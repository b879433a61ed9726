"""Sidecars: what they say, and which media they belong to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.functions.text import EDITED, fold_key, live_stem, nfc
from darkslide.session import cut

_LIMIT = 51  # bytes of a sidecar's name with its extension


def parse(json: F.Column) -> F.Column:
    """The fields of a sidecar: title, description, url, taken, creation, lat, lon, alt. Null for what is no JSON object.

    Wrong types count as missing; times may be text or number, and 0 or no number is none. The location is that of
    geoData, else of geoDataExif; 0, 0 is no location, altitude 0 no altitude.
    """
    v = F.try_parse_json(json)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    time = lambda key: F.nullif(F.coalesce(get(f"$.{key}.timestamp", "bigint"), get(f"$.{key}.timestamp", "string").try_cast("bigint")), F.lit(0).cast("bigint"))
    spot = lambda key: F.struct(*(get(f"$.{key}.{n}", "double").alias(a) for n, a in (("latitude", "lat"), ("longitude", "lon"), ("altitude", "alt"))))

    def place(key: str) -> F.Column:
        s = spot(key)
        some = s["lat"].isNotNull() & s["lon"].isNotNull() & ~((s["lat"] == 0) & (s["lon"] == 0))
        return F.when(some, s)

    geo = F.coalesce(place("geoData"), place("geoDataExif"))
    fields = F.struct(
        get("$.title", "string").alias("title"), get("$.description", "string").alias("description"), get("$.url", "string").alias("url"),
        time("photoTakenTime").alias("taken"), time("creationTime").alias("creation"), geo["lat"].alias("lat"), geo["lon"].alias("lon"), F.nullif(geo["alt"], F.lit(0.0)).alias("alt"),
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), fields)


def _cut(text: str, limit: int) -> str:
    return text.encode()[: max(0, limit)].decode("utf-8", "ignore")


def candidate_names(name: str) -> list[str]:
    """Names that the sidecar of a media file may have, most likely first.

    Sidecar names carry the media name, whole or without extension or editor's ending, with a long, a short or no
    tail, cut to a limit of bytes; a number in brackets may have moved behind the tail.
    """
    out: dict[str, None] = {}
    stem = re.sub(r"\.[^.]*$", "", name)
    ext = name[len(stem) :]
    plain = next((stem[: -len(e)] for e in EDITED if stem.lower().endswith(e)), None)
    bases = [name, stem] + ([plain + ext, plain] if plain is not None else [])
    for base in bases:
        if not base:
            continue
        long, short = f"{base}.supplemental-metadata", f"{base}.metadata"
        for c in (f"{long}.json", f"{base}.json", _cut(long, _LIMIT - 5) + ".json", _cut(base, _LIMIT - 5) + ".json", f"{short}.json", _cut(short, _LIMIT - 5) + ".json"):
            out.setdefault(c)
        if m := re.search(r"\(\d+\)", base):
            rest, n = base[: m.start()] + base[m.end() :], m[0]
            tail = f"{rest}.supplemental-metadata"
            # the number is put in after the cut, so the name may pass the limit; a cut within a character gives no name
            head = tail.encode()[: _LIMIT - 5] if len(tail.encode()) > _LIMIT - 5 else tail.encode()
            whole = head.decode("utf-8", "ignore")
            late = (f"{whole}{n}.json",) if whole.encode() == head else ()
            for c in (f"{tail}{n}.json", f"{rest}{n}.json", _cut(tail, _LIMIT - 5) + ".json", *late):
                out.setdefault(c)
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidates_udf(names: pd.Series, composed: pd.Series) -> pd.Series:
    """candidate_names of a name as written, then of its composed form."""
    return pd.Series([[] if a is None else list(dict.fromkeys(candidate_names(a) + (candidate_names(b) if b != a else []))) for a, b in zip(names, composed)])


def match(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(media_id, sidecar_id, pass, position) of media that have a sidecar; each has at most one.

    media and sidecars: id, folder, name, ord. Never across folders. First by exact name, where the last of equal
    names counts; then by composed form, then by folded form, each only where one sidecar alone has the key. Within
    a pass the first candidate that hits wins; an earlier pass wins over a later one. Three equi-joins on (folder,
    key): a folder that holds a large share of the rows spreads over its names.
    """
    s = sidecars.select(F.col("id").alias("sidecar_id"), "folder", "name", "ord")
    exact = s.groupBy("folder", "name").agg(F.max_by("sidecar_id", "ord").alias("sidecar_id")).withColumnRenamed("name", "candidate")
    lone = lambda key: s.groupBy("folder", key.alias("k")).agg(F.min("sidecar_id").alias("sidecar_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    spread = lambda d: d.select("media_id", "folder", F.posexplode(candidates_udf("name", nfc(F.col("name")))).alias("position", "candidate"))

    def best(hits: DataFrame) -> DataFrame:
        return hits.groupBy("media_id").agg(F.min(F.struct("pass", "position", "sidecar_id")).alias("b")).select("media_id", "b.sidecar_id", "b.pass", "b.position")

    m = media.select(F.col("id").alias("media_id"), "folder", "name")
    first = cut(best(spread(m).join(exact, ["folder", "candidate"]).withColumn("pass", F.lit(1))), "matches")
    # only media that the first pass leaves spread their candidates again
    rest = spread(m.join(first.select("media_id"), "media_id", "left_anti"))
    second = rest.withColumn("k", nfc(F.col("candidate"))).join(lone(nfc(F.col("name"))), ["folder", "k"]).withColumn("pass", F.lit(2))
    third = rest.withColumn("k", fold_key(F.col("candidate"))).join(lone(fold_key(F.col("name"))), ["folder", "k"]).withColumn("pass", F.lit(3))
    cols = ("media_id", "sidecar_id", "pass", "position")
    return first.select(*cols).unionByName(best(second.select(*cols).unionByName(third.select(*cols))))


def title_agrees(title: F.Column, name: F.Column) -> F.Column:
    """Whether a sidecar's title and a media name can be of one file; a null or empty title says nothing.

    Both are to be given composed. They are equal, or so without the name's number or extension, or both without their numbers; or so with
    the name's editor's ending taken off; or they are the halves of a live photo. A null name agrees with no title.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    bare = lambda c: F.regexp_replace(c, r"^(.*?)\(\d+\)", "$1")
    plain = lambda c: F.regexp_replace(c, "(?iu)(?:" + "|".join(EDITED) + r")((?:\.[^.]*)?)$", "$1")

    def same(n: F.Column, t: F.Column) -> F.Column:
        of = lambda a, b: (a == t) | (a == b) | (stem(a) == t) | (stem(a) == b) | (fold_key(live_stem(a)) == fold_key(live_stem(b)))
        return (n == t) | of(bare(n), bare(t))

    names = [name]
    for _ in range(2):
        names.append(plain(names[-1]))
    agrees = same(names[0], title)
    for n in names[1:]:
        agrees = agrees | same(n, title)
    return title.isNull() | (title == "") | F.coalesce(agrees, F.lit(False))


def pick_for_groups(members: DataFrame, group: str, sidecar: str, order: str, canon: str) -> DataFrame:
    """(group, sidecar): that of the canonical member, else of the first member that has one."""
    own = F.max(F.when(F.col(order) == F.col(canon), F.col(sidecar)))
    first = F.min_by(sidecar, F.when(F.col(sidecar).isNotNull(), F.col(order)))
    return members.groupBy(group).agg(F.coalesce(own, first).alias("sidecar"))
