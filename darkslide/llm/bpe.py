"""Token ids of a byte-level BPE vocabulary, by Spark expressions alone.

A text is split into words by the vocabulary's pattern. Words that are tokens themselves are looked up; every
other word is encoded once for the whole corpus: a higher-order fold merges the adjacent pieces of lowest rank
until none can be merged. Pieces are binary values. The ranks travel as one literal, bucketed by a hash of the
piece so that a look-up compares a few entries. Long runs are parted where no token of the vocabulary crosses, and
what stays long is merged rank by rank, so that no word costs more than its length asks for.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.lets import let
from darkslide.session import cut

TOKENIZERS = os.environ.get("DARKSLIDE_TOKENIZERS", "/opt/tokenizers")
_WS = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# the published splitting pattern, with white space spelled out
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
BUCKETS = 16384
_NONE = 2**31 - 1
_SHORT = 48  # bytes up to which a word is merged pair by pair
_WITHIN = b"\xff\xff\xff"  # no UTF-8 text has these bytes: a pair before them is a pair within some token


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks (which are their ids) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bucket(key: bytes) -> int:
    h = xxhash.xxh64(key, seed=42).intdigest()
    return (h - (1 << 64) if h >= 1 << 63 else h) % BUCKETS


def rank_map(path: str) -> F.Column:
    """The ranks as one literal: buckets of byte pieces, and of their ranks. The optimizer folds it once; its size is that of the vocabulary.

    Pairs of bytes that lie side by side in some piece are entries too: where a pair is none of them, no merge
    crosses between its bytes.
    """
    ranks = read_ranks(path)
    keys: list[list[str]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    within = {piece[i : i + 2] + _WITHIN: 0 for piece in ranks for i in range(len(piece) - 1)}
    for piece, rank in (ranks | within).items():
        b = _bucket(piece)
        keys[b].append(base64.b64encode(piece).decode())
        values[b].append(rank)
    return F.from_json(F.lit(json.dumps({"k": keys, "v": values}, separators=(",", ":"))), "struct<k:array<array<binary>>,v:array<array<int>>>")


def piece_list(path: str) -> F.Column:
    """The pieces by id as one literal, for decoding; ids without a piece are null."""
    ranks = read_ranks(path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def words(text: F.Column) -> F.Column:
    """The words of a text, which joined give the text; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def rank_of(ranks: F.Column, piece: F.Column) -> F.Column:
    """The rank of a byte piece, null if it is no token."""
    at = F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")
    return F.get(F.get(ranks["v"], at), F.array_position(F.get(ranks["k"], at), piece).cast("int") - 1)


def _bytes(word: F.Column) -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(word, i, F.lit(1)))


def _pair(ranks: F.Column, a: F.Column, b: F.Column) -> F.Column:
    return F.coalesce(let(F.concat(a, b), lambda x: rank_of(ranks, x)), F.lit(_NONE))


def _pairs(ranks: F.Column, p: F.Column) -> F.Column:
    """Ranks of the pieces joined to the ones after them; the last has none."""
    return F.concat(F.transform(F.slice(p, 1, F.size(p) - 1), lambda a, i: _pair(ranks, a, F.get(p, i + 1))), F.array(F.lit(_NONE)))


def _merge_one(ranks: F.Column, p: F.Column, r: F.Column, low: F.Column) -> F.Column:
    """(p, r) after the leftmost pair of rank low is one piece."""

    def joined(k: F.Column, piece: F.Column) -> F.Column:
        before = F.when(k > 1, F.array(_pair(ranks, F.get(p, k - 2), piece))).otherwise(F.array().cast("array<int>"))
        after = F.when(k + 1 < F.size(p), _pair(ranks, piece, F.get(p, k + 1))).otherwise(F.lit(_NONE))
        return F.struct(
            F.concat(F.slice(p, 1, k - 1), F.array(piece), F.slice(p, k + 2, F.size(p))).alias("p"),
            F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), before, F.array(after), F.slice(r, k + 2, F.size(p))).alias("r"),
        )

    return let(F.array_position(r, low).cast("int"), lambda k: let(F.concat(F.get(p, k - 1), F.get(p, k)), lambda piece: joined(k, piece)))


def _merge_short(ranks: F.Column, word: F.Column) -> F.Column:
    """The pieces of a short byte word: from single bytes, the leftmost pair of lowest rank is merged until no pair has a rank."""
    start = lambda p: F.struct(p.alias("p"), _pairs(ranks, p).alias("r"))
    step = lambda s, _: let(F.array_min(s["r"]), lambda low: F.when(low == _NONE, s).otherwise(_merge_one(ranks, s["p"], s["r"], low)))
    return let(_bytes(word), lambda p: F.when(F.size(p) < 2, p).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), start(p), step, lambda s: s["p"])))


def _merge_runs(runs: DataFrame, ranks: F.Column, steps: int = 500) -> DataFrame:
    """(w, i, ids) of long byte runs (w, i, b): a step merges all pairs of the lowest rank, from the left.

    One after the other they give the same pieces, as no merge brings a pair of a rank still lower: where every
    token's own bytes merge to it, such a pair would have merged before. A run has as many steps as ranks occur in
    it, not as many as it has bytes. Runs that need more than `steps` go on in a further pass.
    """

    def every(s: F.Column) -> F.Column:
        # pairs that overlap stand side by side: of a run of them every other one merges, the first to begin with
        marks = F.array_join(F.transform(s["r"], lambda x: F.when(x == s["low"], "1").otherwise("0")), "")
        first = lambda m: F.filter(F.sequence(F.lit(0), F.size(s["p"]) - 1), lambda i: (i == 0) | (F.get(m, i - 1) == "0"))
        piece = lambda m, i: F.when(F.get(m, i) == "1", F.concat(F.get(s["p"], i), F.get(s["p"], i + 1))).otherwise(F.get(s["p"], i))
        return let(F.split(F.regexp_replace(marks, "11", "10"), ""), lambda m: F.transform(first(m), lambda i: piece(m, i)))

    state = lambda r, p: let(_pairs(r, p), lambda x: F.struct(p.alias("p"), x.alias("r"), F.array_min(x).alias("low")))
    step = lambda r: lambda s, _: F.when(s["low"] == _NONE, s).otherwise(let(every(s), lambda p: state(r, p)))
    started = let(ranks, lambda r: let(F.col("b"), lambda b: let(_bytes(b), lambda p: state(r, p))))
    left = cut(runs.select("w", "i", started.alias("s")).select("w", "i", "s.*"), "runs")
    done = None
    while not left.isEmpty():
        folded = let(ranks, lambda r: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct("p", "r", "low"), step(r)))
        now = cut(left.select("w", "i", folded.alias("s")).select("w", "i", "s.*"), "runs")
        ready = now.where(F.col("low") == _NONE).select("w", "i", let(ranks, lambda r: _ids(r, F.col("p"))).alias("ids"))
        done = ready if done is None else done.unionByName(ready)
        left = now.where(F.col("low") != _NONE)
    return done if done is not None else runs.where("false").select("w", "i", F.array().cast("array<int>").alias("ids"))


def _parts(ranks: F.Column, word: F.Column) -> F.Column:
    """A long byte word parted where no merge can cross."""
    n = F.octet_length(word)
    inside = lambda i: rank_of(ranks, F.concat(F.substring(word, i, F.lit(2)), F.lit(_WITHIN))).isNotNull()
    cuts = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), n - 1), lambda i: ~inside(i)), F.array(n))
    return let(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, i: F.substring(word, a + 1, F.get(c, i + 1) - a)))


def _ids(ranks: F.Column, pieces: F.Column) -> F.Column:
    return F.transform(pieces, lambda x: rank_of(ranks, x))


def merge(words_: DataFrame, ranks: F.Column) -> DataFrame:
    """(word, ids) of distinct words. Words longer than _SHORT bytes are parted first, their parts merged as rows of their own under a hash, and put together again: the cost of a word grows with its length alone."""
    w = words_.withColumn("b", F.col("word").cast("binary"))
    short = F.octet_length("b") <= _SHORT
    with_ranks = lambda d, f, *keep: d.select(*keep, let(ranks, lambda r: let(F.col("b"), lambda b: _ids(r, f(r, b)))).alias("ids"))
    done = with_ranks(w.where(short), _merge_short, "word")
    long = w.where(~short).withColumn("w", F.sha2("b", 256))
    if long.isEmpty():
        return done
    # the ranks are a large literal: every plan that names them costs the driver memory, so none is made in vain
    parts = cut(long.select("w", F.posexplode(let(ranks, lambda r: let(F.col("b"), lambda b: _parts(r, b)))).alias("i", "b")), "parts")
    runs = parts.where(~short)
    pieces = with_ranks(parts.where(short).select("b").distinct(), _merge_short, "b").join(parts.where(short), "b").select("w", "i", "ids")
    if not runs.isEmpty():
        pieces = pieces.unionByName(_merge_runs(runs, ranks))
    spelled = pieces.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("s")).select("w", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"))
    return done.unionByName(long.select("w", "word").join(spelled, "w").select("word", "ids"))


@contextmanager
def _short_plans(spark: SparkSession, length: int = 1 << 16) -> Iterator[None]:
    """Cuts the text of plans while those with the ranks in them run: the driver keeps it for every query, and the ranks alone are a megabyte of it."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, str(length))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _coded(texts: DataFrame, ranks: F.Column, chunk: int) -> DataFrame:
    """(id, _key, no, codes, rest) of chunks of words: ids of the words that are tokens, and for the others their place, counted down from -1, in rest. Written once."""
    docs = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    split = docs.select("id", "_key", words(F.col("text")).alias("words"))
    n = F.greatest(F.lit(0), F.floor((F.size("words") - 1) / chunk)).cast("int")
    parts = split.select("id", "_key", F.explode(F.sequence(F.lit(0), n)).alias("no"), "words").select("id", "_key", "no", F.slice("words", F.col("no") * chunk + 1, F.lit(chunk)).alias("words"))

    def code(words_: F.Column, ranks: F.Column) -> F.Column:
        ids = F.transform(F.transform(words_, lambda w: w.cast("binary")), lambda b: rank_of(ranks, b))

        def pack(ids: F.Column) -> F.Column:
            rest = F.array_distinct(F.filter(words_, lambda w, i: F.get(ids, i).isNull()))
            return let(rest, lambda rest: F.struct(F.transform(ids, lambda x, i: F.coalesce(x, -F.array_position(rest, F.get(words_, i)).cast("int"))).alias("codes"), rest.alias("rest")))

        return let(ids, pack)

    coded = parts.select("id", "_key", "no", let(ranks, lambda r: code(F.col("words"), r)).alias("c"))
    return cut(coded.select("id", "_key", "no", "c.codes", "c.rest"), "codes")


def _spelled(words_: DataFrame, ranks: F.Column, broadcast_bytes: int) -> DataFrame:
    """(word, ids) of the distinct words of a table, each merged once; marked for broadcast while its bytes are within the bound."""
    # few bytes and much work: as many tasks as a shuffle has, not as few as the bytes fill; read by each length once, so written between
    n = int(words_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = cut(merge(cut(words_.select("word").distinct().repartition(n), "words"), ranks), "word-ids")
    size = made.agg(F.coalesce(F.sum(F.octet_length("word") + 4 * F.size("ids") + 64), F.lit(0))).first()[0]
    return F.broadcast(made) if size <= broadcast_bytes else made


def encode(texts: DataFrame, ranks: F.Column, chunk: int = 512, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, ids) of every row of texts (id, text): token ids without special tokens; null and empty texts have the empty list.

    Other columns are ignored; rows repeated with equal id and text give one row. Every distinct word beyond the
    vocabulary is merged once. Long texts go in chunks of words, so that neither a look-up nor a group grows with
    a text; chunks are put together at the end, in the partition where they meet their words: one shuffle. Words
    cross the network only where they are no tokens themselves, once per chunk; their table of ids is broadcast while
    its bytes are within broadcast_bytes, else joined by hash, where AQE splits the partitions of very frequent words.
    """
    with _short_plans(texts.sparkSession):
        parts = _coded(texts, ranks, chunk)
        pairs = parts.select("id", "_key", "no", F.explode("rest").alias("word"))
        made = _spelled(pairs, ranks, broadcast_bytes)
    spelled = pairs.join(made, "word").select("id", "_key", "no", F.struct("word", "ids").alias("s"))
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType)
    both = parts.withColumn("s", none(spelled, "s")).unionByName(spelled.withColumns({"codes": none(parts, "codes"), "rest": none(parts, "rest")}))
    both = both.repartition("id", "_key").groupBy("id", "_key", "no").agg(F.first("codes", ignorenulls=True).alias("codes"), F.first("rest", ignorenulls=True).alias("rest"), F.collect_set("s").alias("spelled"))
    ids = lambda made: F.flatten(F.transform("codes", lambda c: F.when(c >= 0, F.array(c)).otherwise(F.get(made, -c - 1))))
    in_order = let(F.map_from_entries("spelled"), lambda lookup: F.transform("rest", lambda w: F.try_element_at(lookup, w)))
    both = both.select("id", "_key", "no", let(in_order, ids).alias("ids"))
    out = both.groupBy("id", "_key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return out.select("id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def token_counts(texts: DataFrame, ranks: F.Column, chunk: int = 512, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, tokens): how many ids encode would give; as encode, but only numbers cross the network."""
    with _short_plans(texts.sparkSession):
        parts = _coded(texts, ranks, chunk)
        pairs = parts.select("id", "_key", F.explode(F.filter("codes", lambda c: c < 0)).alias("c"), "rest").select("id", "_key", F.get("rest", -F.col("c") - 1).alias("word"))
        made = _spelled(pairs, ranks, broadcast_bytes)
    long = pairs.join(made, "word").select("id", "_key", F.size("ids").cast("long").alias("n"), F.lit(0).alias("times"))
    each = parts.select("id", "_key", F.size(F.filter("codes", lambda c: c >= 0)).cast("long").alias("n"), F.when(F.col("no") == 0, 1).otherwise(0).alias("times"))
    total = each.unionByName(long).groupBy("id", "_key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    # a row repeated with its id and text has the same chunks once more
    return total.select("id", F.expr("n div times").alias("tokens"))


def decode(ids: F.Column, pieces: F.Column) -> F.Column:
    """The text of token ids: their byte pieces one after the other. pieces: the literal of piece_list."""
    return let(pieces, lambda p: F.decode(F.encode(F.concat_ws("", F.transform(ids, lambda i: F.get(p, i))), "ISO-8859-1"), "UTF-8"))
