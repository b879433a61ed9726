import random

from pyspark.sql import functions as F

from darkslide.llm import mixing, survivors

H = ["%064x" % (i * 7919 + 2**250 + i * 2**200) for i in range(8)]


def test_contents(spark):
    rows = [
        (1, "i1", H[0]), (2, "i1", "SHA256:" + H[0].upper()), (3, "i1", f" {H[0]}\n"), (4, "i9", H[0][:12]), (5, "i1", None), (6, "i2", H[1]), (7, "i2", ""), (8, "i3", H[2]), (9, "i3", H[3]), (10, "i3", None),
        (11, None, None), (12, "i4", "sha256=" + H[4]), (13, "i5", "nonsense"), (14, "i9", None), (15, "i6", "ffffffffffff"),
    ]
    df = spark.createDataFrame(rows, "rec_id long, id string, sha string").withColumn("_full", F.lit("clash"))
    got = {r.rec_id: r.content for r in survivors.contents(df).collect()}
    same = H[0]
    # the shared first digits of the made hashes leave a short one open unless its digits are enough
    unique = sum(h.startswith(H[0][:12]) for h in (H[0], H[1], H[2], H[3], H[4])) == 1
    assert [got[i] for i in (1, 2, 3, 5)] == [same] * 4 and got[6] == got[7] == H[1] and got[8] == H[2] and got[10] is None
    assert got[11] is None and got[12] == H[4] and got[13] is None and got[15] is None
    assert (got[4] == same and got[14] == same) if unique else got[4] is None
    assert survivors.contents(df.where("rec_id < 0")).count() == 0


def test_survivor_order(spark):
    S = "rec_id long, content string, path string, name string, albums array<string>, at long"
    rows = [(1, "a", "p", "", [], 9), (2, "a", "p", "n", [], 1), (3, "a", "p", "n", None, None), (4, "a", "p", "n", [" "], 1), (5, "b", "p", None, None, None), (6, "c", None, None, None, None), (7, "c", " ", "\t", [], None), (8, None, "p", "n", ["x"], 5), (9, "d", "p", None, ["x"], 1), (10, "d", "p", "n", None, 2), (10, "d", "p", "n", None, 2)]
    got = {r.content: (r.rec_id, r.n) for r in survivors.survivors(spark.createDataFrame(rows, S), ["path", "name"], ["albums"], "at").collect()}
    assert got == {"a": (4, 4), "c": (7, 2), "d": (10, 3)}


def test_truth_discovery_trusts_the_reliable_source(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        rows += [(i, f"c{i}", "good", f"v{i}"), (i, f"c{i}", "bad", f"v{i}" if rnd.random() < 0.2 else f"b{i}"), (i, f"c{i}", "fair", f"v{i}" if rnd.random() < 0.9 else f"a{i}")]
    rows += [(900, "one", "good", "G"), (901, "one", "bad", "B"), (902, "two", "bad", None), (903, "two", "bad", " "), (904, None, "bad", "B")]
    df = spark.createDataFrame(rows, "rec_id long, content string, source string, path string")
    got = {r.content: r.value for r in survivors.best_values(df, ["path"], "source").collect()}
    assert got["one"] == "G" and "two" not in got and sum(got[f"c{i}"] == f"v{i}" for i in range(300)) >= 298
    assert survivors.best_values(df.where("rec_id < 0"), ["path"], "source").count() == 0


def test_albums(spark):
    df = spark.createDataFrame([("a", ["x", ""]), ("a", ["y", "x"]), ("b", None), (None, ["z"])], "content string, albums array<string>")
    assert [(r.content, r["items"]) for r in survivors.all_items(df, "albums").collect()] == [("a", ["x", "y"])]


def test_schedule_is_proportionate():
    parts = mixing.whole_parts({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 10_000)
    assert parts == {"a": 10, "b": 6, "c": 3, "d": 1}
    for p in (parts, mixing.whole_parts({"x": 0.337, "y": 0.291, "z": 0.372}, 1000)):
        order, size, have = mixing.schedule(p), sum(p.values()), dict.fromkeys(p, 0)
        for t, s in enumerate(order, 1):
            have[s] += 1
            assert all(abs(have[k] - p[k] * t / size) < 1 for k in p)
        assert have == p


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, s, rnd.randrange(20, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["small"] * 60 + ["other"] * 100)] + [(9000, None, 50), (9001, "big", 0), (9002, "small", None)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 1), (None, 0.5, 1)]
    d = spark.createDataFrame(docs, "id long, source string, tokens long").withColumn("slot", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, block=512, per_bucket=5_000)
    got = {r.source: r for r in mixing.shares(m, t).collect()}
    assert all(abs(got[k].share - w) < 0.002 for k, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    assert abs(got["big"].share - 0.5) < 0.01 and abs(got["mid"].share - 0.3) < 0.01 and abs(got["small"].share - 0.2) < 0.01 and got["absent"].tokens == 0
    assert got["small"].most <= 4 and got["mid"].most <= 2 and got["big"].most == 1 and set(got) == {"big", "mid", "small", "absent"}
    rows = m.orderBy("position").collect()
    assert len({r.position for r in rows}) == len(rows) and rows == mixing.mix(d, t, block=512, per_bucket=5_000).orderBy("position").collect()
    one = mixing.mix(d, t, block=512)  # other buckets keep the shares
    assert abs({r.source: r.share for r in mixing.shares(one, t).collect()}["big"] - 0.5) < 0.01
    assert mixing.mix(d.where("id < 0"), t).count() == 0 and mixing.mix(d, t.where("source = 'absent'")).count() == 0


def _deviation(rows, weights):
    """The most by which a source's running tokens are off its share of all so far."""
    have, total, worst = dict.fromkeys(weights, 0), 0, 0.0
    for r in rows:
        have[r.source] += r.tokens
        total += r.tokens
        worst = max(worst, *(abs(have[s] - w * total) for s, w in weights.items()))
    return worst


def test_running_shares_stay_within_a_block(spark):
    rnd = random.Random(6)
    weights = {"a": 0.3, "b": 0.25, "c": 0.2, "d": 0.1, "e": 0.1, "f": 0.05}
    docs = [(i, s, rnd.randrange(1, 1024 if i % 3 else 200)) for i, s in enumerate(rnd.choices(list(weights), k=6000))]
    d = spark.createDataFrame(docs, "id long, source string, tokens long")
    t = spark.createDataFrame([(s, w, 1 + i) for i, (s, w) in enumerate(weights.items())], "source string, target_share double, max_repeats int")
    rows = mixing.mix(d, t, per_bucket=20_000).orderBy("position").collect()
    assert _deviation(rows, weights) < 2048 and len({(r.id, r.repeat) for r in rows}) == len(rows)
    assert all(r.repeat <= list(weights).index(r.source) for r in rows) and len({r.position for r in rows}) == len(rows)
    total = sum(r.tokens for r in rows)
    assert all(abs(sum(r.tokens for r in rows if r.source == s) / total - w) < 0.001 for s, w in weights.items())


def test_a_document_beyond_the_share_gives_way(spark):
    docs = [(1, "a", 1000), (2, "b", 900), (3, "b", 5000), (4, "b", 90), (5, "b", 9), (6, "b", 1)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    for seed in range(4):
        rows = mixing.mix(spark.createDataFrame(docs, "id long, source string, tokens long"), t, seed=seed).collect()
        assert sum(r.tokens for r in rows if r.source == "b") == 1000 and 3 not in {r.id for r in rows}


def test_starts_run_through_buckets_and_spans(spark):
    rnd = random.Random(9)
    rows = [(i, s, rnd.randrange(1, 50)) for i, s in enumerate(rnd.choices("xyz", [6, 3, 1], k=3000))]
    d = spark.createDataFrame(rows, "id long, source string, tokens long").withColumn("h", F.xxhash64("id"))
    d = d.join(d.groupBy("source").agg(F.sum("tokens").alias("total")), "source")
    got = {}
    for r in mixing.running_starts(d, per_bucket=200, span=8).collect():
        got.setdefault(r.source, []).append((r.start, r.tokens))
    for starts in got.values():
        starts.sort()
        assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
