import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkslide.llm import bpe, quality

RANKS = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [None, "", " ", "Hello world", "it's  we'll\n\n  done ", "naïve café ＡＢＣ 花火大会 バダ", "👨‍👩‍👧 ok", "  x　y\u0085z", "a" * 3000, "loading" * 200, "x1234567890 3.14", "the the the " * 2000, "\x00\x01\ttab", "Привет мир", "<|endoftext|>", "naïveté naïveté Zxqj", "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "abab" * 500, "あ漢字の写真" * 3000, "=-" * 5000, "tion" * 400 + "ing" * 99]


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")
def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumns({"ids": F.lit("clash"), "word": F.lit(1)})
    for limit in (64 << 20, 0):
        got = {r.id: list(r.ids) for r in bpe.encode(df, bpe.rank_map(RANKS), 64, limit).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    back = bpe.encode(df.where("text is not null"), bpe.rank_map(RANKS)).select("id", bpe.decode(F.col("ids"), bpe.piece_list(RANKS)).alias("t"))
    assert {r.id: r.t for r in back.collect()} == {i: x for i, x in enumerate(TEXTS) if x is not None}
    twice = df.where("id in (3, 15)").union(df.where("id in (3, 15)"))
    assert bpe.encode(twice, bpe.rank_map(RANKS)).count() == 2
    for d in (df, twice):
        sizes = {r.id: r.tokens for r in bpe.token_counts(d, bpe.rank_map(RANKS), 64).collect()}
        assert sizes == {i: len(got[i]) for i in sizes} and len(sizes) == d.distinct().count()
    assert bpe.encode(df.where("id < 0"), bpe.rank_map(RANKS)).count() == 0


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")
def test_a_run_of_a_megabyte(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    r = random.Random(2)
    texts = ["a" * 1_000_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "".join(r.choices(["the", "ing", "er", "at"], k=100_000))]
    got = {x.id: list(x.ids) for x in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), bpe.rank_map(RANKS)).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")
def test_every_token_merges_to_itself():
    """What lets all pairs of one rank merge at once: each token's bytes, taken alone, merge to the token by lower ranks."""
    ranks = bpe.read_ranks(RANKS)
    for token, rank in ranks.items():
        p = [token[i : i + 1] for i in range(len(token))]
        while len(p) > 1:
            low, i = min((ranks.get(p[i] + p[i + 1], 1 << 30), i) for i in range(len(p) - 1))
            assert low <= rank, token
            p[i : i + 2] = [p[i] + p[i + 1]]


COMMON = [("en", w) for w in "the of and to in is was it that on with for as but not at by we he she they had".split()] + [("de", w) for w in "der die das und ist war nicht mit auf wir ein eine".split()] + [("ja", "ない"), ("ja", "した"), ("ja", "です"), (None, None)]
PROSE = "We went to the lake with the dogs and it was cold. She had the map, but not the keys to the boat. "


def test_kinds(spark):
    docs = [(i, PROSE * (1 + i % 3)) for i in range(60)] + [(100 + i, "Milk\nBread\nEggs\nButter\nCheese") for i in range(10)] + [(200 + i, f"a,{i},2019-01-02,ok\nb,{i},2019-01-03,late\nc,7,2019-01-05,ok") for i in range(10)]
    docs += [(300, "=" * 300), (301, PROSE + "\n\n" + "x.jpg,2019-01-02,12.1,ok\n" * 30), (302, PROSE * 9 + "\n\n- a\n- b"), (303, None), (304, ""), (305, " \n\t "), (306, PROSE * 3000)]
    df = spark.createDataFrame(docs, "id long, text string").withColumns({"prose": F.lit("clash"), "kind": F.lit(1)})
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r.id: r for r in quality.classify(df, common).collect()}
    assert not any(got[i].found for i in range(60)) and all(got[i].found for i in [*range(100, 110), *range(200, 210), 300, 301])
    assert not got[302].found and not got[306].found and not {303, 304, 305} & set(got)
    assert got[100].list > 0 and got[200].table > 0 and got[300].junk > 0
    assert quality.classify(df.where("id < 0"), common).count() == 0


def test_mixture_finds_two_clouds(spark):
    rnd = np.random.default_rng(4)
    a, b = rnd.normal(0, 1, (400, len(quality.STATS))), rnd.normal(6, 1, (200, len(quality.STATS)))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in np.vstack([a, b])], ", ".join(f"{c} double" for c in quality.STATS))
    m = quality.fit(rows, [a[:3], b[:3]])
    assert abs(m.weights[0] - 2 / 3) < 0.02
    assert (m.posterior(m.standard(a)).argmax(axis=1) == 0).mean() > 0.99 and quality.name_components(m, ["prose", "junk"], [a[:3], b[:3]]) == ["prose", "junk"]


def test_stats_of_nothing(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a" * 100_000), (3, None), (4, "\r\n\r\n"), (5, "\U000e0041 \U0010fffd")], "id long, text string").withColumn("no", F.lit("clash"))
    common = spark.createDataFrame(COMMON, "lang string, word string")
    r = quality.text_stats(docs, common).collect()
    assert len(r) == 5 and all(x[c] is not None for x in r for c in quality.STATS)
    assert quality.text_stats(docs.where("id < 0"), common).count() == 0 and quality.block_stats(docs, common.where("false")).count() == 2


def _plainly(text):
    """The statistics once more, by regular expressions over one text."""
    import math

    import regex

    blank = r"[\s\u200b\ufeff]"
    tokens = [t for t in regex.split(blank + "+", text) if t]
    lines = [x for x in regex.split(r"[\r\n]+", text) if regex.sub(blank, "", x)]
    words = [w.lower() for w in regex.findall(r"[\p{L}\p{M}]+(?:['’]\p{L}[\p{L}\p{M}]*)*", text)]
    n, nt, nl = max(len(regex.sub(blank, "", text)), 1), max(len(tokens), 1), max(len(lines), 1)
    known = {w for _, w in COMMON if w}
    return {
        "log_words": math.log1p(nt), "word_length": math.log(min(n / nt, 60) + 1), "digits": min(len(regex.findall(r"\p{N}", text)) / n, 0.5),
        "common": min(len(set(words) & known) / max(len(set(words)), 1), 0.6), "unique": len(set(words)) / max(len(words), 1),
        "ends": sum(bool(regex.search(r"[.!?…。！？।؟:;][\"'”’»“)\]]*[\p{So}\p{Sk}\p{M}\u200d\ufe0f\s]*$", x)) for x in lines) / nl,
        "separators": min(len(regex.findall(r"[,;|\t]| {3,}", text)) / nt, 1.2), "upper": sum(bool(regex.match(r"[\p{Lu}\p{Nd}\p{P}\p{S}]", t)) for t in tokens) / nt,
        "marks": min(sum(bool(regex.search(r"^\s*(?:[-*•‣·+]|\[.?\]|\d{1,3}[.)])\s+\S", x)) + bool(regex.search(r"\S {2,}\S+ {2,}\S|\t|[|;,]\S|\" *;|\| ", x)) for x in lines) / nl, 1.0),
    }


@pytest.mark.parametrize(
    "text",
    ["One two. Three!", "- a\n* b\n [x] c\n[ ] d\n12) e\n1. f\n-g", "a   b   c\nlong  word  here\tq", "it's the dog’s 'end'", "| a | b |\n|---|---|", "x;y,z\n\"1\" ;2", "Hi 🙂\nbye.) \nНет »", "a, b, c: \"d.\"", "  ", "ÀÉ ß İ the THE", "1234 ٣٤ Ⅷ ½"],
)
def test_statistics_are_those_of_plain_expressions(text):
    got = quality.measure([text, "other. text", text], frozenset(w for _, w in COMMON if w), False)
    for c, v in _plainly(text).items():
        assert abs(got[c][0] - v) < 1e-9 and abs(got[c][2] - v) < 1e-9, c


def test_blocks_are_those_between_blank_lines():
    got = quality.measure(["a b\r\n\r\nc\n \n\n\nd", "\n\ne\nf http://x.y/z", "", "\n"], frozenset(), True)
    assert list(zip(got["at"], got["n_chars"])) == [(0, 2), (0, 1), (0, 1), (1, 14)] and not got.duplicated(["at", "no"]).any()


def _labelled(r):
    """A made corpus with known kinds, in words that no example has."""
    sentence = lambda: f"{r.choice(['The', 'A', 'Her', 'My'])} {r.choice(['cousin', 'baker', 'teacher', 'pilot'])} {r.choice(['found', 'lost', 'sold', 'kept'])} the {r.choice(['bicycle', 'letter', 'kettle', 'ladder'])} that {r.choice(['we', 'they', 'you'])} had left {r.choice(['in the shed', 'at the inn', 'on the ferry'])} {r.choice(['before', 'after'])} the {r.choice(['frost', 'parade', 'exam'])}."
    item = lambda: r.choice(["Kettle", "Ladder", "Bicycle", "Red scarf", "Wool hat", "Tin box"])
    made = {
        "prose": lambda: " ".join(sentence() for _ in range(r.randint(2, 8))),
        "list": lambda: "\n".join(r.choice(["- ", "* "]) + item() for _ in range(r.randint(4, 12))),
        "table": lambda: "\n".join(f"{r.randint(1, 99)}.png,{r.randint(2001, 2020)}-01-0{r.randint(1, 9)},{r.random():.2f},{r.choice(['yes', 'no'])}" for _ in range(r.randint(4, 12))),
        "junk": lambda: "\n".join("".join(r.choice("#%&@<>|~^$[]{}=") for _ in range(40)) for _ in range(r.randint(2, 6))),
    }
    return [(i, k, made[k]()) for i, k in enumerate(r.choices(list(made), [80, 8, 6, 6], k=2000))]


def test_held_out_labels(spark):
    import random

    rows = _labelled(random.Random(8))
    got = {x.id: x for x in quality.classify(spark.createDataFrame([(i, t) for i, _, t in rows], "id long, text string"), spark.createDataFrame(COMMON, "lang string, word string")).collect()}
    bad = {i for i, k, _ in rows if k != "prose"}
    found = {i for i, x in got.items() if x.found}
    assert len(found & bad) >= 0.97 * len(bad) and len(found & bad) >= 0.97 * len(found)


def test_a_fit_that_has_not_settled_says_so(spark):
    rnd = np.random.default_rng(4)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rnd.normal(0, 1, (200, len(quality.STATS)))], ", ".join(f"{c} double" for c in quality.STATS))
    e = [rnd.normal(0, 1, (3, len(quality.STATS))) for _ in range(2)]
    with pytest.warns(RuntimeWarning):
        assert not quality.fit(rows, e, rounds=2, tolerance=0).converged
    m = quality.fit(rows, e)
    assert m.converged and m.rounds > 2
