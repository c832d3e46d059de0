import random

import numpy as np

from phylospark.llm.truncation import Model, Prepared, _tail, finals, learn_prior, scores
from pyspark.sql import functions as F

WHO = "The archive|The student|A driver|The old museum|Our committee".split("|")
DOES = "opens|repairs|measures|sends|describes".split("|")
WHAT = "the table|the plan|a freezer|the leaf|the small parcel".split("|")
WHERE = "in spring|under the roof|near the river|without delay|at the harbour".split("|")


def sentence(rng):
    return f"{rng.choice(WHO)} {rng.choice(DOES)} {rng.choice(WHAT)} (no. {rng.randint(1, 9999)}) {rng.choice(WHERE)}"


def corpus(rng, n, limit=None):
    """(text, whether it was cut): sentences, headings and complete texts without a mark; some cut at random, or at a limit of their source."""
    out = []
    for _ in range(n):
        text = " ".join(sentence(rng) + rng.choice([".", ".", "!"]) for _ in range(rng.randint(1, 4)))
        kind = rng.random()
        if limit:
            out.append((text[:limit], len(text) > limit and text[limit - 1] not in ".!"))
        elif kind < 0.06:
            at = rng.randint(12, len(text) - 12)
            while text[at - 1] in ".! )" or text[at:].startswith((".", "!", " in ", " under ", " near ", " without ", " at ")) or any(text[:at].endswith(w) for w in WHERE):
                at -= 1
            out.append((text[:at] + rng.choice(["", "", " [..]", "�"]), True))
        elif kind < 0.10:
            out.append((f"Report {rng.randint(1, 99)}: {rng.choice(WHAT)}, {rng.choice(WHAT)}", False))
        elif kind < 0.13:
            out.append((text.rstrip(".!") + rng.choice(["", ":", ";"]), False))
        else:
            out.append((text, False))
    return out


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    free, limited = corpus(rng, 3000), corpus(rng, 600, 120)
    rows = [(i, x, "EN" if i % 50 == 0 else "en", "free") for i, (x, _) in enumerate(free)] + [(10_000 + i, x, "en", "limited") for i, (x, _) in enumerate(limited)]
    truth = {i: c for i, (_, c) in enumerate(free)} | {10_000 + i: c for i, (_, c) in enumerate(limited)}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.key: r.cut for r in scores(df, "doc_id", "text", "lang", "source").collect()}
    assert set(got) == set(truth)
    hit = sum(got[k] and truth[k] for k in truth)
    assert hit / sum(truth.values()) > 0.93 and hit / sum(got.values()) > 0.95


def test_edges(spark):
    ddl = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (3, " \n", "en", "s"), (4, "One.", None, None), (5, "x" * 300_000, "en", "s"), (6, "One.", None, None)], ddl)
    got = {r.key: r.cut for r in scores(df, "doc_id", "text", "lang", "source").collect()}
    assert set(got) == {4, 5, 6} and not got[4]
    assert scores(df.limit(0), "doc_id", "text", "lang", "source").count() == 0
    assert not any(r.cut for r in scores(df.filter("doc_id = 4"), "doc_id", "text", "lang", "source").collect())


def test_prepared():
    ready = Prepared(["One (no. 12). Two? Three [..]", "", " Ä  9\t\n٣x。Y. ", "No.\n\nYes!? no"])
    texts = ["".join(map(chr, ready.codes[a:b])) for a, b in zip(ready.starts, ready.starts[1:])]
    assert texts == ["\none (no. 0). two? three", "\n", "\nä 0 0x。y.", "\nno. yes!? no"]
    marks = lambda at: ["".join(map(chr, ready.codes[max(p - 2, 0) : p + 1])) for p in sorted(at.tolist())]
    assert marks(ready.behind) == ["0).", "wo?", "0x。", "no."] and marks(ready.before) == [" 0)", "two", " 0x", "x。y", "\nno"]
    assert Prepared([]).codes.size == 0


def test_tail():
    for text in ("abc", "x" * 5000, "1" * 5000, "word " + " " * 9000 + "end", "Aa bb cc. " * 400):
        whole, tail = (Prepared([x]).codes[-18:] for x in (text, _tail(text)))
        assert np.array_equal(whole, tail)
    assert len(_tail("Aa bb cc. " * 400)) < 4000


def test_counts_against_plain(spark):
    """The suffixes' counts against counting them in strings."""
    rng = random.Random(3)
    texts = [x for x, _ in corpus(rng, 60)] + ["One.", "One.", "Ö"]
    df = spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "k long, text string, lang string, source string").repartition(3)
    from phylospark.llm import truncation as t

    values = finals(df, "k", "text", "lang", "source")
    model, _ = t.trained(df, "text", values)
    plain = ["".join(map(chr, Prepared([x]).codes)) for x in texts]
    ends = {x[-n:] for x in plain for n in t.ORDERS if len(x) >= n}
    assert len(model.h) == len(ends)
    distinct = ["".join(map(chr, Prepared([x]).codes)) for x in set(texts)]
    for n in (1, 3, 8, 18):
        want = sorted(sum(x[p - n : p] == e for x in plain for p in range(n, len(x))) + sum(x.endswith(e) for x in distinct) for e in ends if len(e) == n)
        assert sorted(model.n[(model.h & 15) == t.ORDERS.index(n)].tolist()) == want


def test_small_model(spark):
    """With fewer suffixes than there are, the rarer ones are left to their shorter suffixes; the result stays near."""
    rng = random.Random(12)
    rows = corpus(rng, 2000)
    df = spark.createDataFrame([(i, x, "en", "s") for i, (x, _) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.key: r.cut for r in scores(df, "doc_id", "text", "lang", "source", contexts=1500).collect()}
    hit = sum(got[i] and c for i, (_, c) in enumerate(rows))
    assert hit / sum(c for _, c in rows) > 0.8 and hit / sum(got.values()) > 0.9


def test_model():
    m = Model(np.array([16, 32, 33]), np.array([10, 5, 4]), np.array([1.0, 5.0, 2.0]))
    less = m.without(np.array([33, 48, 16]), np.array([1, 9, 2]))
    assert less.n.tolist() == [8, 5, 3] and less.e.tolist() == [-1.0, 5.0, 1.0] and m.n.tolist() == [10, 5, 4]


def test_most_texts_cut(spark):
    """A language in which most texts are cut has a threshold of its own."""
    rng = random.Random(4)
    whole, parts = corpus(rng, 2500), []
    while len(parts) < 900:
        text = " ".join(sentence(rng) + "." for _ in range(3))
        at = rng.randint(30, len(text) - 5)
        if text[at - 1].isalpha() and text[at].isalpha():
            parts.append((text[:at], True))
    rows = [(x, c, "en") for x, c in whole] + [(x, c, "xx") for x, c in parts] + [(" ".join(sentence(rng) + "." for _ in range(2)), False, "xx") for _ in range(100)]
    df = spark.createDataFrame([(i, x, lang, "s") for i, (x, _, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    found = scores(df, "doc_id", "text", "lang", "source").collect()
    assert len({(r.lang, r.threshold) for r in found}) == 2 and {r.threshold < 0 for r in found if r.lang == "xx"} == {True}
    got = {r.key: r.cut for r in found}
    assert sum(got[i] for i, (_, c, lang) in enumerate(rows) if lang == "xx" and c) > 0.95 * 900
    assert sum(got[i] for i, (_, c, lang) in enumerate(rows) if lang == "xx" and not c) < 10


def test_prior():
    hist = [(-3.0, float("-inf"), 950), (20.0, float("-inf"), 50)]
    assert abs(learn_prior(hist) - 0.05) < 0.01


def test_long_runs_take_one_pass():
    import time

    began = time.time()
    for run in (".", " ", "…", "&", "(", "。", "[", ":", "1", ". "):
        Prepared(["A" + run * 200_000 + "b"])
        Prepared(["A" + run * 20_000])
    assert time.time() - began < 20


def test_repeated_texts_and_clashing_columns(spark):
    """A text that makes up most of the rows counts once as an end; columns called as the operator's own do not matter."""
    rng = random.Random(5)
    rows = corpus(rng, 500) + [("The student sends the", True)] * 800 + [("The museum opens the plan in spring.", False)] * 300
    df = spark.createDataFrame([(i, x, "en", "s", 1, 2, "c") for i, (x, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, key int, h int, cut string")
    got = {r.key: r.cut for r in scores(df, "doc_id", "text", "lang", "source").collect()}
    assert len(got) == len(rows) and all(got[i] for i in range(500, 1300)) and not any(got[i] for i in range(1300, 1600))


def test_any_size_of_model(spark):
    """Scores do not depend on how many suffixes are held or counted at once: the model as a table, counted in passes, hot keys spread."""
    from phylospark.llm import truncation as t

    rng = random.Random(8)
    rows = corpus(rng, 500) + [("The student sends the", True)] * 60 + corpus(rng, 100, 90)
    ddl = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame([(i % 600, x, "xx" if i % 3 else "en", "s") for i, (x, _) in enumerate(rows)], ddl).repartition(3)
    held, joined = (sorted((r.key, r.lang, r.cut, round(r.context, 4), round(r.threshold, 4)) for r in scores(df, "doc_id", "text", "lang", "source", contexts=n).collect()) for n in (t.CONTEXTS, 50))
    assert len(held) == len(rows) and held == joined

    values = finals(df, "doc_id", "text", "lang", "source")
    model, none = t.trained(df, "text", values)
    assert none is None
    for contexts, block in ((len(model.h), 1500), (len(model.h) - 1, 10**9)):
        short, table = t.trained(df, "text", values, contexts, block)
        got = short if table is None else t._held(table)
        assert np.array_equal(got.h, model.h) and np.array_equal(got.n, model.n) and np.allclose(got.e, model.e) and abs(short.base - model.base) < 1e-6
    rows = values.withColumn("cut", F.col("key") % 7 == 0)
    want = sorted((r.key, r.text_hash, round(r.context, 4)) for r in t.with_scores(rows, model).collect())
    for hot in (10**9, 10):
        assert sorted((r.key, r.text_hash, round(r.context, 4)) for r in t.with_joined_scores(rows, table, short.base, hot).collect()) == want
