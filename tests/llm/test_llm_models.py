"""Learned operators, mixing, surrogates and the pipeline."""

import collections
import functools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from srclens.llm import context_tree, language_id, mixing, pii, quality
from srclens.llm import queries as Q
from srclens.llm.common import fold

SMALL = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in Q.op5_language(spark, SMALL).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)


def test_language_odd(odd, none):
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, odd, ["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (9, "fr")} <= got
    assert {r.lang_pred for r in language_id.identify(odd, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(none, odd, ["doc_id"]).count() == 0


def test_quality_held_out(spark, odd, none):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [r for r in Q.op1_quality(spark, SMALL).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.97
    labels = spark.createDataFrame([(2, 1), (5, 0)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score_quality(none, labels.limit(0)).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 2, 1, 0, 3.0]), np.array([2, 2, 2, 1, 3.0]))
    assert np.all(np.diff(y) > 0) and y[0] == 0 and y[-1] == 1 and np.isclose(y[1], 3 / 5)


def test_context_tree(spark, odd, none):
    docs = spark.createDataFrame([(i, "the cat the dog the cat" if i % 7 else "the cow") for i in range(40)], "doc_id long, text string")
    held = fold(F.col("doc_id"), 7) == 2
    rows = docs.withColumn("h", held).collect()
    c = collections.Counter(w for r in rows if not r.h for w in [*r.text.split(), "end"])
    n, v = sum(c.values()), len(c)
    for r in context_tree.score(docs, held).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*text.split(), "end"])
        assert abs(base - r.base_score) < 1e-9 and r.train_tokens == n and r.n_tokens == len(text.split()) + 1 and r.score < 0
        assert r.n_known == sum(c[w] > 0 for w in [*text.split(), "end"])
    got = {r.doc_id: r for r in context_tree.score(odd, held).collect()}
    assert got[1].n_tokens == 1 and got[8].n_tokens == 4001 and context_tree.score(none, held).count() == 0


def test_tree_is_a_distribution(monkeypatch):
    monkeypatch.setattr(context_tree, "DEPTH", 2)
    rng = np.random.RandomState(0)
    seen = (rng.randint(97, 100, 50) << 16) | (rng.randint(97, 100, 50) << 8)
    gram = np.concatenate([np.unique(seen)[:, None] + np.arange(256)]).ravel()
    n = np.where(rng.rand(len(gram)) < 0.02, rng.randint(1, 9, len(gram)), 0).astype(float)
    _, _, p, rest = context_tree.subtree(gram, n, 2, 2)
    one = p + rest * 0.5
    lp = np.where(context_tree.BITS[gram & 255] == 1, one, 1 - one).prod(1)
    assert np.allclose(np.bincount(np.unique(gram >> 8, return_inverse=True)[1], lp), 1)


def test_mixing(spark, odd, none):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.mix(d).collect()
    size, target, taken = {}, {}, collections.Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r.taken in range(0, 3 * r["size"] + 1)
        size[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3 and all(t <= 3 * size[s] + 1e-6 for s, t in target.items())
    assert all(abs(taken[s] - t) < 0.05 * t for s, t in target.items())
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect()) == sorted((r.doc_id, r.taken) for r in got)
    # words per source 10, 100, 1000 with weights 1, 2, 3: the first two stop at three times their size
    t = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size long")
    assert {r.source: round(r.target, 6) for r in mixing.targets(t).collect()} == {"a": 30, "b": 300, None: 780}
    assert len(mixing.mix(odd).collect()) == 10 and mixing.mix(none).count() == 0


def test_surrogates(spark, odd, none):
    text = ('Mr. John Smith <j.smith@corp.example.org>, J.SMITH@CORP.EXAMPLE.ORG, +1 (248) 555-6359 or +1 248 555 6359, 10.20.30.40, 4111 1111 1111 1111, 078-05-1120, '
            'password=f8cb0ab732d29a210e, Frau Anna Schmidt. Version 2.0.')
    rows = [(1, text, 3), (2, "Mr. John Smith again, j.smith@corp.example.org; 4111111111111111", 3), (3, "nothing 123 here 2.0", 3)]
    rows += [(10 + i, f"10.0.{i // 250}.{i % 250 + 1}", 3) for i in range(600)]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    one = got[1].text
    for gone in ("John", "Smith", "smith", "SMITH", "248) 555", "10.20.30.40", "4111 1111", "078-05", "f8cb0", "Anna", "Schmidt"):
        assert gone not in one
    assert one.startswith("Mr. ") and one.endswith("Version 2.0.") and got[3].text == rows[2][1] and got[3].n_chars == 3
    mails = re.findall(r"[\w.]+@[\w.]+\w", one)
    assert mails[0].upper() == mails[1] and mails[0] in got[2].text and mails[0].endswith(".org")
    phones = re.findall(r"\+1[ (]+(\d{3})\)? (\d{3})[- ](\d{4})", one)
    assert phones[0] == phones[1]
    card = re.search(r"(\d{4}) (\d{4}) (\d{4}) (\d{4})", one)
    assert "".join(card.groups()) in got[2].text and card.group(1)[0] == "4"
    digits = [int(x) for x in "".join(card.groups())][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    assert len({got[10 + i].text for i in range(600)}) == 600 and got[1].n_chars == len(one)
    name = re.match(r"Mr\. (\S+) (\S+) <", one)
    assert name.group(1) in pii.GIVEN["latin"]["m"] and f"Mr. {name.group(1)} {name.group(2)} again" in got[2].text
    same = pii.replace_pii(odd)
    assert set(odd.columns) < set(same.columns) and {r.doc_id: r.text for r in same.collect()} == {r.doc_id: r.text for r in odd.collect()}
    assert pii.replace_pii(none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    junk = spark.createDataFrame([(5000, "12 34 !!", None, "src1", 8), (5001, None, "en", None, 0)], docs.schema)
    docs = docs.limit(300).union(junk)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, docs, SMALL), f"test-{name}")
        assert out.columns == columns
        if name == "language":
            assert out.count() == docs.count() - 2
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def _plain_bits(train, text, depth=5):
    """Bits of the running text under context-tree weighting, by recursion over the nodes."""
    def decisions(t):
        run = " " * depth + "".join(w + " " for w in t.split()) + "\n"
        for i in range(depth, len(run)):
            for k in range(8):
                yield run[i - depth:i], 1 << k | ord(run[i]) >> (8 - k), ord(run[i]) >> (7 - k) & 1
    counts, below = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for t in train:
        for ctx, node, bit in decisions(t):
            for d in range(depth + 1):
                counts[ctx[depth - d:], node][bit] += 1
                if d:
                    below[ctx[depth - d + 1:], node].add(ctx[depth - d:])

    @functools.cache
    def weight(ctx, node):
        a, b = counts[ctx, node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        return (own, own) if len(ctx) == depth else (own, np.logaddexp(own, sum(weight(c, node)[1] for c in below[ctx, node])) - math.log(2))
    bits = 0.0
    for ctx, node, bit in decisions(text):
        p, rest, est = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            s = ctx[depth - d:]
            if (s, node) not in counts:
                break
            est = (counts[s, node][1] + 0.5) / (sum(counts[s, node]) + 1)
            own, w = weight(s, node)
            lam = 1.0 if d == depth else math.exp(own - math.log(2) - w)
            p, rest = p + rest * lam * est, rest * (1 - lam)
        p += rest * est
        bits -= math.log2(p if bit else 1 - p)
    return bits


def test_context_tree_reads_across_words(spark, monkeypatch):
    learn = ["the red cat sat on the mat", "a red cat ran on the road", "the dog sat on the red mat"]
    asked = ["the red cat sat on the road", "road the on sat cat red the", "a zebra"]
    docs = spark.createDataFrame([(i, t, i >= 3) for i, t in enumerate(learn + asked)], "doc_id long, text string, held boolean")
    for top in (1 << 20, 0):  # all six bytes sent to the tasks, or all joined
        monkeypatch.setattr(context_tree, "GRAMS", top)
        got = {r.doc_id: r for r in context_tree.score(docs, F.col("held")).collect()}
        for i, t in enumerate(asked):
            r, want = got[3 + i], _plain_bits(learn, t)
            assert r.n_bytes == len(t) + 2 and np.isclose(r.bits_per_byte, want / r.n_bytes, rtol=1e-6) and np.isclose(-r.score * np.log2(10), want, rtol=1e-6)
        assert got[3].score > got[4].score + 3


def test_repeated_rows_are_cut_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(None, "copy of some words", "a")] * 300 + [(i, "w " * (1 + i % 5), "a") for i in range(200)]
    rows += [(1000 + i, "other words", "b") for i in range(700)]
    rows += [(5000, "same id " * 4, "c")] * 300
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    copies = {r.epochs for r in got if r.source == "c"}
    assert len(copies) == 2 and max(copies) - min(copies) == 1


def test_language_stage_rejects_by_score(spark):
    rng = np.random.RandomState(6)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    noise = [" ".join("".join(rng.choice(list("qxzjkvwpbg"), 7)) for _ in range(40)) for _ in range(20)]
    junk = spark.createDataFrame([(90000 + i, x, None, "src1", len(x)) for i, x in enumerate(noise)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(junk), SMALL).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert clean <= kept and not [i for i in kept if i >= 90000]


def test_language_bounds_come_from_every_training_document(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["en", "de", None]), rng.randrange(0, 32, 5), rng.choice(["en", "de", "und"]), round(rng.random(), rng.choice([2, 9]))) for i in range(30_000)]
    scored = spark.createDataFrame(rows, "doc_id int, lang string, __size int, __lang string, __score double")
    got = {(r["__lang"], r["__size"]): r.least for r in corpus_pipeline.score_bounds(scored, F.col("doc_id") % 3 == 1).collect()}
    want = collections.defaultdict(list)
    for i, lang, size, pred, score in rows:
        if i % 3 != 1 and lang == pred:
            for k in range(size, min(size + corpus_pipeline.NEAR, corpus_pipeline.SIZES - 1) + 1):
                want[pred, k].append(score)
    assert got.keys() == want.keys() and max(map(len, want.values())) > 300
    assert all(abs(got[k] - np.quantile(v, 0.001) / 2) < 1e-12 for k, v in want.items())
