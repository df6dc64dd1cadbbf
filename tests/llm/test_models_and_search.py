import collections
import hashlib
import itertools
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import base_text, remainder, shingles, words  # noqa: F401
from pyspark.sql import functions as F

from studyloom.llm import fingerprints, langid, ngram, topk, urlfilter
from studyloom.llm.queries import remainder as remainder_column


# --- language ---------------------------------------------------------------------

SPEECH = {
    "en": "the and of that with this from have were they which their would there about into could other than then".split(),
    "de": "der die und nicht mit sich auch eine werden über können müssen schön größe straße zwischen während durch".split(),
    "fr": "le les des une dans qui avec être cette après même où été très façon élève français leçon pour pas".split(),
}


def speech(lang, n, seed):
    random = np.random.default_rng(seed)
    return " ".join(random.choice(SPEECH[lang], n))


def test_marginals_equal_a_sum_over_all_paths():
    random = np.random.default_rng(0)
    n, k = 6, 3
    scores, move, start = random.normal(size=(n, k)), random.normal(size=(k, k)), random.normal(size=k)
    want = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = math.exp(start[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            want[t, y] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(langid.marginals(scores, np.array([0, n]), move, start), want, atol=1e-5)


def test_blocks_equal_one_walk():
    random = np.random.default_rng(1)
    sizes = [5, 0, 64, 65, 200, 1, 129]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores, move, start = random.normal(size=(first[-1], 4)) * 2, random.normal(size=(4, 4)), random.normal(size=4)
    solid = np.concatenate([[0], np.cumsum([s for s in sizes if s])])
    want, _ = langid._pair_marginals(scores, solid, langid.Model([], None, move, start))
    assert np.allclose(langid.marginals(scores, first, move, start), want, atol=1e-4)


def test_code_switched_words_and_held_out_accuracy():
    texts = [speech(x, 80, i) for i in range(30) for x in SPEECH]
    model = langid.train(texts, [x for _ in range(30) for x in SPEECH])
    held = [(x, speech(x, 25, 500 + i)) for i in range(40) for x in SPEECH]
    names, share = langid.classify(pa.array([t for _, t in held]), model)
    assert (names == np.array([x for x, _ in held])).mean() >= 0.98 and share.min() >= 0
    mixed = speech("en", 30, 900) + " " + speech("fr", 30, 901)
    _, own = langid.word_labels(pa.array([mixed]), model)
    label = [model.labels[i] for i in own.argmax(axis=1)]
    assert label.count("en") >= 27 and label[:30].count("en") >= 27 and label[30:].count("fr") >= 27
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_language_of_odd_rows(make, odd):
    rows = odd + [(1000 + i, speech(x, 30, i), x) for i, x in enumerate(list(SPEECH) * 20)]
    got = langid.predict(make(rows), remainder_column(4) != 2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (0, 1, 2, 21):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    known = {x for _, _, x in rows if x}
    assert all(r.lang_pred in known | {"und"} and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id and r.doc_id >= 1000 and remainder(r.doc_id, 4) == 2]
    right = [r for r in held if r.lang_pred == list(SPEECH)[(r.doc_id - 1000) % 3]]
    assert len(right) >= 0.9 * len(held)
    nothing = langid.predict(make(rows).limit(0), F.lit(True))
    assert nothing.count() == 0
    unlearned = langid.predict(make(rows), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_prediction_reads_text_only(make):
    rows = [(i, speech(x, 30, i), x) for i, x in enumerate(list(SPEECH) * 20)]
    one = {r.doc_id: r.score for r in langid.predict(make(rows), remainder_column(4) != 2).collect()}
    other = [(i, x, y if remainder(i, 4) != 2 else None) for i, x, y in rows]
    assert one == {r.doc_id: r.score for r in langid.predict(make(other), remainder_column(4) != 2).collect()}


# --- fingerprints -------------------------------------------------------------------


def plain_next(rows):
    order = sorted(((i, x or "") for i, x in rows if i is not None), key=lambda r: (-r[0], r[1]))
    return [(i, x, order[(n + 1) % len(order)][1]) for n, (i, x) in enumerate(order)]


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@pytest.mark.parametrize("span", [1024, 3])
def test_fingerprints(make, odd, span, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", span)
    monkeypatch.setattr(fingerprints, "GROUP", 2)
    rows = odd + [(10**12, "far away", None)] + [(500 + i, base_text(40 + i, 150), "en") for i in range(30)]
    got = fingerprints.edited_likeness(make(rows)).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, x, following in plain_next([(i, x) for i, x, _ in rows]):
        want[i, len(x), hashlib.sha256(edited(x, following).encode()).hexdigest()] += 1
    for i, x, _ in rows:
        if i is None:
            want[None, len(x or ""), hashlib.sha256(edited(x or "", "").encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[10].fingerprint == by[11].fingerprint and by[1].fingerprint == by[0].fingerprint == by[2].fingerprint == ""
    assert by[11].near_next == 1.0  # the same text follows
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    nexts = {i: y for i, _, y in plain_next([(i, x) for i, x, _ in rows])}
    for i in range(500, 530):
        a, b = shingles(base_text(40 + i - 500, 150)), shingles(edited(base_text(40 + i - 500, 150), nexts[i]))
        assert abs(by[i].near_edited - len(a & b) / len(a | b)) < 0.25
    assert fingerprints.edited_likeness(make(rows).limit(0)).count() == 0


def test_ranges_hold_about_as_many_documents_wherever_ids_lie(make, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 4)
    monkeypatch.setattr(fingerprints, "GROUP", 2)
    ids = [*range(60), *range(10**6, 10**6 + 30), *(3 * 10**9 + 7 * i for i in range(30)), -5, 10**12]
    rows = [(i, f"text {i}", None) for i in ids]
    got = fingerprints.with_next(make(rows).select("doc_id", "text")).where("NOT tail").collect()
    assert max(collections.Counter(r.r for r in got).values()) <= 8
    assert {(r.doc_id, r.next_text) for r in got} == {(i, y) for i, _, y in plain_next([(i, x) for i, x, _ in rows])}
    same = [(7, f"text {i}", None) for i in range(20)]  # one id is never cut
    got = fingerprints.with_next(make(rows + same).select("doc_id", "text")).where("NOT tail").collect()
    assert sorted((r.doc_id, r.text, r.next_text) for r in got) == sorted(plain_next([(i, x) for i, x, _ in rows + same]))


# --- top k --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=8).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)]  # one vector for a third of all
    rows += [(400, None), (420, []), (440, [float("nan")] * 8), (441, [None] + [0.0] * 7), (460, [1.0]), (480, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(20, [0.5] * 8), (7, [0.1] * 8), (500, [9e4] * 8), (501, [-9e4] * 8)]
    return [(i, v, "x", 1) for i, v in rows]


@pytest.mark.parametrize("block, k", [(8192, 20), (16, 20), (16, 1), (64, 500)])
def test_top_k_against_brute_force(spark, vectors, block, k, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", block)
    monkeypatch.setattr(topk, "QUERIES", block)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, q string, low int")
    rows = topk.quantised(df)
    got = sorted(tuple(r) for r in topk.nearest(rows, rows.where("vec_id % 20 = 0"), k).collect())
    good = [
        (i, [math.floor(64 * x) for x in v]) for i, v, *_ in vectors
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in good:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = []
    for q, v in queries.items():
        found = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in good if i != q)[:k]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)


def test_top_k_of_nothing(spark, vectors):
    rows = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, q string, low int"))
    assert topk.nearest(rows.limit(0), rows.limit(0), 3).count() == 0
    assert topk.nearest(rows, rows.where("vec_id = -1"), 3).count() == 0


# --- language model -----------------------------------------------------------------


def test_elias_fano_finds_what_is_there():
    random = np.random.default_rng(1)
    for values in (
        np.unique(random.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)), np.unique(random.integers(0, 9000, 5000)).astype(np.uint64),
        np.arange(300, dtype=np.uint64), np.array([0], dtype=np.uint64), np.array([2**64 - 1], dtype=np.uint64), np.zeros(0, dtype=np.uint64),
    ):
        keys = np.concatenate([values, values + np.uint64(1), np.array([0, 5, 2**64 - 1], dtype=np.uint64)])
        there = {int(v): i for i, v in enumerate(values)}
        assert ngram.EliasFano.of(values).find(keys).tolist() == [there.get(int(x), -1) for x in keys]


@pytest.mark.parametrize("hot, shard", [(1000, 5_000_000), (20, 300)])
def test_scores_equal_a_plain_model(make, odd, hot, shard, monkeypatch):
    monkeypatch.setattr(ngram, "HOT", hot)
    monkeypatch.setattr(ngram, "SHARD_TOKENS", shard)
    rows = odd + [(50 + i, base_text(i % 7, 40 + i), "en") for i in range(40)]
    weights, fit = [], ngram.fit_weight
    monkeypatch.setattr(ngram, "fit_weight", lambda *args: weights.append(fit(*args)) or weights[-1])
    got = ngram.score(make(rows), remainder_column(7) == 2).collect()
    assert len(got) == len(rows)
    one, two, ends = collections.Counter(), collections.Counter(), 0
    for i, x, _ in rows:
        if i is not None and remainder(i, 7) != 2:
            w = [*words(x, lower=True), "end"]
            one.update(w)
            two.update(zip(["start", *w], w))
            ends += 1
    n, v, k = sum(one.values()), len(one), weights[0]

    def left_out(k):
        joint = sum(c * math.log(c - 1 + k * one[b] / (n + v)) for (_, b), c in two.items())
        contexts = collections.Counter({**one, "start": ends})
        del contexts["end"]
        return joint - sum(c * math.log(c - 1 + k) for c in contexts.values())

    best = max(ngram.WEIGHTS, key=left_out)
    assert k == best if shard > n else best / 8 <= k <= best * 8  # all words, or those of four shards
    want = collections.defaultdict(list)
    for i, x, _ in rows:
        w = [*words(x, lower=True), "end"]
        base = sum(math.log10((one[t] + 1) / (n + v + 1)) for t in w)
        score = sum(
            math.log10((two[a, b] + k * (one[b] + 1) / (n + v + 1)) / ((ends if a == "start" else one[a]) + k)) for a, b in zip(["start", *w], w)
        )
        want[i].append((len(w), sum(one[t] > 0 for t in w), base, score))
    for r in got:
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and remainder(r.doc_id, 7) == 2)
        assert any(
            (r.n_tokens, r.n_known) == (a, b) and abs(r.base_score - c) < 1e-6 * a and abs(r.score - d) < 1e-3 * a for a, b, c, d in want[r.doc_id]
        )
    assert ngram.score(make(rows).limit(0), remainder_column(7) == 2).count() == 0
    assert {r.n_known for r in ngram.score(make(rows), F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_the_weight_is_that_of_all_training_texts(make, seed, monkeypatch):
    """However the words are dealt over shards."""
    rows = [(i, base_text(10 * seed + i % (seed + 2), 3 + 5 * (i % 4)), "en") for i in range(24)]
    fit, weights = ngram.fit_weight, []
    monkeypatch.setattr(ngram, "fit_weight", lambda *args: weights.append(fit(*args)) or weights[-1])
    for size in (1_000_000, 5):
        monkeypatch.setattr(ngram, "SHARD_TOKENS", size)
        ngram.score(make(rows), F.lit(False)).count()
    assert weights[0] == weights[1]


# --- urls ---------------------------------------------------------------------------

CANONICAL = '<LINK href="%s" rel=canonical>'
REFRESH = "<meta content='0; url=%s' http-equiv=refresh>"


def test_urls(spark):
    rows = [
        (1, "http://A.example.net/x", CANONICAL % "http://b.info/y", "block", "net/"), (2, "https://b.info/y#top", "", "block", None),
        (3, "http://c.info/z?q=1", REFRESH % "http://b.info/y", "block", None), (4, "http://ok.example.net/en/1", CANONICAL % "//b2.info/y", "allow", "example.net/en/"),
        (5, "http://b2.info/y", CANONICAL % "http://u.net/", "allow", None), (6, "http://example.com/de/1", "", "block", "example.com/de/"),
        (7, "http://xexample.com/de/1", "", "allow", None), (8, None, None, "allow", None), (9, "nourl", CANONICAL % "http://u.net/", "allow", None),
        (10, "x://NET", "", "allow", None), (11, "http://q.org/fr/2?x=://net/", "", "allow", "org/fr/"), (12, "a://b://c/d", "", "allow", None),
        (13, "http://lone.info/a/b", CANONICAL % "c", "allow", None), (1, "http://A.example.net/x", None, "block", "net/"),
        (14, "http://lone.info/a/c", CANONICAL % "/k", "allow", None), (None, "http://p.net/", "", "block", "net/"), (15, "", "", "allow", None),
    ]
    rows += [(100 + i, f"http://chain.info/{i}", CANONICAL % f"/{i + 1}", "block", None) for i in range(40)]
    rows += [(140, "http://chain.info/40", REFRESH % "http://w.net/", "block", None)]
    df = spark.createDataFrame([(*r[:3], 1, "c") for r in rows], "page_id long, url string, html string, id int, component string")
    got = urlfilter.judge(df).collect()
    assert collections.Counter((r.page_id, r.verdict, r.rule) for r in got) == collections.Counter((r[0], r[3], r[4]) for r in rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path) == ("a.example.net", "/x") and (by[12].host, by[12].path) == ("b:", "//c/d")
    assert (by[8].host, by[8].path, by[9].host) == ("", "", "") and by[13].alias_group == by[14].alias_group
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_urls_with_quoted_targets_and_mixed_case(spark):
    rows = [
        (1, "http://a.info/", "<meta http-equiv=refresh content=\"0; url='http://b.net/'\">", "block"),
        (2, "http://c.info/", "<meta http-equiv=refresh content='0; URL = \"http://d.net/\"'>", "block"),
        (3, "http://e.info/", "<link rel=cAnOnIcAl href=http://f.net/>", "block"),
        (4, "http://g.info/", "<Meta Http-Equiv=\"ReFresh\" content=\"5;url=http://h.info/\">", "allow"),
        (5, "http://i.info/", "<meta http-equiv=refresh content=\"0; url=''\">", "allow"),
    ]
    got = urlfilter.judge(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == {r[0]: r[3] for r in rows}
    assert {r.page_id for r in got if r.alias_group is not None} == {1, 2, 3, 4}


def test_urls_with_several_links(spark):
    two = CANONICAL % "http://b.info/y" + CANONICAL % "http://c.net/"
    rows = [
        (1, "http://a.info/1", two, "block"), (2, "http://a.info/2", "<link rel='shortcut canonical' href='http://d.net/'>", "block"),
        (3, "http://a.info/3", f"<!-- {CANONICAL % 'http://e.net/'} -->", "allow"), (4, "http://a.info/4", "<!-- open " + CANONICAL % "http://e.net/", "allow"),
        (5, "http://a.info/5", '<link rel="non-canonical" href="http://f.net/">', "allow"), (6, "http://b.info/y", "", "block"),
        (7, "http://a.info/7", REFRESH % "http://g.info/" + REFRESH % "http://h.net/", "block"), (8, "http://g.info/", "", "block"),
    ]
    got = urlfilter.judge(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == {r[0]: r[3] for r in rows}


def test_products_beyond_64_bits_are_an_error(spark):
    rows = spark.createDataFrame([(1, [3_000_000_000, 3_000_000_000]), (20, [3_000_000_000, 3_000_000_000])], "vec_id long, v array<long>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.nearest(rows, rows.where("vec_id = 20"), 5)


def test_ids_at_both_ends(make):
    rows = [(-(2**63), "a b c d e f", "en"), (2**63 - 1, "a b c d e g", "en"), (0, "x", "de"), (5, None, None)]
    got = fingerprints.edited_likeness(make(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {r.doc_id: r.edited_sha256 for r in got}
    for i, text, following in ((2**63 - 1, "a b c d e g", ""), (0, "x", "a b c d e f"), (-(2**63), "a b c d e f", "a b c d e g")):
        assert by[i] == hashlib.sha256(edited(text, following).encode()).hexdigest()


def test_the_sample_holds_different_texts(make):
    hot = [(i, "der eine text " * 3, "de") for i in range(900)]
    rows = hot + [(1000 + i, base_text(i, 12), "de") for i in range(1800)]
    texts = [r.text for r in langid.sample(make(rows)).collect()]
    assert len(texts) == langid.SAMPLE and len(set(texts)) == len(texts)


def test_tokens_hold_little_besides_their_hashes():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 50_000, 1500)) for _ in range(400)]
    column = pa.array(["", *texts, "x" * 600_000 + " Y", " \n"])
    tracemalloc.start()
    hashes, first = ngram.tokens(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * column.nbytes
    alone = [ngram.tokens(column.slice(i, 1))[0] for i in range(len(column))]
    assert np.array_equal(hashes, np.concatenate(alone)) and np.diff(first).tolist() == [len(x) for x in alone]
    assert [len(x) for x in ngram.tokens(pa.array([], pa.string()))] == [0, 1]
