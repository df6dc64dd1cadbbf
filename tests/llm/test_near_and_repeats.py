import collections
import hashlib

import numpy as np
import pytest
from conftest import base_text, shingles, words  # noqa: F401  (tests/llm/conftest.py)

from studyloom.llm import minhash, repeats, tables
from studyloom.llm.tables import components


def plain_components(rows, percent=75):
    sets = collections.defaultdict(list)
    for i, text, _ in rows:
        if i is not None and shingles(text):
            sets[i].append(shingles(text))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(100 * len(s & t) >= percent * len(s | t) for s in sets[x] for t in sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_near(make, rows):
    got = minhash.near_duplicates(make(rows)).collect()
    want = plain_components(rows)
    assert len(got) == len(rows)
    sizes = collections.Counter((i, len(shingles(x))) for i, x, _ in rows)
    assert sizes == collections.Counter((r.doc_id, r.n_shingles) for r in got)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.n_shingles:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert (r.component_id, r.kept) == (r.doc_id, True)


def test_near_duplicates_odd_rows(make, odd):
    check_near(make, odd)


def test_near_duplicates_of_copies_of_copies(make):
    """A chain of ever more edited copies, hot exact copies, and a group just below the threshold."""
    rows, text = [], base_text(5, 150).split()
    for i in range(60):
        rows.append((i, " ".join(text), "en"))
        text = text[:]
        text[(i * 37) % 150] = f"edit{i}"
    rows += [(100 + i, base_text(6, 80), "en") for i in range(150)]
    common = base_text(7, 60)
    rows += [(400 + i, common + " " + base_text(50 + i, 25), "en") for i in range(60)]
    check_near(make, rows)


def test_near_duplicates_of_nothing(make, odd):
    assert minhash.near_duplicates(make(odd[:1]).limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    n = 200
    path = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, n)] + [(1000, 1000)]
    got = dict(components(spark.createDataFrame(path + star, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n)}}


def test_registers_estimate_jaccard():
    random = np.random.default_rng(3)
    pool = np.sort(random.integers(0, 2**63, 6000).astype(np.uint64) * np.uint64(2))
    x, y = np.sort(pool[:4800]), np.sort(pool[1200:])
    flat = np.concatenate([x, y])
    codes = minhash.registers(flat, np.repeat([0, 1], [len(x), len(y)]), 2)
    equal = np.array([(codes[0] == codes[1]).sum()])
    guess = minhash.estimate(equal, np.array([4800]), np.array([4800]))[0]
    assert abs(guess - 3600 / 6000) < 0.15


def plain_removal(rows, length=50):
    first = {}
    for i, text, _ in rows:
        w = words(text)
        for s in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text, _ in rows:
        w = words(text)
        keep = [True] * len(w)
        for s in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[s : s + length])] < i:
                keep[s : s + length] = [False] * length
        left = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return collections.Counter(out)


def check_removal(make, rows):
    got = repeats.removal_report(make(rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_removal(rows)


def test_repeats_odd_rows(make, odd):
    check_removal(make, odd)


def test_repeats_of_shifted_and_mixed_passages(make):
    """Passages that meet others than the anchor's first occurrence, in hundreds of documents."""
    parts = [base_text(100 + i, 55) for i in range(6)]
    rows = []
    for i in range(120):
        chosen = [parts[(i * 5 + j) % 6] for j in range(i % 4)]
        rows.append((1000 - i, " ".join([base_text(500 + i, i % 60), *chosen, base_text(700 + i, 30)]), "en"))
    rows += [(5, parts[0][10:] + " " + parts[1][: len(parts[1]) // 2], "en"), (2, " ".join(["rep"] * 70), "en"), (9, " ".join(["rep"] * 51), "en")]
    check_removal(make, rows)


def test_repeats_of_nothing(make, odd):
    assert repeats.removal_report(make(odd[:1]).limit(0)).count() == 0


def test_cut_texts_keep_columns(make, odd):
    docs = make(odd)
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[0].text is None and by[1].text == "" and by[10].text == odd[6][1]
    assert 11 not in by and by[12].text.endswith("tail") and by[12].n_chars == len(by[12].text)


def near_copies(n):
    """n texts, each a template with two words of its own."""
    template, rows = base_text(77, 200).split(), []
    for i in range(n):
        text = template[:]
        for j in range(2):
            text[(i * 31 + j * 41) % 200] = f"own{i}x{j}"
        rows.append((i, " ".join(text), "en"))
    return rows


def test_pairs_grow_in_proportion_to_a_group(make, monkeypatch):
    handed = {}
    confirm = minhash.confirm

    def counted(pairs, docs, percent):
        handed[-1] = handed.get(-1, 0) + pairs.count()
        return confirm(pairs, docs, percent)

    monkeypatch.setattr(minhash, "confirm", counted)
    for n in (200, 800):
        handed[-1] = 0
        got = minhash.near_duplicates(make(near_copies(n)))
        assert got.where("kept").count() == 1
        handed[n] = handed[-1]
    assert handed[800] <= 4 * 1.3 * handed[200] and handed[800] <= 12 * 800


@pytest.mark.parametrize("together", [256, 2])
def test_a_common_line_sends_ranges_not_windows(make, monkeypatch, together):
    """A line of 14 words in otherwise different texts, and classes of texts that share more of its surroundings."""
    monkeypatch.setattr(repeats, "TOGETHER", together)
    line = base_text(91, 14)
    rows = [(i, f"{base_text(1000 + i, 45)} {line} {base_text(5000 + i, 45)}", "en") for i in range(150)]
    left, right = base_text(92, 40), base_text(93, 40)
    rows += [(200 + i, f"{base_text(2000 + i, 30)} {left} {line} {base_text(6000 + i, 30)}", "de") for i in range(4)]
    rows += [(300 + i, f"{base_text(3000 + i, 30)} {line} {right} {base_text(7000 + i, 30)}", "de") for i in range(4)]
    rows += [(400 + i, f"{left} {line} {right}", "de") for i in range(3)] + [(450, f"{left} other {line} {right}", "de")]
    written = []
    kept = repeats.kept

    def watched(df, label):
        out = kept(df, label)
        if label == "contexts":
            written.append(out.count())
        return out

    monkeypatch.setattr(repeats, "kept", watched)
    check_removal(make, rows)
    # every occurrence of an anchor goes out once, and few of them once more
    assert sum(written[1:]) < written[0]


def test_the_corpus_is_moved_once_for_confirmations(spark, monkeypatch):
    near = [" ".join(f"w{i}" for i in range(n, n + 60)) for n in (0, 1, 2)]
    rows = [(i, text) for i, text in enumerate(near)] + [(i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, plain = [], minhash.texts_of
    monkeypatch.setattr(minhash, "texts_of", lambda docs, ids: whole.append(docs.count()) or plain(docs, ids))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: 0 if i < 3 else i for i in range(40)}
    assert whole[0] == 40 and len(whole) > 1 and all(n == 3 for n in whole[1:])


@pytest.mark.parametrize("most", [27, 10])
def test_a_sieve_holds_every_key(make, spark, monkeypatch, most):
    """Also with more keys than bits, with nulls and repeats."""
    monkeypatch.setattr(tables, "MOST_BITS", most)
    docs = make([(i - 3000, "t", "en") for i in range(9000)] + [(5, "u", "en"), (None, "t", "en"), (2**62, "t", "en"), (-(2**63), "t", "en")])
    ids = [*range(-3000, 6000, 3), 5, 5, 2**62, -(2**63)]
    keys = tables.kept(spark.createDataFrame([(i,) for i in [*ids, None]], "key long"), "keys")
    for column in ("doc_id", "id"):
        out = tables.sieved(docs, column, keys)
        assert out.columns == docs.columns
    left = collections.Counter(tuple(r) for r in tables.sieved(docs, "doc_id", keys).collect())
    rows = collections.Counter(tuple(r) for r in docs.collect())
    assert not left - rows
    others = {r for r in rows if r[0] is not None and r[0] not in ids}
    assert all(left[r] == n for r, n in rows.items() if r[0] in ids)
    assert most < 27 or sum(left[r] for r in others) < len(others) / 8
    assert tables.sieved(docs, "doc_id", keys.limit(0)).count() == 0


def test_only_what_can_be_alike_is_moved(make, monkeypatch):
    """Of 300 texts, 3 are alike: band keys, sketches and texts of the others stay out of the joins."""
    near = [" ".join(f"w{i}" for i in range(n, n + 60)) for n in (0, 1, 2)]
    rows = [(i, text, "en") for i, text in enumerate(near)] + [(i, " ".join(f"x{i}y{j}" for j in range(30)), "en") for i in range(3, 300)]
    moved, plain = [], minhash.sieved

    def watched(df, column, keys):
        out = plain(df, column, keys)
        moved.append((column, df.count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "sieved", watched)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows)).collect()}
    assert found == {i: 0 if i < 3 else i for i in range(300)}
    (_, all_keys, keys), (_, all_texts, texts), (_, all_heads, heads) = moved[:3]
    assert (all_keys, all_texts, all_heads) == (300 * 32, 300, 300)
    assert keys < 300 and texts < 10 and heads < 10
