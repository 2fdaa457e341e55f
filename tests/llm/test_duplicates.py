import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from cubitgrid.llm import cells, embeddings, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(n, links):
    at = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            if (at[a], at[b]) != (m, m):
                at[a] = at[b] = m
                changed = True
    return at


def near_rows():
    """Chains of edits around the threshold, copies, and texts that share a passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            for _ in range(rng.randint(0, 3)):
                base = [*base]
                base[rng.randrange(len(base))] = word()
            rows.append(" ".join(base))
    rows += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(30)]
    rows += [rows[0].upper()] * 5
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def check_documents(rows, got):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) or rows[a][0] == rows[b][0] is not None]
    root, groups = roots(len(rows), links), defaultdict(list)
    for k, r in enumerate(root):
        groups[r] += [rows[k][0]] if rows[k][0] is not None else []
    want = Counter()
    for k, (i, _) in enumerate(rows):
        c = min(groups[root[k]], default=None)
        want[i, len(sets[k]), c, i == c] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_minhash_against_brute_force(documents, odd):
    rows = near_rows() + odd + [(50, "A b"), (51, "a  B"), (52, "b a"), (53, "É x"), (54, "é x")]
    check_documents(rows, minhash.near_duplicates(documents(rows)))
    assert minhash.near_duplicates(documents([])).count() == 0


def large_group():
    """One group by sketches that holds copies of a template with edits from none to most of it, and ids with several texts."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(0, 120, 5), rng.choice([0, 1, 1, 1, 2, 2, 3, 4])):
            words[at] = f"x{rng.randrange(4)}"
        rows.append((k, " ".join(words)))
    return rows + [(0, " ".join(base[:110])), (0, ""), (7, " ".join(base[30:] + ["end"] * 5))]


def test_minhash_in_many_blocks(documents, monkeypatch):
    """Groups cut into blocks of a few rows give the same result."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    monkeypatch.setattr(cells, "LEAST_LARGE", 8)
    for rows in (near_rows(), large_group()):
        check_documents(rows, minhash.near_duplicates(documents(rows)))


def test_keep_first(documents, odd):
    docs = documents(odd)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 3000, dtype="uint64")
    sets = [np.unique(x[:1000]), np.unique(x[250:1250]), np.unique(x[:3]), np.unique(x[:1]), np.zeros(0, "uint64")]
    s = minhash.sketches(sets)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2 and (s[:4] != 0xFFFFFFFFFFFFFFFF).all()


def test_word_hashes_depend_on_words_alone():
    a, n = minhash.word_hashes([b"one two", b"", b"  TWO\tone "])
    assert n.tolist() == [2, 0, 2] and a[0] == a[3] and a[1] == a[2] and a[0] != a[1]


def test_forest():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    member, root = cells.forest(linked)
    assert dict(zip(member.tolist(), root.tolist(), strict=True)) == {3: 0, 5: 0, 2: 1}


def vector_rows():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = rng.standard_normal(48)
            for _ in range(rng.integers(1, 12)):
                rows.append((n, (base + rng.standard_normal(48) * rng.uniform(0, 0.4)).astype("float32").tolist(), label))
                n += 1
    rows += [(n + k, rows[0][1], 1) for k in range(4)] + [(n + 4, [2 * v for v in rows[0][1]], 1), (n + 5, rows[0][1], None), (n + 6, None, 1), (n + 7, [0.0] * 48, 1), (n + 8, [None] + [1.0] * 47, 1), (n + 9, [float("nan")] + [1.0] * 47, 1), (n + 10, [1.0, 2.0], 1), (n + 11, [1.0, 2.1], 1), (n + 12, [], 1), (n + 13, [float("inf")] * 48, 1)]
    return rows


def check_vectors(rows, got):
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = []
    for a, b in combinations(range(len(rows)), 2):
        (_, v, k), (_, w, m) = rows[a], rows[b]
        if k is not None and k == m and good(v) and good(w) and len(v) == len(w):
            x, y = np.float32(v).astype(float), np.float32(w).astype(float)
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links.append((a, b))
    degree = Counter(k for pair in links for k in pair)
    root = roots(len(rows), links)
    want = sorted((i, degree[k], rows[root[k]][0], i == rows[root[k]][0]) for k, (i, _, _) in enumerate(rows))
    assert sorted(map(tuple, got.collect())) == want and len(links) > 50


def test_embeddings_against_brute_force(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node int, hi string")
    check_vectors(rows, embeddings.near_duplicates(df))
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 4)
    check_vectors(rows, embeddings.near_duplicates(df))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_one_vector(spark):
    a, b, c, d = [1.0, 0.0, 0.1], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    schema = "vec_id bigint, embedding array<float>, label int"
    equal = spark.createDataFrame([(1, a, 1), (1, a, 1), (2, b, 1), (2, [2.0, 0.0, 0.0], 1), (3, c, 1)], schema)
    assert sorted(map(tuple, embeddings.near_duplicates(equal).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    # a vector that can't link gives way to one that can; one of two that can counts
    other = spark.createDataFrame([(1, None, 1), (1, a, 1), (2, b, 1), (3, a, 2), (3, c, 2), (4, b, 2), (5, d, 2), (None, b, 1), (None, b, 1)], schema)
    got = {r.vec_id: r for r in embeddings.near_duplicates(other).where("vec_id is not null").collect()}
    assert len(got) == 5 and got[1].n_links == got[2].n_links == 3 and got[3].n_links == 1 and got[4].n_links + got[5].n_links == 1
    assert embeddings.near_duplicates(other).where("vec_id is null").count() == 2


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    y = x + rng.standard_normal((300, 64)) * 0.38
    both = np.concatenate([x, y])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    can = embeddings.possible(*embeddings.encode(both), 0.93)
    true = both @ both.T >= 0.93
    np.fill_diagonal(true, False)
    assert true.sum() > 100 and not (true & ~can).any() and can.sum() < 0.05 * can.size


def test_plan_keeps_the_chance_of_a_miss():
    for n in (2, 1000, 10**7):
        bits, keys = embeddings.plan(n, 0.93)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** keys <= embeddings.MISS
