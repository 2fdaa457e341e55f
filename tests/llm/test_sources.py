"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cubitgrid.llm import divergence, infilling, mixing, oracles

DOCS = "doc_id bigint, text string, lang string, source string, term string, rank int, n bigint"


@pytest.fixture(scope="module")
def sourced(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, "x", 1, 7) for i, t, lang, s in rows], DOCS)

    return make


@pytest.fixture(scope="module")
def mixed_rows():
    """A source with most rows, tiny sources, a null and an empty one, texts of no words, repeated and null ids."""
    r = random.Random(5)
    words = ["ÉTÉ", "été", "Über", "a", "bb", "a1b", "x-y", "naïve", "слово", "😀", "the", "The"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randrange(0, 40)), r.choice(["en", "de"]), "big") for i in range(120)]
    rows += [(200 + i, text(r.randrange(0, 15)), r.choice(["en", "de"]), r.choice(["b", "a", "ä", None, ""])) for i in range(60)]
    rows += [(300, None, "en", "none"), (300, "", "en", "none"), (None, text(9), None, "b"), (None, text(9), None, None), (5, rows[5][1], rows[5][2], "big"), (301, "once only", "fr", "one"), (302, text(3000), "en", "long")]
    return rows


def plain_audit(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in seen if seen[t] >= least]
        counts = defaultdict(Counter)
        for _, s, terms in own:
            counts[s].update(t for t in terms if seen[t] >= least)
        total = Counter(t for c in counts.values() for t in c.elements())
        price = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: price(c) for s, c in counts.items()}, price(total)
        for s in counts:
            part = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            term = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for some, most in ((part, len(part)), (term, ranks)):
                for k, (name, item, value) in enumerate(sorted(some, key=lambda x: (-x[2], x[1].encode()))[:most]):
                    out.append((lang, s, name, item, value, k + 1))
    return sorted(out)


@pytest.mark.parametrize("held", [4, 300_000])
def test_divergence_is_that_of_whole_vocabularies(sourced, mixed_rows, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    got = divergence.audit(sourced(mixed_rows), term_ranks=5).collect()
    assert sorted(map(tuple, got)) == plain_audit(mixed_rows, ranks=5)
    assert [r for r in got if r.lang == "fr"] == [] and any(r.source == "none" and r.part == "pair" for r in got)


def test_divergence_without_kept_terms_and_rows(sourced):
    rows = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "c", "en", None)]
    assert sorted(map(tuple, divergence.audit(sourced(rows)).collect())) == plain_audit(rows)
    assert {r.value for r in divergence.audit(sourced(rows)).collect()} == {0}
    assert divergence.audit(sourced([])).count() == 0


def poured(sizes, weights):
    """Shares by rounds: what stands over three times a size is taken off and given to the others by weight."""
    got, full = [0.0] * len(sizes), set()
    for _ in range(len(sizes) + 1):
        rest = sum(sizes) - sum(3 * sizes[i] for i in full)
        open_ = sum(w for i, w in enumerate(weights) if i not in full)
        got = [3.0 * n if i in full else rest * weights[i] / open_ for i, n in enumerate(sizes)]
        more = {i for i, n in enumerate(sizes) if got[i] > 3 * n} - full
        if not more:
            break
        full |= more
    return got


def test_targets_settle_where_rounds_do():
    r = random.Random(3)
    for _ in range(300):
        sizes = [r.choice([0, 1, 5, 40, 1000, 10**6]) * r.randrange(1, 9) for _ in range(r.randrange(1, 9))]
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert np.allclose(got, poured(sizes, weights)) and sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * n for t, n in zip(got, sizes, strict=True))


def test_permutations_are_bijections():
    for size in (1, 2, 3, 5, 64, 65, 1000):
        for key in (0, 7):
            got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, "uint64"))
            assert sorted(got.tolist()) == list(range(size))
    one, two = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, "uint64")) for k in (1, 2))
    assert (one != two).mean() > 0.9 and (one != np.arange(1000)).mean() > 0.9


@pytest.mark.parametrize(("block", "slots"), [(7, 5), (64, 1024)])
def test_mix_gives_each_source_its_target(sourced, mixed_rows, block, slots):
    docs = sourced(mixed_rows)
    mix = mixing.Mix(docs, block=block, shard_slots=slots)
    got = mix.taken().collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _, _ in mixed_rows)
    names = sorted({s for *_, s in mixed_rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, _, s in mixed_rows if s == name) for name in names]
    wanted = dict(zip(names, mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    assert sum(r.taken for r in got) == pytest.approx(sum(sizes), abs=len(names))
    assert all(r.taken <= 3 * r["size"] for r in got)
    of = {s.rank: s.name for s in mix.plan}
    words = Counter()
    for r in mix.slots().collect():
        words[of[r["rank"]]] += r.n
    assert all(abs(words[n] - wanted[n]) <= 0.5 for n in names)
    counts = Counter(r.shard for r in mix.blocks.collect())
    assert sum(counts.values()) == sum(s.slots for s in mix.plan) and all(n == slots for n in sorted(counts.values())[1:])
    again = mixing.Mix(docs.repartition(3), block=block, shard_slots=slots).taken().collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_blocks_tile_each_stream(sourced, mixed_rows):
    mix = mixing.Mix(sourced(mixed_rows), block=7)
    for rank, pieces in _by(mix.pieces().collect(), "rank").items():
        laid = sorted((p.block * 7 + p.at, p.n) for p in pieces)
        assert [at for at, _ in laid] == [0, *np.cumsum([n for _, n in laid])[:-1].tolist()]
        assert sum(n for _, n in laid) == mix.plan[rank].words
    full = [s for s in mix.plan if s.words and s.target == 3 * s.words]
    assert full and all(set(Counter(b.block for b in mix.blocks.where(F.col("rank") == s.rank).collect()).values()) == {3} for s in full)


def _by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_texts_of_a_mix_are_its_words(sourced, mixed_rows):
    mix = mixing.Mix(sourced(mixed_rows), block=7, with_text=True)
    texts = {(r.shard, r.place): r.text for r in mix.texts().collect()}
    assert all(len(re.findall(mixing.WORD, texts[b.shard, b.place])) == b.words for b in mix.blocks.collect()) and len(texts) == mix.blocks.count()
    by_doc = {(r.doc_id, r.start): r.text for r in mix.documents.where("words > 0").collect()}
    pieces = sorted(mix.pieces().collect(), key=lambda p: p.from_word)
    told = defaultdict(str)
    for p in pieces:
        told[p.doc_id, p.start] += p.text
    assert set(told.values()) == {t for t in by_doc.values()}


def test_mix_of_nothing_and_of_no_words(sourced):
    assert mixing.Mix(sourced([])).taken().count() == 0
    got = mixing.Mix(sourced([(1, None, "en", None), (2, " \n", "en", "a")])).taken().collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_too_many_sources_are_refused(sourced, mixed_rows, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.Mix(sourced(mixed_rows))


TEXTS = [None, "", " ", "Ab1, cd\n\x00é", "a<P>b", "<", "x<S", "S>M>P>" * 5, "<" * 9, "wordé" * 40, "abc " * 30_000, "😀" * 50, "a\r\nb\tc"]


def test_examples_are_cut_at_units_and_read_back(spark, documents):
    rows = [(i * 13 + k, t) for i, t in enumerate(TEXTS) for k in range(13)] + [(None, "no id at all"), (4, "twice"), (4, "twice")]
    made = infilling.examples(documents(rows))
    got = {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()}
    expected, forms = set(), Counter()
    for i, t in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        forms[form] += 1
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        expected.add((i, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), output))
    assert got == expected and len(forms) == 3 and made.count() == len(rows)
    back = made.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = infilling.digests(made).collect()
    assert {(r.doc_id, r.restored_sha256) for r in digests} == {(i, sha(t or "")) for i, t in rows}
    assert infilling.examples(documents([])).count() == 0


def test_the_matcher_holds_no_units():
    import tracemalloc

    text = "a1" * 1_000_000
    tracemalloc.start()
    n = infilling.count_units(text)
    assert infilling.ends(text, n // 3, n // 2) == (n // 3, n // 2)
    assert tracemalloc.get_traced_memory()[1] < 200_000
    tracemalloc.stop()


@pytest.mark.parametrize("query", ["op11_source_divergence", "op13_fill_in_middle"])
def test_sql_of_the_queries(spark, sf_dir, query):
    from cubitgrid.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert {"op11_source_divergence": oracles.DIVERGENCE, "op13_fill_in_middle": oracles.FILL_IN_MIDDLE}[query] == queries.ORACLE_SQL[query]
    got = queries.QUERIES[query](spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[query]})").fetchall())
