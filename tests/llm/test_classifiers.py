import random
import zlib

import numpy as np
import pytest

from cubitgrid.llm import quality, toxicity

INSULTS = ["blorgus", "snarvik", "pelthump", "drizzak"]


def make(n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "es", "nd", "ha"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        junk = i % 4 == 0
        text = " ".join(words)
        docs.append((i, text.upper().replace(" ", "!! ") if junk else text.capitalize() + "."))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark, documents):
    docs, labels = make()
    return docs, documents(docs), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "limit"), [(quality, 1, 0.3), (toxicity, 2, 0.5)])
def test_held_out_accuracy(labelled, documents, odd, module, column, limit):
    docs, frame, labels = labelled
    model = module.train(frame, labels)
    got = {r.doc_id: r for r in module.score(frame, model).collect()}
    truth = {x[0]: x[column] for x in make()[1]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    extra = module.score(documents(odd), model).collect()
    assert len(extra) == len(odd) and all(0 <= r.score <= 1 for r in extra)
    kept = module.keep(frame, model)
    want = {i for i, r in got.items() if (r.predicted == 1) == (column == 1)}
    assert kept.columns == frame.columns and {r.doc_id for r in kept.select("doc_id").collect()} == want
    assert module.score(documents([]), model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels(labelled, module):
    docs, frame, labels = labelled
    model = module.train(frame, labels.limit(0))
    assert {r.score for r in module.score(frame, model).collect()} == {0.5}


def test_gapped_and_inserted_characters(labelled):
    docs, frame, labels = labelled
    model = toxicity.train(frame, labels)
    plain = "the nd es or ti ha an or ti es the ha nd " * 3
    clean, *bad = toxicity.scores([plain] + [plain + f" {w} " * 3 for w in ("blorgus", "b l o r g u s", "b-l-o-r-g-u-s", "blxorgus", "Blorgus!")], model)
    assert clean < 0.5 and all(b > 0.5 for b in bad)


def brute_ssk(s, t, n=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    def spans(x):
        out = {}
        for c in combinations(range(len(x)), n):
            key = "".join(x[i] for i in c)
            out[key] = out.get(key, 0) + decay ** (c[-1] - c[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_against_enumeration():
    words = ["^idiot", "^idxiot", "^abcabc", "^aab", "^"]

    def kernel(s, t):
        """From the subsequences that the module enumerates; of a word with itself by its own sums."""
        (a, wa), (b, wb) = (toxicity.enumerated(toxicity.codes([w])[0]) for w in (s, t))
        both = float(((a[0][:, None] == b[0][None]) * wa[:, None] * wb[None]).sum())
        assert s != t or abs(toxicity.own_kernels(a, wa)[0] - both) < 1e-9
        return both

    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert abs(kernel(s, t) - brute_ssk(s, t)) < 1e-9


def test_discriminant_scores_are_log_density_differences():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((300, 3)), rng.standard_normal((300, 3)) * 2 + 1])
    y = np.repeat([0.0, 1.0], 300)
    d = quality.Discriminant(x, y)
    z = d._scaled(x)
    dens = []
    for k in (0, 1):
        cov = np.linalg.inv(d.factors[k]) @ np.linalg.inv(d.factors[k]).T
        e = z - d.means[k]
        dens.append(-0.5 * np.einsum("ni,ij,nj->n", e, np.linalg.inv(cov), e) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(0.5))
    assert np.allclose(np.sinh(d.difference(x)), dens[1] - dens[0])


def plain_statistics(text):
    """The statistics of a text, character by character."""
    from math import log, log1p
    from statistics import fmean, pstdev

    kinds = {k: 0 for k in ("upper", "digit", "line", "stop", "bang", "bar", "symbol", "other")}
    for c in text:
        if ord(c) >= 0x250:
            kind = "other"
        elif c == "\n":
            kind = "line"
        elif c.isspace():
            continue
        elif c.isalpha() and not c.isupper():
            continue
        else:
            kind = {"!": "bang", "|": "bar"}.get(c) or ("stop" if c in ".,;:?" else "upper" if c.isupper() else "digit" if c.isdigit() else "symbol")
        kinds[kind] += 1
    words, lines = text.split(), text.split("\n")
    odds = lambda part, whole: log((part + 0.5) / (whole - part + 0.5))
    lengths = [len(w) for w in words] or [0]
    return [
        log1p(len(text)), log1p(len(words)), *(odds(v, len(text)) for v in kinds.values()), odds(len(set(words)), len(words)), odds(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        odds(len(set(lines)), len(lines)), odds(sum(len(w) <= 3 for w in words), len(words)), log1p(fmean(lengths)), log1p(pstdev(lengths)), log1p(len(words) / (1 + kinds["stop"])), log1p(len(text) / len(lines)),
    ]


def test_quality_query_against_plain_densities(labelled, documents, odd):
    """Statistics, shrunk covariances and densities from the texts alone; the logistic curve is the model's."""
    docs, frame, labels = labelled
    model = quality.train(frame, labels)
    truth = {i: q for i, q, _ in make()[1]}
    rows = [(plain_statistics(t), truth[i]) for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    scaled = lambda v: np.clip((np.array(v) - mean) / scale, -8, 8)
    own = [np.cov(scaled(x[y == k]).T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(own))
    logs = []
    texts = docs + [(i, t or "") for i, t in odd]
    z = scaled([plain_statistics(t) for _, t in texts])
    for k, c in enumerate(own):
        c = 0.7 * c + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        e = z - scaled(x[y == k]).mean(0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", e, np.linalg.inv(c), e) - 0.5 * np.linalg.slogdet(c)[1] + np.log((y == k).mean()))
    want = 1 / (1 + np.exp(-np.clip(model.slope * np.arcsinh(logs[1] - logs[0]) + model.shift, -30, 30)))
    got = [r.score for f in (frame, documents(odd)) for r in quality.score(f, model).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-6)


def test_toxicity_query_against_enumerated_kernels(labelled, documents):
    """Every word against every landmark by the enumerated kernel, without tables, memory or batches."""
    docs, frame, labels = labelled
    model = toxicity.train(frame, labels)
    marks = [toxicity.START + w for w in model.marks.words]
    own = {m: brute_ssk(m, m) for m in marks}
    values = {}

    def value(word):
        if word not in values:
            w = toxicity.bare(word)
            f = np.zeros(len(marks))
            if 3 <= len(w) <= toxicity.WINDOW:
                w = toxicity.START + w
                norm = brute_ssk(w, w)
                f = np.array([max(0.0, (brute_ssk(w, m) / (norm * own[m]) ** 0.5 - toxicity.FLOOR) / (1 - toxicity.FLOOR)) for m in marks])
            values[word] = float(f @ model.weights)
        return values[word]

    some = docs[:60] + [(900, "B l o r g u s is a blxorgus! snarvik? No."), (901, ""), (902, None)]
    want = {}
    for i, t in some:
        sentences = [toxicity.words_of(s) for s in toxicity.SENTENCE.split(t or "")]
        n = sum(map(len, sentences)) + 10
        each = [sum(map(value, s)) for s in sentences]
        toxic, most = sum(max(0.0, v) for v in each), max([0.0, *each])
        kinds = sum(max(0.0, value(w)) for w in {w for s in sentences for w in s})
        x = np.array([np.log(1e-3 + toxic / n), np.log(1e-3 + kinds / n), np.log1p(most), np.log1p(kinds), np.log(n)])
        want[i] = 1 / (1 + np.exp(-np.clip(np.r_[(x - model.mean) / model.scale, 1] @ model.curve, -30, 30)))
    got = {r.doc_id: r.score for r in toxicity.score(documents(some), model).collect()}
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want), max((abs(got[i] - want[i]), i) for i in want)


def test_no_kernel_over_the_floor_is_lost(spark, sf_dir):
    """All words of the table, of every length, against landmarks of all kinds; windows of long words too."""
    from itertools import combinations

    def spans(x):
        out = {}
        for i, j, k in combinations(range(len(x)), 3):
            out[x[i] + x[j] + x[k]] = out.get(x[i] + x[j] + x[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    words = sorted({toxicity.bare(w) for r in docs for s in toxicity.sentences(r.text) for w in s})[:: 3] + ["x" * 70, "abc" * 20, "a", "", "😀😀😀"]
    marks = toxicity.Landmarks([*[w for w in words if 3 <= len(w) <= 12][::97][:40], "idiot", "aaaa", "ananre"], 0.3)
    table = [spans(toxicity.START + m) for m in marks.words]
    own = [sum(v * v for v in t.values()) for t in table]
    n = 0
    for w, f in zip(words, marks.features(words), strict=True):
        parts = [toxicity.START + w] if len(w) <= toxicity.WINDOW else [toxicity.START * (at == 0) + w[at : at + toxicity.WINDOW] for at in range(0, len(w) - toxicity.WINDOW // 2, toxicity.WINDOW // 2)]
        want = np.zeros(len(table))
        for p in parts if len(w) >= 3 else []:
            mine = spans(p)
            norm = sum(v * v for v in mine.values())
            want = np.maximum(want, [max(0.0, sum(v * t[k] for k, v in mine.items() if k in t) / (norm * o) ** 0.5 - 0.3) / 0.7 for t, o in zip(table, own, strict=True)])
        n += int((want > 0).sum())
        assert np.allclose(want, 0 if f is None else f, atol=1e-6), w
    assert n > 1_000
