import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cubitgrid.llm import bpe, encode, packing


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    t.no_padding()
    t.no_truncation()
    return t


def test_dynamic_programming_equals_library(library):
    b, rng = bpe.load(), random.Random(7)
    letters = "abcdeThhing  \n\t'sé́ßΣςİıſ0½²٣ー漢😀  \x1c\x85.,!?"
    texts = ["", " ", "a" * 3000, "!" * 500, "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "y" * 70 + "<|ENDOFTEXT|>"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    own = bpe.LibraryIds(bpe.VOCABULARY, most=500)
    for t in texts:
        assert own.encode([t])[0] == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        ids = [i for c in b.chunks(t) for i in b.ids(c)]
        assert ids == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert b.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_are_ordered_as_the_pair_test_needs():
    b = bpe.load()
    assert all(max(b.made.get(x, -1), b.made.get(y, -1)) < m for (x, y), m in b.rank.items())


def test_digests_and_encode(documents, odd, library):
    docs = documents(odd)
    got = Counter(map(tuple, encode.digests(docs).collect()))
    want = Counter()
    for i, t in odd:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    full = encode.encode(docs).where("doc_id = 7").first()
    assert full.ids == library.encode(dict(odd)[7], add_special_tokens=False).ids
    assert encode.digests(documents([])).count() == 0


def test_packing(documents, odd, library):
    rows = packing.pack(documents(odd)).collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and 0 < r.length <= 4096 and r.offset == 0 and 1 << r.bucket == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = dict(odd)
    for i, pieces in by_doc.items():
        copies = sum(1 for j, _ in odd if j == i)
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r.ids == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
    assert packing.pack(documents([])).count() == 0


def test_packing_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12_345):
        sizes = packing.binary_lengths(n, 4096)
        assert sum(sizes) == n and len([s for s in sizes if s < 4096]) == len({s for s in sizes if s < 4096})


def test_buckets_are_written(documents, spark, tmp_path):
    packing.write_buckets(packing.pack(documents([(1, "a b c"), (2, "d")])), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> pow(2, bucket)").count() == 0 and back.count() > 0


def test_every_character_of_the_basic_plane():
    """Cut and folded as the library does, whatever version of Unicode either has; U+10000 and on in steps."""
    import numpy as np

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    lib.no_padding()
    lib.no_truncation()
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x32000, 7), *range(0xE0000, 0xE0200)]]
    texts = [f"ab{c}c {c}'s" for c in chars]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    whole, own = bpe.LibraryIds(bpe.VOCABULARY), bpe.load()
    got = [x for at in range(0, len(texts), 256) for x in whole.encode(texts[at : at + 256])]
    assert [c for c, a, b in zip(chars, got, want, strict=True) if a != b] == []
    dynamic = [np.array([i for x in own.chunks(t) for i in own.ids(x)], "<u4").tobytes() for t in texts]
    assert [c for c, a, b in zip(chars, dynamic, want, strict=True) if a != b] == []


def test_new_pieces_are_found_without_going_through_the_known_ones():
    from cubitgrid.llm import bpe

    class Known(dict):
        def keys(self):
            raise AssertionError("goes through all known pieces")

    ids = bpe.LibraryIds(bpe.VOCABULARY)
    once = ids.encode(["some words, and more words"])
    ids.known = Known(ids.known)
    assert ids.encode(["some words, and more words"]) == once and ids.encode(["entirely new ones"]) == [ids.whole("entirely new ones")]


def test_merges_are_loaded_once(monkeypatch):
    """Two copies of them were a worker's memory; pieces are encoded as in whole texts all the same."""
    loaded = []
    monkeypatch.setattr(bpe.Tokenizer, "from_file", lambda path, _of=bpe.Tokenizer.from_file: (loaded.append(path), _of(path))[1], raising=False)
    ids = bpe.LibraryIds(bpe.VOCABULARY, most=3)
    texts = ["Größe naïve Σας 12 it's", "", "a\u00a0b\x1c.c ~!", "x" * 200 + " ☃☃ é"]
    assert ids.encode(texts) == [ids.whole(t) for t in texts]
    assert len(loaded) == 1
