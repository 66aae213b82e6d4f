import base64
import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from leafmill.llm import bytebpe, pretokens, tokencount  # noqa: E402
from leafmill.llm.arrays import chunks, unique_slices  # noqa: E402
from leafmill.llm.pairs import Cached, Merges  # noqa: E402

MARKS = ["'", "'s", "'re", "'ll", "'d", "t", "a", "É", "1", "٣", " ", "  ", "\n", "\t", "　", "!", "?", "😀", "é", "ſ", "'S", "\x85", "漢", "\x1c", "<|endoftext|>", "Σ", "İ", "ǅ", "\0", "가"]


def texts(n=4000):
    r = random.Random(1)
    return ["".join(r.choice(MARKS) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["a" * 5000, "'" * 50, " " * 100, "", "ab'" * 40, "xyzzy" * 700]


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(vocabulary, library):
    known, column = bytebpe.ByteVocabulary(vocabulary), texts()
    got = []
    for piece in chunks(pa.array(column), 5000):
        ids, ends, begins = known.encode(piece)
        assert known.decode(ids, ends).tobytes() == piece.data.tobytes()
        got += [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]
    assert got == [library.encode_ordinary(t) for t in column]


def test_byte_bpe_query(rows, documents, library):
    got = rows("op7_bytebpe")
    for i, text in zip(documents.doc_id, documents.text):
        ids = library.encode_ordinary(text or "")
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_byte_bpe_odd(spark, odd, empty, vocabulary):
    encoded = bytebpe.encode(spark, odd, vocabulary)
    got = bytebpe.decode(spark, encoded, vocabulary).collect()
    texts = sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(bytes(r.decoded) for r in got) == texts == sorted(bytes(r.decoded) for r in bytebpe.round_trip(spark, odd, vocabulary).collect())
    assert all(not r.ends or r.ends[-1] > 0 for r in encoded.collect())
    assert bytebpe.digests(bytebpe.round_trip(spark, empty, vocabulary)).count() == 0


def test_token_counts(spark, odd, empty, rows, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        raw = f.read()
    known, column = tokencount.WordVocabulary(raw), texts()
    expected = [len(e) for e in library.encode_batch(column, add_special_tokens=False)]
    assert known.count(column).tolist() == expected
    got = rows("op6_tokencount")
    for i, text in zip(documents.doc_id, documents.text):
        n = len(library.encode(text or "", add_special_tokens=False))
        assert tuple(got.loc[i]) == (len((text or "").encode()), n, n > 2048)
    assert sorted(r.n_tokens for r in tokencount.token_counts(spark, odd, raw).collect()) == sorted(len(library.encode(r.text or "", add_special_tokens=False)) for r in odd.collect())
    assert tokencount.token_counts(spark, empty, raw).count() == 0


def test_long_words_are_kept_apart(library, vocabulary, twins):
    """Words that any polynomial hash modulo a power of two would take for each other, in one text and in several."""
    from tokenizers import Tokenizer

    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    column = [" ".join(twins), *twins]
    known = bytebpe.ByteVocabulary(vocabulary)
    for piece in chunks(pa.array(column), 1 << 17):
        ids, ends, begins = known.encode(piece)
        assert known.decode(ids, ends).tobytes() == piece.data.tobytes()
        for i, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
            assert ids[a:b].tolist() == library.encode_ordinary(column[piece.first + i])
    with open(path, "rb") as f:
        counted = tokencount.WordVocabulary(f.read())
    assert counted.count(column).tolist() == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in column]


def test_every_special_token_counts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        raw = json.loads(f.read())
    raw["added_tokens"].append(raw["added_tokens"][0] | {"id": 49408, "content": "[cut]"})
    library = Tokenizer.from_str(json.dumps(raw))
    known = tokencount.WordVocabulary(json.dumps(raw).encode())
    column = ["a [cut] b", "[cut][cut]", "<|endoftext|>x", "nothing", "[cu t]"]
    assert known.count(column).tolist() == [len(library.encode(t, add_special_tokens=False)) for t in column]


def test_unique_slices_when_hashes_meet(monkeypatch):
    from leafmill.llm import arrays

    monkeypatch.setattr(arrays, "slice_hashes", lambda data, starts, ends, lower=False: np.zeros(len(starts), np.uint64))
    words = [b"a" * 9, b"b" * 9, b"short", b"c" * 50, b"c" * 49 + b"d", b"a" * 9, b"c" * 50, b"x" * 20]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    first, inverse = unique_slices(data, starts, ends)
    assert [words[first[k]] for k in inverse] == words and len(first) == len(set(words))


def test_scan_is_composition():
    r = random.Random(2)
    functions = np.array([r.randrange(256) for _ in range(1000)], np.uint8)
    out = pretokens.scan(functions)
    for state in range(4):
        now = state
        for f, composed in zip(functions.tolist(), out.tolist()):
            now = f >> 2 * now & 3
            assert composed >> 2 * state & 3 == now


def test_merges_long_and_short():
    merges = Merges()
    pairs = [(0, 1), (1, 0), (2, 2), (3, 1), (0, 0)]
    for rank, (a, b) in enumerate(pairs):
        merges.add(a, b, rank, 2 + rank)
    r = random.Random(4)
    for n in (1, 2, 7, 40, 300):
        parts = [r.randrange(2) for _ in range(n)]
        slow = parts[:]
        while found := [(merges.ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(slow, slow[1:])) if a << 20 | b in merges.ranks]:
            rank, i = min(found)
            slow[i : i + 2] = [merges.made[rank]]
        assert merges.merge(parts[:]) == slow == merges._merge_long(parts[:])


def test_cache_is_bounded():
    cached = Cached(len, most=3)
    assert [cached(b"x" * (i % 5)) for i in range(40)] == [i % 5 for i in range(40)] and len(cached.young) <= 3 and len(cached.old) <= 3


def test_unique_slices():
    data = np.frombuffer(b"abcabcdefghijklabcdefghijkl" * 3, np.uint8)
    starts = np.array([0, 3, 15, 0, 42, 5, 5])
    ends = np.array([3, 15, 27, 0, 54, 5, 8])
    first, inverse = unique_slices(data, starts, ends)
    raw = data.tobytes()
    assert [raw[starts[first[k]] : ends[first[k]]] for k in inverse] == [raw[a:b] for a, b in zip(starts, ends)] and len(first) == len({raw[a:b] for a, b in zip(starts, ends)})
