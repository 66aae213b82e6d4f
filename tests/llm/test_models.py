"""Toxicity, quality and language models."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import lattice, logistic, quality, toxicity
from leafmill.llm.arrays import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- toxicity --------------------------------------------------------------------


def read(text, lexicon=None):
    return toxicity.Reader(lexicon or toxicity.Lexicon()).features(text)


def test_grammar():
    plain, denied, told = read("a stupid thing."), read("it is not stupid."), read("she said stupid things.")
    pattern = lambda f: set(np.flatnonzero(f[: toxicity.PATTERNS]))
    assert pattern(plain) == {0} and pattern(denied) == {4} and pattern(told) == {3}  # insult x negated x reported x target
    assert pattern(read("you stupid")) == {1} and pattern(read("you. stupid")) == {0} and pattern(read("not a b c d stupid")) == {0}
    assert pattern(read("i will kill you")) == {9} and not pattern(read("nothing here, kindly"))
    w = toxicity.PRIOR[:-1]
    assert w @ plain > w @ told > 0 and w @ plain > w @ denied


def naive(text, reader):
    """Patterns by looking at each clause as a whole."""
    out = Counter()
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        kinds = [reader.read(t) for t in toxicity.TOKEN.findall(clause)]
        for i, (kind, weight) in enumerate(kinds):
            if kind in (toxicity.INSULT, toxicity.THREAT):
                negated = any(k == toxicity.NEGATION for k, _ in kinds[max(0, i - toxicity.SCOPE) : i])
                reported = any(k == toxicity.REPORT for k, _ in kinds[:i])
                aimed = any(k == toxicity.TARGET for k, _ in kinds)
                out[(kind - 1) * 8 + negated * 4 + reported * 2 + aimed] += weight
    return [out[i] for i in range(toxicity.PATTERNS)]


def test_patterns_by_clause(documents):
    import random

    reader, r = toxicity.Reader(toxicity.Lexicon(stems={"quic": 1.5})), random.Random(8)
    pool = [*toxicity.INSULTS[:5], *toxicity.THREATS[:4], *toxicity.TARGETS[:6], *toxicity.NEGATIONS[:4], *toxicity.REPORTS[:4], *"abcdefgh", ".", ";", "\n", "quickly"]
    texts = [" ".join(r.choices(pool, k=r.randint(1, 60))) for _ in range(300)] + [t or "" for t in documents.text[:100]]
    for text in texts:
        assert np.allclose(reader.features(text)[: toxicity.PATTERNS], np.log1p(naive(text, reader)))


def test_long_texts(monkeypatch):
    text = "you are stupid. not an idiot; she said: scum! " * 40
    whole = read(text)
    monkeypatch.setattr(toxicity, "PART", 7)
    monkeypatch.setattr(toxicity, "LONG", 60)
    assert np.allclose(read(text), whole)
    far = "x" * (1 << 20) + " w" * 300 + " not idiot" + " w" * 300 + " you"  # a clause without end is read whole
    assert set(np.flatnonzero(read(far)[: toxicity.PATTERNS])) == {5}


def test_compose_is_the_product():
    machine, parts = toxicity.grammar(), [toxicity.SCOPE + 1, 2, 2]
    assert len(machine.step) == math.prod(parts) and all(len(r) == 2 * toxicity.CLASSES for r in machine.step)


def test_lexicon(spark):
    import random

    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = [r.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            text[r.randrange(40)] = r.choice(["blurgh", "zorkaa", "zorkbe", "zorkci"])
        rows.append((i, " ".join(text), int(bad)))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert "blurgh" in found.words and "zork" in found.stems and not any(w in words for w in found.words)
    assert found.weight("zorkxyz") > 2 and found.weight("zork") == 0 and found.weight("w1") == 0


def test_copies_teach_once(spark):
    from tests.llm.conftest import prose

    same = [(i, prose(1, 80) + (f" tail{i}" if i % 2 else ""), 1) for i in range(30)]
    other = [(100 + i, prose(50 + i, 80), 1) for i in range(5)]
    left = toxicity.without_copies(spark, spark.createDataFrame(same + other, "doc_id long, text string, label int")).collect()
    assert sorted(r.doc_id for r in left) == [0, 100, 101, 102, 103, 104]


def test_toxicity_query(rows, spark, documents):
    got = rows("op9_toxicity")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in documents.doc_id)
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.predicted == 1].toxic.mean() > 0.9 and held[held.toxic == 1].predicted.mean() > 0.9


def test_toxicity_odd(spark, odd, empty, labels):
    model = toxicity.train_model(spark, odd, labels)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    none = toxicity.train_model(spark, empty, labels.where("false"))
    assert toxicity.scored(empty, none).count() == 0 and toxicity.clean(odd, none).count() == odd.count()


# -- quality ---------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def test_quality_base(rows, documents):
    got = rows("op5_quality")
    for i, text in zip(documents.doc_id, documents.text):
        r = got.loc[i]
        assert tuple(r[:6]) == base(text) and not (r.base_failed and r.kept)


def test_quality_pieces():
    import pyarrow as pa

    column = ["a b c d e f g h " * 3, None, "", "x\n\nx\n x\nx", "#<é> é\x0b\x85y", "one\r\none\r\n", "a b c d e f g h i a b c d e f g h i"] * 3
    for limit in (10, 60, 10_000):
        for piece in chunks(pa.array(column), limit):
            counts = quality.base_counts(piece)
            for i in range(len(piece)):
                assert tuple(int(counts[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(column[piece.first + i])[:5]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_model(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judged(docs, model).toPandas().merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id")
    good = got.probability >= quality.KEEP
    assert (good == (got.quality == 1)).mean() > 0.93
    assert abs(got.probability.mean() - got.quality.mean()) < 0.08  # calibrated


def test_quality_verdict_by_hand(spark, documents):
    """Every probability by single words and n-grams, one at a time."""
    import pyarrow as pa

    from leafmill.llm.arrays import Piece, slice_hashes, window_hashes

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_model(docs, labels)
    assert model is not None
    mask, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def finish(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def average(weights, buckets):
        return sum(float(weights[b]) for b in buckets) / max(1, len(buckets))

    texts = [*documents.text[:60], "", "é", "ärger über öl", "a b", "漢字 😀 x"]
    got = {}
    for piece in chunks(pa.array(texts), 5000):
        got |= {piece.first + i: p for i, p in enumerate(model.probability(piece))}
    for i, text in enumerate(texts):
        text = text or ""
        words = [np.frombuffer(w.encode(), np.uint8) for w in WORD.findall(text)]
        hashes = np.array([slice_hashes(w, np.array([0]), np.array([len(w)]))[0] for w in words], np.uint64)
        z = average(model.weights[0], [int(h) >> 48 for h in hashes])
        z += average(model.weights[1], [int(window_hashes(hashes[k : k + 2], 2)[0]) >> 48 for k in range(len(hashes) - 1)])
        for family, n in zip(model.weights[2:], quality.GRAMS):
            own = []
            for k in range(len(text) - n + 1):
                x = n
                for c in text[k : k + n]:
                    x = (x ^ ord(c)) * mix & mask
                own.append(finish(x) >> 48)
            z += average(family, own)
        assert math.isclose(got[i], 1 / (1 + math.exp(-(model.slope * z + model.intercept))), rel_tol=1e-6, abs_tol=1e-9)


def test_quality_long_words(twins):
    """Lines and words that any polynomial hash would take for each other."""
    import pyarrow as pa

    text = "\n".join(twins) + " " + " ".join([*twins, *"abcdefg", *twins])
    counts = quality.base_counts(next(chunks(pa.array([text]))))
    assert tuple(int(counts[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(text)[:5]


def test_quality_odd(spark, odd, empty, labels):
    got = quality.judged(odd, quality.train_model(odd, labels)).collect()
    assert len(got) == odd.count() and not next(r for r in got if r.doc_id == 5).kept
    assert quality.judged(empty, None).count() == 0 and quality.train_model(odd, labels.where("false")) is None


def test_logistic():
    x = np.array([[0.0], [1], [2], [3], [4], [5]])
    w = logistic.fit(x, np.array([0, 0, 1, 0, 1, 1]), np.zeros(2))
    assert w[0] > 0.3 and (logistic.fit(np.zeros((0, 1)), np.zeros(0), np.array([2.0, -1])) == [2, -1]).all()


# -- language model ----------------------------------------------------------------

PIECES = [b" a", b"ab", b" ab", b"abc", b"c", b"bc", *(bytes([b]) for b in range(256) if bytes([b]) != b"c")]


def every_segmentation(word, probability):
    total = {0: 1.0}
    for j in range(1, len(word) + 1):
        total[j] = sum(total[i] * probability.get(word[i:j], 0) for i in range(j))
    return total[len(word)]


def test_lattice():
    known = lattice.Pieces(PIECES)
    logp = known.start()
    p = {piece: math.exp(logp[i]) for i, piece in enumerate(PIECES)}
    words = [b"abc", b"a", b"", b"abcabcabcab", b"xyz", "é".encode(), b"c" * 30]
    got = lattice.lattice(words, known, logp)
    assert np.allclose(got, [math.log(every_segmentation(b" " + w, p)) for w in words])
    expected = np.zeros(known.count + 1)
    lattice.lattice(words, known, logp, np.full(len(words), 2.0), expected)
    assert math.isclose(sum(len(piece) * expected[i] for i, piece in enumerate(PIECES)), 2 * sum(len(w) + 1 for w in words))
    half = np.zeros(known.count + 1)
    lattice.lattice([b"bc"], known, logp, np.ones(1), half)  # " " then "bc" or "b" "c"
    assert math.isclose(half[PIECES.index(b"bc")], p[b"bc"] / (p[b"bc"] + p[b"b"] * p[b"c"]))


def test_long_words(monkeypatch):
    known = lattice.Pieces(PIECES)
    logp, words = known.start(), [b"abcab" * 30, b"x" * 90, b"a"]
    results = []
    for wide in (4, 10**6):
        monkeypatch.setattr(lattice, "WIDE", wide)
        expected = np.zeros(known.count + 1)
        results.append((lattice.lattice(words, known, logp, np.array([1.0, 2, 3]), expected), expected))
    assert np.allclose(results[0][0], results[1][0]) and np.allclose(results[0][1], results[1][1])
    assert math.isfinite(lattice.lattice([b"q" * 200_000], known, logp)[0])


def test_training_raises_likelihood(spark, odd):
    words = spark.createDataFrame([(bytearray(b"abc"), 50), (bytearray(b"cab"), 3)], "word binary, train long")
    known = lattice.Pieces(PIECES)
    logp = known.start()
    for _ in range(3):
        before = float(lattice.lattice([b"abc"], known, logp)[0])
        got = lattice.expected_counts(words, tuple(PIECES), logp) + 0.01
        logp = np.log(got / got.sum())
        assert float(lattice.lattice([b"abc"], known, logp)[0]) > before - 1e-9


def test_scores(rows, documents):
    got, low = rows("op8_lattice"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall((t or "").translate(low)), "end\n"] for i, t in zip(documents.doc_id, documents.text)}
    counts = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    total, distinct = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = got.loc[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_score_by_hand(spark):
    """Piece probabilities and scores by recursions over single words."""
    texts = ["abc ab c", "Ab abcabc bc", "c c ab xyz", "", "bc é ab" + "c" * 40, None, "zz abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w.lower().encode() for t in train for w in t.split())
    start = np.exp(lattice.Pieces(PIECES).start())
    p = dict(zip([*PIECES, None], start))
    for _ in range(lattice.ROUNDS):
        got = Counter({None: len(train)})
        for word, n in counts.items():
            word = b" " + word
            ahead, back = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
            arcs = [(i, j) for j in range(len(word) + 1) for i in range(j) if word[i:j] in p]
            for i, j in arcs:
                ahead[j] += ahead[i] * p[word[i:j]]
            for i, j in sorted(arcs, reverse=True):
                back[i] += p[word[i:j]] * back[j]
            for i, j in arcs:
                got[word[i:j]] += n * ahead[i] * p[word[i:j]] * back[j] / ahead[-1]
        every = [got[k] + lattice.PRIOR * s for k, s in zip([*PIECES, None], start)]
        p = {k: v / sum(every) for k, v in zip([*PIECES, None], every)}
    for r in lattice.likelihood(spark, docs, PIECES).collect():
        words = [w.lower().encode() for w in (texts[r.doc_id] or "").split()]
        expected = math.log10(p[None]) + sum(math.log10(every_segmentation(b" " + w, p)) for w in words)
        assert math.isclose(r.score, expected, rel_tol=1e-9)


def test_no_piece_is_left_out():
    import public_tokenizers

    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known = lattice.Pieces(pieces)
    long = [p for p in pieces if len(p) > 16]
    assert len(long) >= 20
    for p in long[:30]:
        data = np.frombuffer(p + p, np.uint8).reshape(2, -1)
        assert (known.find(lattice.Keys(data), 0, len(p)) == known.index[p]).all()


def test_lattice_odd(spark, odd, empty):
    got = lattice.likelihood(spark, odd, PIECES).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert lattice.likelihood(spark, empty, PIECES).count() == 0


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_blocks_do_not_matter(spark, odd, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    got = sorted((r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lattice.likelihood(spark, odd, PIECES).collect())
    monkeypatch.setattr(lattice, "BLOCK", 4000)
    assert got == sorted((r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lattice.likelihood(spark, odd.repartition(2), PIECES).collect())
