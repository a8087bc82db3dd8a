import base64
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import lattice_lm

PIECES = [bytes([b]) for b in range(256)] + [b" t", b"th", b"the", b" the", b"he", b"e "]


def test_every_step_sees_all_words(spark, monkeypatch):
    """Scores are those of EM steps over all training words, however few words count as hot."""
    rows = [(b"the", 50), (b"then", 9), (b"thethe", 3), (b"het", 2), (b"th", 1), (b"xhex", 1)]
    words = spark.createDataFrame([(w, c, c) for w, c in rows] + [(b"other", 0, 4)], "word binary, c long, total long")
    start = 1 / (np.arange(len(PIECES)) + lattice_lm.PRIOR)
    want = lattice_lm.Lattice(PIECES, np.log(start / start.sum()), 0.0)
    for _ in range(lattice_lm.ROUNDS):
        uses = np.append(want.expected([w for w, _ in rows], np.array([c for _, c in rows])), 7.0) + lattice_lm.SMOOTH
        logs = np.log(uses / uses.sum())
        want = lattice_lm.Lattice(PIECES, logs[:-1], float(logs[-1]))
    monkeypatch.setattr(lattice_lm, "HOT", 2)
    found = lattice_lm.train(words, PIECES, 7)
    assert found.logs == pytest.approx(want.logs) and found.end == pytest.approx(want.end)


def test_long_words_are_trained_whole(monkeypatch):
    p = np.random.default_rng(0).dirichlet(np.ones(len(PIECES) + 1))
    lattice = lattice_lm.Lattice(PIECES, np.log(p[:-1]), float(np.log(p[-1])))
    words, counts = [b"the" * 60, b"\xe6\x97\xa5" * 50, b"the", b"x" * 129, b"h" * 128], np.array([2, 1, 5, 3, 1])
    found = lattice.expected(words, counts)
    assert lattice._long_uses(words[0], 7) == pytest.approx(lattice._long_uses(words[0]))
    monkeypatch.setattr(lattice_lm, "LONG", 1000)
    assert found == pytest.approx(lattice.expected(words, counts), abs=1e-9)
    assert found[:256][ord(" ")] + found[[i for i, x in enumerate(PIECES) if len(x) > 1 and x.startswith(b" ")]].sum() == pytest.approx(counts.sum())


def ways(word, score):
    """All segmentations' probabilities, by plain recursion."""
    return 1.0 if not word else sum(p * ways(word[len(k) :], score) for k, p in score.items() if word.startswith(k))


def test_scores_equal_sums_over_segmentations(spark, tmp_path, monkeypatch):
    """From texts to the score: counts, all EM steps and the marginal, against plain recursion."""
    vocabulary = tmp_path / "ranks"
    vocabulary.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(PIECES)))
    texts = {i: t for i, t in enumerate(["the Then thethe", "het\tthe xhex", None, "", "the then then", "eh", "th thex", "hethe he the", "x"])}
    docs = spark.createDataFrame([*texts.items(), (None, "the")], "doc_id long, text string")
    for hot in (0, 1 << 17):
        monkeypatch.setattr(lattice_lm, "HOT", hot)
        rows = lattice_lm.score(docs, str(vocabulary)).collect()
        assert len(rows) == 10
        train = [t for i, t in [*texts.items(), (None, "the")] if not lattice_lm.held_out(i)]
        counts = Counter(w for t in train for w in (t or "").lower().encode().split())
        p = 1 / (np.arange(len(PIECES)) + lattice_lm.PRIOR)
        p, end = p / p.sum(), 0.0
        for _ in range(lattice_lm.ROUNDS):
            uses = np.full(len(PIECES), lattice_lm.SMOOTH)
            score = dict(zip(PIECES, p, strict=True))
            for w, c in counts.items():
                word = b" " + w
                for i, k in enumerate(PIECES):
                    for at in range(len(word)):
                        if word.startswith(k, at):
                            uses[i] += c * ways(word[:at], score) * score[k] * ways(word[at + len(k) :], score) / ways(word, score)
            total = uses.sum() + len(train) + lattice_lm.SMOOTH
            p, end = uses / total, (len(train) + lattice_lm.SMOOTH) / total
        score = dict(zip(PIECES, p, strict=True))
        for r in rows:
            text = "the" if r.doc_id is None else texts[r.doc_id]
            want = np.log10(end) + sum(np.log10(ways(b" " + w, score)) for w in (text or "").lower().encode().split())
            assert r.score == pytest.approx(want), text
            assert r.mixed_score < 0


def test_trie_holds_the_pieces():
    pieces = [b"a", b"ab", b"abc", b" a", b" ", b"e ", b"", b"\xff\xfe", b"bd"]
    trie = lattice_lm.Trie(pieces)

    def find(word):
        node = 0
        for c in word:
            to = int(trie.base[node]) + c
            if trie.owner[to] != node:
                return -1
            node = to
        return int(trie.piece[node])

    assert [find(p) for p in pieces] == [0, 1, 2, 3, 4, -1, -1, 7, 8] and find(b"b") == -1 and find(b"zz") == -1
