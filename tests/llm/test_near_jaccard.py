import random
from itertools import combinations

import corpus_pipeline
from seriesmill.llm import common, near_jaccard, simhash


def plain_sets(texts):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    return {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def plain_components(texts):
    """Components over all pairs with a Jaccard similarity of 0.8 or more."""
    sets, top = plain_sets(texts), {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top[a], top[b]))
            top = {i: x if r == y else r for i, r in top.items()}
    return top


def edited(rng, base, n):
    words = list(base)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    """Copies at similarities on both sides of 0.8, and a crowd about one text."""
    texts = []
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        texts += [edited(rng, base, max(0, int(len(base) * x))) for x in (0, 0.004, 0.012, 0.02, 0.025, 0.03, 0.1)]
    crowd = [f"c{i}" for i in range(120)]
    texts += [edited(rng, crowd, rng.randint(1, 5)) for _ in range(60)]
    texts += ["one two three", "One two  three", "one two four", "", " \n", None]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_components_equal_brute_force(spark, monkeypatch):
    texts = corpus(random.Random(3))
    want = plain_components(texts)
    docs = common.stored(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    for tile in (512, 8):
        monkeypatch.setattr(near_jaccard, "TILE", tile)
        assert {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(docs).collect()} == want
    left = corpus_pipeline.near(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_components({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == sorted(set(want.values()))


def test_edges(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "x y z u v w"), (None, "A b c d e f"), (None, "no id"), (5, "X y z u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_jaccard.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 3), (3, 3), (3, 3), (3, 3), (5, 3)]
    words = [f"w{i}" for i in range(40)]
    chain = spark.createDataFrame([(1, " ".join(words)), (None, " ".join(words + ["x", "y", "z"])), (2, " ".join(words + ["x", "y", "z", "u", "v", "t"]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_jaccard.near_duplicates(chain, percent=90).collect()} == {(1, 1), (None, 1), (2, 1)}
    assert near_jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Without bands the stage still links every similar pair within the distance, and no dissimilar text."""
    texts = corpus(random.Random(5))
    want, sets = plain_components(texts), plain_sets(texts)
    prints = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in texts.items()}
    docs = common.stored(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    monkeypatch.setattr(near_jaccard, "_by_bands", lambda nodes: spark.createDataFrame([], "src long, dst long"))
    found = {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(docs).collect()}
    close = 0
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and (prints[a] ^ prints[b]).bit_count() <= near_jaccard.DISTANCE:
            assert found[a] == found[b]
            close += sets[a] != sets[b]
        assert found[a] != found[b] or want[a] == want[b]
    assert close > 20
    left = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert left == set(found.values()) and len(left) < len(texts)


def test_equal_fingerprints_of_unlike_sets(spark):
    """Texts of one fingerprint are candidates, whatever the bands say, and stay apart if their sets are not similar."""
    line = "the same seven words again and again"
    texts = {1: " ".join([line] * 300), 2: " ".join([line] * 300 + ["with", "another", "ending", "of", "eight", "more", "new", "words"]), 3: " ".join([line] * 301)}
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    assert len(set(prints.values())) < 3
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "unhex(sha2(text, 256)) AS digest", "cast(text AS binary) AS body")
    linked = near_jaccard._by_prints(common.stored(near_jaccard.sketches(rows, 5), "sketches"), near_jaccard.DISTANCE).collect()
    assert len(linked) == 1
    assert {r.doc_id: r.component_id for r in near_jaccard.near_duplicates(docs).collect()} == plain_components(texts) == {1: 1, 2: 2, 3: 1}
