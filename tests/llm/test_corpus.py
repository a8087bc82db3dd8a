import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seriesmill.llm import bpe, common, exact_dedup, lattice_lm, licence, packing, permutation_index, queries, simhash, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"
BYTE, WORD, RANKS = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, digest string, body string, key int"


def edge_docs(spark, rows=None):
    """Null, empty, blank, very long, repeated and odd rows, with extra columns of clashing names."""
    long = "word " * 30_000 + "x" * 9000
    texts = [None, "", "  \n", "the same text of five words", "the same text of five words", "The Same text of five words", long, long + "y", "naïve café 日本 'll <|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "the same text of five words"), (None, "no id"), (None, None)] if rows is None else rows
    return spark.createDataFrame([(i, t, None, "s", 1, 2, "d", "b", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return edge_docs(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return edge_docs(spark, []).limit(0)


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def got(name, spark):
    return queries.QUERIES[name](spark, SF).toPandas()


# Exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_binary_fuse(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = exact_dedup.BinaryFuse8.build(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(n + 1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert n == 0 or f.contains(other).mean() < 0.02
    assert n < 20_000 or len(f.cells) < 1.45 * n


def groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[t or ""].append(i)
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, edges, weak):
    digest = (lambda c: F.lit("same").cast("binary")) if weak else exact_dedup.digest_sha256
    for old in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        rows = exact_dedup.exact_dedup(edges, old, digest).collect()
        want = groups([(r.doc_id, r.text) for r in edges.collect()])
        found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)
        top = {t: max((i for i in ids if i is not None), default=None) for t, ids in want.items()}
        assert found == Counter((i, top[t], len(ids), i == top[t]) for t, ids in want.items() for i in ids)


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = list(prints)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: root(i) for i in ids}


def test_simhash_query(spark, documents):
    prints = {r.doc_id: plain_fingerprint(r.text) for r in documents.itertuples()}
    want = plain_components(prints)
    rows = got("op3_simhash", spark)
    assert dict(zip(rows.doc_id, rows.fingerprint, strict=True)) == {i: f"{p:016x}" for i, p in prints.items()}
    assert dict(zip(rows.doc_id, rows.component_id, strict=True)) == want


def test_simhash_crowded_blocks(spark, monkeypatch):
    """Many fingerprints about one, dealt as tiles, and chains of close ones."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(80)}
    prints = dict(enumerate(sorted(values)))
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    links = simhash.links(spark.createDataFrame(rows, "fp long, rep long"))
    labels = {r.id: r.component for r in common.components(links).collect()}
    assert {i: labels.get(i, i) for i in prints} == plain_components(prints)


def test_simhash_edges(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == 12 and {r.component_id for r in rows if r.fp == 0} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_rows_without_an_id_link_others(spark):
    """A fingerprint that no id has still stands between others; a component without an id has none."""
    prints = {0: 1, 15: None, 255: 2, (1 << 40) - 1: None, (1 << 63) + (0xFFFF << 40): 7}
    monkey = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for f, i in prints.items()], "doc_id long, fp long")
    original = simhash.fingerprints
    simhash.fingerprints = lambda *a: monkey
    try:
        rows = simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect()
    finally:
        simhash.fingerprints = original
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter([(None, None), (None, 1), (1, 1), (2, 1), (7, 7)])


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_long_chains_take_few_rounds(spark, monkeypatch, order):
    """A chain of 1,000 links takes the logarithm of its length, not its length."""
    written, keep = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, label: written.append(label) or keep(df, label))
    ids = list(range(1001))
    if order == "falling":
        ids.reverse()
    if order == "mixed":
        random.Random(3).shuffle(ids)
    found = common.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")).collect()
    assert {r.id for r in found} == set(ids) and {r.component for r in found} == {0}
    rounds = written.count("links") - 1
    assert rounds <= (1 if order != "mixed" else 10) and written.count("parents") <= (12 if order != "mixed" else 30)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}


# Encoding


ALPHABET = [*"abtheINé ÉüßñÈ'sltrem0123.,;!#$日😀́̈ΣςİǅⅫ²KÅ", *map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x2009, 0x2028, 0x3000, 0x200B]), "<|endoftext|>", "<|STARTOFTEXT|>", "<|endo", "  ", "'ll"]


def odd_texts(n):
    rng = random.Random(n)
    for i in range(n):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50)))
        yield rng.choice(["a", "ab", "the", "é", "0", "=", "ha", "😀", "abthe"]) * rng.randint(1, 300)
        yield "".join(rng.choice("abthein") for _ in range(rng.randint(0, 300)))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_encoders_equal_the_library(monkeypatch):
    byte, word, own, runs = library(BYTE), library(WORD), bpe.Encoder(BYTE, leaf=16), token_files.WordEncoder(WORD)
    monkeypatch.setattr(bpe, "WINDOW", 40)
    for text in odd_texts(400):
        ids = byte.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == byte.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(runs.encode(text.encode(), window=13), "<i4").tolist() == word.encode(text, add_special_tokens=False).ids


def test_frequent_words_are_learned_once(monkeypatch):
    """Words that keep coming are not encoded again when the tables are full, which hold no more than their share."""
    monkeypatch.setattr(token_files, "CACHE", 50)
    word, runs, rng = library(WORD), token_files.WordEncoder(WORD), random.Random(4)
    taken, merges = Counter(), runs.merges

    class Merges:
        def tokenize(self, piece):
            taken[piece] += 1
            return merges.tokenize(piece)

    runs.merges = Merges()
    for i in range(200):
        text = " ".join(["often", "Often,", "größe", "größe.", "naïve", *(f"{rng.choice(['ab', 'Éb', 'the'])}{''.join(rng.choices('abcdeé', k=6))}{rng.choice(['', '.', ',!'])}" for _ in range(20)), "x" * 400, "日本"])
        assert np.frombuffer(runs.encode(text.encode()), "<i4").tolist() == word.encode(text, add_special_tokens=False).ids
        assert max(map(len, (runs.known, runs.before, runs.pieces))) <= 50 + 60 and all(len(w) <= token_files.LONG for w in runs.known)
    often = "".join(bpe.byte_letters()[b] for b in "größe".encode())
    assert taken["often"] == 1 and taken[often] == 1 and len(taken) > 3000


def test_bpe_query(spark, documents, edges, empty):
    t = library(BYTE)
    rows = got("op6_bpe", spark).set_index("doc_id")
    for r in documents.itertuples():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want = rows.loc[r.doc_id]
        assert want.n_tokens == len(ids) and want.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert want.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    found = bpe.decode(bpe.encode(edges, BYTE), BYTE).collect()
    assert Counter((r.doc_id, r.decoded) for r in found) == Counter((r.doc_id, r.text or "") for r in edges.collect())
    assert bpe.encode(empty, BYTE).count() == 0


def test_token_files(spark, documents, edges, empty, tmp_path):
    t, at = library(WORD), 0
    rows = got("op9_token_files", spark).set_index("doc_id")
    for r in documents.sort_values("doc_id").itertuples():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(rows.loc[r.doc_id]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for n, df in enumerate((edges, empty)):
        path = f"file://{tmp_path}/{n}"
        token_files.write_tokens(df, WORD, path, 2)
        back = token_files.read_tokens(spark, path)
        found = sorted(back.collect(), key=lambda r: r.start)
        assert len(found) == df.count() and [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    plan = spark.read.schema(token_files.SCHEMA).orc(f"file://{tmp_path}/0").where("doc_id = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan


def orc_reader(spark, file):
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    return jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))


def test_orc_files(spark, tmp_path, monkeypatch):
    """Stripes, row indexes, Bloom filters and run lengths as the files have them."""
    monkeypatch.setattr(token_files, "STRIPE", 1 << 16)
    docs = spark.range(30_000).selectExpr("id * 2 AS doc_id", "repeat('the end of it ', 1 + CAST(id % 40 AS int)) AS text")
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs.repartition(2), WORD, path, 2)
    stripes = 0
    for file in spark.read.orc(path).inputFiles():
        reader = orc_reader(spark, file)
        assert reader.getRowIndexStride() == token_files.STRIDE
        rows = reader.rows()
        for number, stripe in enumerate(reader.getStripes()):
            stripes += 1
            footer = rows.readStripeFooter(stripe)
            assert [footer.getColumns(i).getKind().toString() for i in range(1, 5)] == ["DIRECT_V2"] * 4
            kinds = {(footer.getStreams(i).getColumn(), footer.getStreams(i).getKind().toString()) for i in range(footer.getStreamsCount())}
            assert (1, "BLOOM_FILTER_UTF8") in kinds and {(i, "ROW_INDEX") for i in range(1, 6)} <= kinds and (2, "BLOOM_FILTER_UTF8") not in kinds
            every = spark.sparkContext._gateway.new_array(spark._jvm.boolean, 6)
            for i in range(6):
                every[i] = True
            index = rows.readRowIndex(number, every, every)
            assert index.getBloomFilterIndex()[1].getBloomFilterCount() == -(-stripe.getNumberOfRows() // token_files.STRIDE)
            assert index.getRowGroupIndex()[1].getEntryCount() == -(-stripe.getNumberOfRows() // token_files.STRIDE)
        rows.close()
        reader.close()
    assert stripes > len(spark.read.orc(path).inputFiles())
    back = token_files.read_tokens(spark, path)
    assert back.where("doc_id = 14").count() == 1 and back.where("doc_id = 15").count() == 0


def test_order_of_many_files(spark, tmp_path):
    """File numbers of unequal width, and rows that share an id over several files, keep their order."""
    path = tmp_path / "t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(i, "the cat " * (i % 5)) for i in range(60)] + [(20, f"same id {i}") for i in range(200)] + [(None, f"none {i}") for i in range(200)], "doc_id long, text string")
    token_files.write_tokens(docs.repartition(4), WORD, f"file://{path}", 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(path.glob("part-*.orc"))
    assert len({f for i in (20, None) for f in {r.file for r in token_files.read_tokens(spark, f"file://{path}").where(F.col("doc_id").eqNullSafe(F.lit(i))).collect()}}) > 1
    for n, f in enumerate(files):
        f.rename(path / f.name.replace(f.name[:10], f"part-{99_998 + n}", 1))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    found = sorted(token_files.read_tokens(spark, f"file://{path}").collect(), key=lambda r: r.start)
    assert len(files) > 2 and len(found) == 460
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(460)]
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)


# WARC


def test_warc(spark, tmp_path):
    big = "<p>é" * 30_000
    pages = [(1, "http://a", big), (2, "http://b c", "x" * 99), (3, None, "x" * 99), (5, "u", big), (4, "u", big), (6, "u", None), (7, "u", ""), (8, "u", "y\r\n\r\n" * 50), (None, "u", "z" * 200), (1, "http://a", big), (None, "u", big)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string")
    records = warc.plan(df)
    manifest = warc.write_archives(records, f"file://{tmp_path}", chunk=1000)
    rows = warc.read_archives(manifest, f"file://{tmp_path}", chunk=777)
    payloads, last = defaultdict(list), {}
    for r in rows.collect():
        payloads[r.page_id, r.record_type, r.payload_digest if r.last else None].append(r)
    ends = [r for r in rows.where("last").collect()]
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = h == big and i != 1
        want[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in ends) == want
    assert max(len(r.chunk) for r in rows.collect()) <= 777
    assert warc.round_trip(df.limit(0)).count() == 0


# Language model


def test_lattice_against_sums():
    pieces = [bytes([b]) for b in range(256)] + [b" t", b"th", b"the", b" the", b"he", b"e "]
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1))
    lattice = lattice_lm.Lattice(pieces, np.log(p[:-1]), float(np.log(p[-1])))
    score = dict(zip(pieces, p, strict=False))

    def ways(rest):
        if not rest:
            return [[]]
        return [[k, *w] for k in score if not k[1:].count(b" ") and rest.startswith(k) for w in ways(rest[len(k) :])]

    words = [b"the", b"thethe", b"t", b"", b"x\xff"]
    for w, s in zip(words, lattice.marginals(words), strict=True):
        assert s == pytest.approx(np.log(sum(np.prod([score[k] for k in way]) for way in ways(b" " + w))))
    uses = lattice.expected(words, np.array([1.0, 2, 3, 1, 1]))
    assert sum(u * len(k) for u, k in zip(uses, pieces, strict=True)) == pytest.approx(4 + 2 * 7 + 3 * 2 + 1 + 3)
    assert lattice.marginals([b"th" * 200])[0] == pytest.approx(lattice._long(b"th" * 200))


def test_lm_query(spark, documents, edges, empty, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HOT", 500)
    rows = got("op2_lattice_lm", spark).set_index("doc_id")
    docs = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in documents.itertuples()}
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in docs.items() if i not in out for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in docs.items():
        r = rows.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and np.isfinite(r.score) and r.score < 0
    held = rows[rows.held_out]
    assert held.score.sum() / held.n_tokens.sum() > -7 and held.mixed_score.sum() > held.score.sum()
    found = lattice_lm.score(edges, RANKS).toPandas()
    assert len(found) == 12 and found.score.notna().all() and np.isfinite(found.score).all()
    assert lattice_lm.score(empty, RANKS).count() == 0


# Classifiers


def licence_model(spark):
    return licence.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licence_templates_and_strangers(spark):
    """Each wording is confirmed; licences that were never shown, and talk of rights, are unknown or at least not confirmed."""
    model = licence_model(spark)
    for family, lines in licence.TEMPLATES.items():
        for line in lines:
            assert model.identify(line.encode())[0::2][:2] == (family, True), line
    shown = {x for rows in licence.examples() for x, _ in rows}
    strangers = ["Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Open Software License 3.0.", "This program is released under the WTFPL.", "The Unlicense", "distributed under the terms of the OpenLDAP Public License", "Released under the Sleepycat License.", "", "the of and", "zu einem mit dem", "The hotel is open to the public.", "permission to enter is granted to all guests"]
    for line in strangers:
        assert line.encode() not in shown and model.identify(line.encode())[0] == licence.UNKNOWN, line
    for line in ("all rights reserved for the guests of the hotel", "MIT is a university in Cambridge", "the gnu is an animal", "apache helicopters fly"):
        assert not model.identify(line.encode())[2], line


def test_licence_probabilities_are_calibrated(spark):
    """On texts of neither fit nor calibration the stated chance is about the share that is right."""
    model, rows = licence_model(spark), []
    for context in ("/* {} */", "Foo 1.2. {}", "{} All bugs are ours.", "As of May: {}"):
        rows += [(context.format(line), family) for family, lines in licence.TEMPLATES.items() for line in lines]
        rows += [(context.format(x), licence.UNKNOWN) for x in ("Licensed under the Eclipse Public License 2.0.", "Released under the Sleepycat License.", "The library opens at nine.", "Use the terms of the agreement.")]
    found = [(model.identify(licence.paragraphs(x.encode())[0]), want) for x, want in rows]
    right = np.array([r[0] == want for r, want in found])
    assert right.mean() > 0.95 and abs(np.mean([r[1] for r, _ in found]) - right.mean()) < 0.08
    assert 0.1 < model.temperature < 10
    fit, held = licence.examples()
    assert not {x for x, _ in fit} & {x for x, _ in held} and {y for _, y in held} == set(range(len(licence.TEMPLATES) + 1))


def test_wrapped_headers(spark):
    model = licence_model(spark)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    mit = " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n * to use, copy, modify and sell copies"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Keep this list."
    for family, text in (("GPL-3.0", gpl), ("MIT", mit), ("BSD", bsd)):
        assert model.identify(licence.paragraphs(text.encode())[0])[0::2][:2] == (family, True)
    assert licence.paragraphs(b"") == [b""] and licence.paragraphs(b"a\nb.\n\nc\n") == [b"a b.", b"c"]


def test_licence_query(spark, documents, edges, empty):
    """The query's confirmed families are those of a plain search for the five wordings of these texts, no more and no less."""
    rows = got("op1_licence", spark).set_index("doc_id")
    plain = {"licensed under cc by nc 4 0": "CC-BY-NC", "this work is licensed under the gnu general public license version 3": "GPL-3.0", "licensed under the apache license version 2 0": "Apache-2.0", "released under the mit license": "MIT"}
    for r in documents.itertuples():
        flat = b" ".join(licence.tokens((r.text or "").encode())).decode()
        want = {f for k, f in plain.items() if k in flat} | ({"Proprietary"} if "All rights reserved." in (r.text or "") else set())
        assert set(filter(None, rows.loc[r.doc_id].confirmed_families.split(","))) == want
    model = licence.train(empty)
    assert licence.scan(edges, model).count() == 12 and licence.scan(empty, model).count() == 0


def made_texts(rng, n, spark, repeats=1):
    """Texts of calm words, of which toxic ones hold rude words of two strengths: a strong word is rarer elsewhere than a weak one."""
    calm = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        degree = rng.randint(1, 3) if bad else 0
        rude = rng.sample(["vile", "rotten", "nasty", "foul"], degree) if bad else rng.sample(["vile", "rotten"], rng.random() < 0.04)
        rows.append((i, " ".join(rng.sample(calm, 25) + rude), int(bad), degree))
    docs = spark.createDataFrame([r[:2] for r in rows for _ in range(repeats)], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity_sample_is_written_by_few_tasks(spark, monkeypatch):
    """The bounded sample is not dealt out over as many tasks, and files, as a whole table; the model stays the same."""
    _, docs, labels = made_texts(random.Random(9), 400, spark)
    want, parts = toxicity.train(docs, labels, steps=40), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    monkeypatch.setattr(toxicity, "stored", lambda df, label: parts.append(len((out := common.stored(df, label)).inputFiles())) or out)
    try:
        found = toxicity.train(docs, labels, steps=40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) == 1 and 0 < parts[0] <= toxicity.PARTS
    assert found.weights == want.weights and found.cut == want.cut and (found.thresholds == want.thresholds).all()


def test_toxicity_grades_come_from_other_folds(spark):
    """No row's grade follows from its own label or a count; grades and severity rise with the degree on rows not learned from."""
    rng = random.Random(2)
    learned, docs, labels = made_texts(rng, 1200, spark, repeats=2)
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and set(model.weights) <= {"vile".encode(), b"rotten", b"nasty", b"foul", *(f"w{i}".encode() for i in range(60))}
    rows, _, _ = made_texts(random.Random(5), 2000, spark)
    above = model.above([model.margin(t.encode()) for _, t, _, _ in rows])
    toxic, degree = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert ((above[:, 0] >= model.cut) == toxic).mean() > 0.95 and (np.diff(above, axis=1) <= 0).all()
    severity = above.sum(axis=1)
    means = [severity[degree == k].mean() for k in range(4)]
    assert means == sorted(means) and means[3] > means[1] + 0.5


def test_toxicity_is_calibrated_in_order(spark):
    """On held-out rows the mean of P(grade > k) is the share of rows that their own fold's order puts above k."""
    rows, docs, labels = made_texts(random.Random(8), 2400, spark)
    learn, held = docs.where("doc_id % 3 > 0"), [r for r in rows if r[0] % 3 == 0]
    model = toxicity.train(learn, labels)
    names = sorted(model.weights)
    index = {w: i for i, w in enumerate(names)}
    pairs = [(i, index[w]) for i, r in enumerate(held) for w in set(toxicity.words(r[1].encode())) & index.keys()]
    at, cols = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    order = toxicity.grades(at, cols, np.array([r[2] for r in held], dtype=bool), len(names))
    above = model.above([model.margin(r[1].encode()) for r in held])
    for k in range(toxicity.LEVELS):
        assert abs(above[:, k].mean() - (order > k).mean()) < 0.05, k


def test_toxicity_query(spark, edges, empty):
    """Every row of the query against the model's own sums in plain Python; labelled rows fall on their sides."""
    folder = SF + "/../sf0.01"
    documents, labels = pd.read_parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").toxic
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = queries.op5_toxicity(spark, folder).toPandas().set_index("doc_id")
    assert len(rows) == len(documents)
    for r in documents.itertuples():
        x = sum(model.weights.get(w, 0.0) for w in set(toxicity.words((r.text or "").encode())))
        above = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        found = rows.loc[r.doc_id]
        assert found.severity == pytest.approx(sum(above)) and found.p_toxic == pytest.approx(above[0]) and found.toxic == (found.p_toxic >= model.cut)
        assert found.grade == np.argmax(-np.diff([1, *above, 0]))
    known = rows[rows.index.isin(labels.index)]
    assert (known.toxic == (labels.loc[known.index] > 0)).mean() > 0.94  # some labels are wrong
    assert toxicity.score(edges, model).count() == 12 and toxicity.score(empty, model).count() == 0
    null = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(edges, toxicity.train(edges, null)).where("toxic").count() == 0
    long = [b"a" * 100_000, b"A" * 100_000, b"b" * 100_000]
    assert toxicity.words(long[0]) == toxicity.words(long[1]) != toxicity.words(long[2]) and len(toxicity.words(long[0])[0]) == toxicity.PLAIN


# Packing


def naive_pack(rows, capacity):
    bins, out = [], [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][0]):
        n, s, c = rows[i]
        fits = [b for b in range(len(bins)) if bins[b][0] + n <= capacity and (s is None or s not in bins[b][1]) and (c is None or c not in bins[b][2])]
        b = min(fits, key=lambda b: (capacity - bins[b][0], b), default=len(bins))
        if b == len(bins):
            bins.append([0, set(), set()])
        out[i] = (b, bins[b][0])
        bins[b][0] += n
        bins[b][1].add(s)
        bins[b][2].add(c)
    return out


def test_best_fit_equals_the_plain_rule():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.randint(1, 60), rng.choice(["a", "b", "c", None, *range(20)]), rng.choice([None, *range(15)])) for _ in range(rng.randint(0, 80))]
        assert packing.pack_shard(rows, 100) == naive_pack(rows, 100)


def check_bins(rows, sizes, sources, capacity):
    pieces = defaultdict(list)
    for r in rows.itertuples():
        pieces[r.doc_id].append((r.start, r.length))
    for i, n in sizes.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n
    for _, g in rows.groupby("bin_id"):
        g = g.sort_values("offset")
        assert g.length.sum() + g.residual.iloc[0] == capacity and g.residual.nunique() == 1
        assert list(g.offset) == list(np.cumsum(g.length) - g.length)
        held = [sources[i] for i in g.doc_id if sources[i] is not None]
        assert len(held) == len(set(held))


def test_packing_query(spark, documents, edges, empty, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    rows = got("op8_packing", spark)
    check_bins(rows, {r.doc_id: len((r.text or "").encode()) + 1 for r in documents.itertuples()}, dict(zip(documents.doc_id, documents.source, strict=True)), packing.CAPACITY)
    found = packing.pack(edges).toPandas()
    assert found.length.sum() == sum(len((r.text or "").encode()) + 1 for r in edges.collect())
    assert packing.pack(empty).count() == 0


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    """Rows in any order and number of partitions, with many equal ones, go to the same places; bins fill well."""
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(docs.where("doc_id % 7 = 0")).union(spark.createDataFrame([(None, "same", "s")] * 300, docs.schema))
    found = [sorted(map(tuple, packing.pack(docs.repartition(n, *by)).select("doc_id", "piece", "start", "length", "bin_id", "offset", "residual").fillna(-1, ["doc_id"]).collect())) for n, by in ((1, []), (5, []), (3, ["source"]))]
    assert found[0] == found[1] == found[2] and len({b for *_, b, _, _ in found[0]}) < len(found[0])
    free = packing.pack(docs, source=None, cluster=F.lit(None)).groupBy("bin_id").agg(F.first("residual").alias("r"), F.first(F.split("bin_id", "-")[0]).alias("shard"))
    assert free.where("r > 4096").groupBy("shard").count().where("count > 1").isEmpty()  # two half-empty bins would have been one


# Nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 1200)] + rng.normal(size=(1200, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] * 16), (5004, [1.0]), (None, [1.0] * 16), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = permutation_index.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    scores, hits = x @ x.T, 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert g.score.values == pytest.approx(scores[q, g.vec_id], rel=1e-12)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        want = sorted((i for i in range(1200) if i != q), key=lambda i: (-scores[q, i], i))[:20]
        hits += len(set(want) & set(g.vec_id))
    assert found.query_id.nunique() == 60 and hits / 1200 >= 0.9
    few = permutation_index.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).toPandas()
    assert len(few) == 3 and permutation_index.nearest(df.limit(0), F.lit(True)).count() == 0


def brute_nearest(rows, queries, k):
    """All pairs: of equal rows the query's own counts once less."""
    out = {}
    for q in queries:
        v = min(v for i, v in rows if i == q)
        rest = list(rows)
        rest.remove((q, v))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rest)
        out[q] = [(i, pytest.approx(-s)) for s, i in scored[:k]]
    return out


def test_repeated_ids(spark):
    """Other rows of a query's id are candidates; equal rows come back as often as they occur, on any partitioning."""
    rng = random.Random(7)
    rows = [(i % 30, tuple(rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)) if i % 4 else (1.0, 0.0, 0.5)) for i in range(90)]
    rows = [r for r in rows if any(r[1])] + [(0, (1.0, 0.0, 0.5))] * 25
    want = brute_nearest(rows, [0, 10, 20], 20)
    for parts in (1, 5):
        rng.shuffle(rows)
        df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>").repartition(parts)
        found = permutation_index.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
        assert {q: [(r.vec_id, r.score) for r in found if r.query_id == q] for q in want} == want and len(found) == 60


@pytest.mark.parametrize("block", [256, 8192])
def test_unequal_lengths_and_share(spark, monkeypatch, block):
    """Vectors of very unequal length keep their recall while a part of each block is reranked."""
    monkeypatch.setattr(permutation_index, "BLOCK", block)
    read = []
    monkeypatch.setattr(permutation_index, "_share", lambda *a, f=permutation_index._share: read.append(f(*a)) or read[-1])
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)) * np.exp(rng.normal(0, 0.5, 3000))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = permutation_index.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    scores, hits = x @ x.T, 0
    for q, g in found.groupby("query_id"):
        want = [i for i in np.argsort(-scores[q], kind="stable") if i != q][:20]
        hits += len(set(want) & set(g.vec_id))
    assert hits / 3000 >= 0.9 and read[0] < 0.5


def test_pivots_stay_apart(spark):
    """A crowd of like vectors gives one pivot."""
    rng = np.random.default_rng(6)
    x = np.r_[np.ones((300, 16)) + rng.normal(0, 0.01, (300, 16)), rng.normal(size=(300, 16))]
    pivots = permutation_index._pivots(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>"), float((x * x).sum(axis=1).max()))
    pivots = pivots[:, :16] / np.linalg.norm(pivots[:, :16], axis=1, keepdims=True)
    near = pivots @ pivots.T - np.eye(len(pivots))
    assert near.max() <= permutation_index.APART + 1e-9 and (pivots[:, :16] @ np.ones(16) / 4 > 0.99).sum() <= 1 and len(pivots) > 100


def test_bounded_samples(spark):
    rows = spark.range(5000)
    kept = [r.id for r in common.least_hashes(rows, "id", 40, "id").collect()]
    want = [r.id for r in rows.orderBy(F.xxhash64("id")).limit(40).collect()]
    assert kept == want and common.least_hashes(rows.limit(0), "id", 40).count() == 0
    words = spark.createDataFrame([(str(i).encode(), i % 50) for i in range(1000)], "word binary, c long")
    found = lattice_lm.frequent_words(words, "c", 100).collect()
    assert 0 < len(found) <= 100 and min(r.c for r in found) > 40
    assert lattice_lm.frequent_words(words.limit(0), "c", 10).count() == 0 and lattice_lm.frequent_words(words, "c", 10**6).count() == 980


def test_recall_on_embeddings(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found = got("op7_permutation_index", spark)
    hits = total = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[ids == q][0]
        want = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits, total = hits + len(set(want) & set(g.vec_id)), total + 20
    assert hits / total >= 0.9


# The pipeline


def plain_near(texts):
    """(index) of the rows that stay: the first by id of each component of 5-word Jaccard 0.8 or more, over all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for _, t in texts]
    top = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if top[a] != top[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            old, new = top[b], top[a]
            top = [new if x == old else x for x in top]
    return [min((i for i in range(len(texts)) if top[i] == k), key=lambda i: (texts[i][0] is None, texts[i][0] or 0, hashlib.sha256((texts[i][1] or "").encode()).digest())) for k in set(top)]


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    left = docs
    for step, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = left.toPandas()
        left = common.stored(stage(spark, left, SF), f"test{step}")
        after = left.toPandas()
        assert list(after.columns) == list(documents.columns)
        if step == 0:
            assert (before.doc_id.isin(after.doc_id)).mean() > 0.8
        if step == 1:
            assert sorted(after.doc_id) == sorted(before.groupby(before.text.fillna("")).doc_id.max())
        if step == 2:
            rows = list(zip(before.doc_id, before.text, strict=True))
            assert sorted(after.doc_id) == sorted(rows[i][0] for i in plain_near(rows))
    packed = corpus_pipeline.STAGES[3][1](spark, left, SF).toPandas()
    check_bins(packed, {r.doc_id: len((r.text or "").encode()) + 1 for r in after.itertuples()}, dict(zip(after.doc_id, after.source, strict=True)), packing.CAPACITY)


def test_stages_decide_by_row(spark):
    """Rows that share an id or have none are judged by their own text, and no copy outlives its stage."""
    a, b, c = "one two three four five six seven eight", "alpha beta gamma delta epsilon zeta", "quite another text that is like no other one"
    near_a = a + " nine"
    rows = [(1, a), (1, b), (2, a), (2, a), (3, None), (3, ""), (None, a), (None, c), (None, c), (4, near_a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = common.stored(corpus_pipeline.exact(spark, docs, SF), "rows")
    found = pairs(exact)
    assert Counter({(i, t or ""): n for (i, t), n in found.items()}) == Counter([(1, b), (2, a), (3, ""), (None, c), (4, near_a)])
    near = pairs(corpus_pipeline.near(spark, exact, SF))
    assert Counter({(i, t or ""): n for (i, t), n in near.items()}) == Counter([(1, b), (2, a), (3, ""), (None, c)])
    shared = spark.createDataFrame([(1, a), (1, near_a), (1, c), (0, near_a + " ten")], "doc_id long, text string")
    assert pairs(corpus_pipeline.near(spark, shared, SF)) == Counter([(0, near_a + " ten"), (1, c)])


def test_toxicity_stage(spark):
    """Texts with the words of labelled toxic ones go, whether labelled or not; clean ones stay, even if labelled wrongly."""
    folder = SF + "/../sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, left = docs.toPandas(), {r.doc_id for r in corpus_pipeline.clean(spark, docs, folder).select("doc_id").collect()}
    insults = set("loser idiot worthless scum pathetic moron clown trash disgusting stupid".encode().split())
    rude = before.text.map(lambda t: len(set(toxicity.words((t or "").encode())) & insults))
    gone = ~before.doc_id.isin(left)
    marked = before.doc_id.map(pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").toxic)
    assert gone[rude > 0].mean() > 0.97 and gone[marked == 0].mean() < 0.03 and gone[rude == 0].mean() < 0.01


def test_rejected_rows_take_no_siblings(spark):
    _, learned, labels = made_texts(random.Random(3), 800, spark)
    model = toxicity.train(learned, labels)
    docs = spark.createDataFrame([(1, "w1 w2 vile nasty foul"), (1, "w1 w2 w3"), (None, "nasty foul vile"), (None, None)], "doc_id long, text string")
    assert pairs(docs.where(~toxicity.rejected(model))) == Counter([(1, "w1 w2 w3"), (None, None)])


def test_stages_take_empty_tables_and_odd_rows(spark, edges, empty):
    columns = "doc_id", "text", "lang", "source", "n_chars"
    for df in (empty, edges):
        left = df.select(*columns)
        for name, stage in corpus_pipeline.STAGES:
            left = common.stored(stage(spark, left, SF), f"edge-{name}")
        assert df is not empty or left.count() == 0
