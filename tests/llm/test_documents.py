"""The operators on documents against brute force, with nulls, empties, repeated rows, ties and clashing columns."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskgraph.llm import language_id, mixing, ngram_join, packing, recompression, secrets, token_counts
from riskgraph.llm.common import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def counted(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("n", "percent", "common"), [(4, 85, 4), (5, 80, 4), (4, 85, 2)])
def test_ngram_join(docs, rows, monkeypatch, n, percent, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    got = counted(ngram_join.jaccard_components(docs, n=n, percent=percent))
    sets = []
    for r in rows:
        w = WORDS.findall((r[1] or "").translate(FOLD))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    assert got == Counter((r[0], len(sets[i]), least.get(root[i])) for i, r in enumerate(rows))


def test_one_of_each_keeps_one_of_a_group(docs, rows):
    kept = ngram_join.one_of_each(docs, n=4, percent=85).collect()
    assert Counter(r.doc_id for r in kept)[8] == 1 and 9 not in {r.doc_id for r in kept}
    assert {0, 1, 2, 3} <= {r.doc_id for r in kept}


@pytest.mark.parametrize("held", [50, 2_000_000])
def test_recompression(docs, rows, monkeypatch, held):
    monkeypatch.setattr(recompression, "HELD", held)
    got = counted(recompression.remove_repeats(docs))
    words = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[(r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert got == want


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = counted(token_counts.count_tokens(docs, path))
    want = Counter()
    for r in rows:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 512)] += 1
    assert got == want


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        ids = memoryview(p.ids).cast("I").tolist()
        assert len(ids) == p.length <= 2048
        pieces[p.doc_id].append((p.start, tuple(ids), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, ids in want:
        n = want[(doc_id, ids)]
        mine = [x for x in pieces[doc_id] if x[2] == len(ids)]
        assert {i for s, part, _ in mine for i in range(s, s + len(part))} == set(range(len(ids)))
        if doc_id is not None:
            assert sum(len(part) for _, part, _ in mine) == n * len(ids)
            assert all(ids[s : s + len(part)] == part for s, part, _ in mine)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't there")
def test_little_padding(spark):
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.max("end").alias("longest"), F.count_if(F.col("n") != F.col("end")).alias("gaps")).first()
    assert filled.longest <= 2048 and filled.gaps == 0
    assert filled.sequences * 2048 - filled.tokens <= 0.01 * filled.tokens


def test_cut_plan_covers_every_length():
    import numpy as np

    lengths = np.arange(1, 6000)
    row, start, size, kind = packing.cut_plan(lengths, 2048)
    slots = np.array([2048 // k for k in packing.class_counts(2048)])
    assert (size <= slots[kind]).all() and (size > 0).all()
    assert (np.bincount(row, size).astype(int) == lengths).all()
    order = np.lexsort((start, row))
    same = np.diff(row[order]) == 0
    assert ((start[order][:-1] + size[order][:-1])[same] == start[order][1:][same]).all()


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weight[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full or open_
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(taken[s] == int(target[s]) for s in names)
    assert Counter(map(tuple, got)) == counted(mixing.mix(docs.repartition(5)))


def test_mixed_documents_have_the_words_of_the_mix(docs):
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(len(WORDS.findall(r.text or "")) for r in mixing.mixed_documents(docs).collect()) == taken


PATTERNS = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}


def base_spans(text: str) -> str:
    found = [(m.start(), i, k, m.end()) for i, (k, (p, g, n)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text, re.A) if len(m.group(g)) >= n]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_scan(docs, rows):
    from pyspark.sql import functions as F

    got = secrets.scan(docs).select("doc_id", secrets.written(F.col("base")).alias("b"))
    assert counted(got) == Counter((r[0], base_spans(r[1] or "")) for r in rows)


def test_ownership_tells_copied_from_owned(spark):
    live, copied = "aB3dE5gH7jK9mN1pQ3sT", "zY9xW7vU5tS3rQ1pO9nM"
    made = [(i, f"é see {copied} here", "en", f"s{i}", 0) for i in range(5)] + [(9, f"é see {live} here", "en", "s9", 0)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found] for r in secrets.scan(df).collect()}
    assert found[9] == [("mixed", 6, 26)] and all(not found[i] for i in range(5))
    assert {r.doc_id: r.text for r in secrets.redacted(df).collect()}[9] == "é see [SECRET] here"


def brute_scan(rows: list[tuple]) -> Counter:
    """Every row's added spans, live and copied base spans, by the rules of secrets.scan() written out."""
    base, more, owners, repos = [], [], defaultdict(set), defaultdict(set)
    for r in rows:
        text, owner, repo = r[1] or "", r[3] or "", f"{r[3] or ''}/{r[2] or ''}"
        base.append([(m.start(), m.end(), m.group(g)) for p, g, n in PATTERNS.values() for m in re.finditer(p, text, re.A) if len(m.group(g)) >= n])
        long = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text)]
        more.append([x for x in long if all(re.search(c, x[2]) for c in ("[a-z]", "[A-Z]", "[0-9]")) and len(set(x[2])) >= 8])
        for _, _, v in base[-1] + more[-1]:
            owners[v].add(owner)
            repos[v].add(repo)
    own = {v for v in owners if len(owners[v]) <= 1 and len(repos[v]) <= 2}
    copied = {v for v in owners if len(owners[v]) >= 3 or len(repos[v]) >= 6}
    out = Counter()
    for r, b, m in zip(rows, base, more, strict=True):
        added = [(s, e) for s, e, v in m if v in own and not any(s < y and x < e for x, y, _ in b)]
        out[(r[0], tuple(added), sum(v in own for *_, v in b), sum(v in copied for *_, v in b))] += 1
    return out


@pytest.mark.parametrize("share", [2, 100_000])
def test_added_spans_live_and_copied(spark, docs, rows, monkeypatch, share):
    monkeypatch.setattr(secrets, "SHARE", share)
    value, other, third = "aB3dE5gH7jK9mN1pQ3sT", "zY9xW7vU5tS3rQ1pO9nM", "Qw3Er5Ty7Ui9Op1As2Df4"
    texts = [f"see {value}, token={other}", f"{third} password: {third}", f"api_key = '{value}' {other}", "x" * 30, "a1B2" * 20]
    many = [(1000 + i, texts[i % 5], ("en", "de", "fr")[i % 3], f"s{i % 2}" if i % 5 == 1 else f"s{i % 7}", 0, "clash") for i in range(60)]
    many += [(2000 + i, f"{draw}Ab9 {draw}Xy1Zw secret={draw}", None if i % 2 else "en", f"own{i}", 0, "clash") for i, draw in enumerate(["Kd83jdKs02kdLs93", "Mn4Bv5Cx6Zl7Kj8Hg", "Pq1Wo2Ei3Ru4Ty5"])]
    whole = rows + many
    df = docs.union(spark.createDataFrame(many, docs.schema))
    got = Counter((r.doc_id, tuple((x.start, x.end) for x in r.found if x.kind == "mixed"), r.n_live, r.n_copied) for r in secrets.scan(df).collect())
    assert got == brute_scan(whole)
    masked = Counter(r.doc_id for r in secrets.redacted(df).collect())
    assert masked == Counter(r[0] for r in whole)


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abcdefghijkl{i:04d}" for i in range(1500))
    df = spark.createDataFrame([(1, text, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    assert secrets.scan(df).select(secrets.written(F.col("base"))).first()[0] == base_spans(text)


def test_language_id(spark, docs, rows):
    import zlib

    seen = [(1000 + i, f"{w} " * 9, lang, "s", 1) for i, (w, lang) in enumerate([("the and of with", "en"), ("der und die für", "de")] * 20)]
    labelled = spark.createDataFrame(seen, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.learn(labelled)
    assert model.languages == ["de", "en"]
    told = {r.doc_id: r for r in language_id.identify(labelled, model).collect()}
    assert all(told[d].lang_pred == lang and 0 <= told[d].score <= 1 for d, _, lang, _, _ in seen)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(rows)
    want = {r[0]: not any(map(str.isalpha, r[1] or "")) for r in rows if r[0] is not None}
    assert all((r.lang_pred == "und") == want[r.doc_id] for r in out if r.doc_id is not None)
    held = {r[0]: r[1] for r in docs.select("doc_id", language_id.held_out()).collect()}
    assert all(held[d] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in held if d is not None) and held[None] is False


def brute_bayes(labelled: list[tuple], texts: list[str], buckets: int, alpha: float) -> list[tuple[str, float]]:
    """Naive Bayes over hashed n-grams with Python numbers alone."""

    def mixed(x: int) -> int:
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def grams(text: str) -> Counter:
        points, out = [ord(c) for c in text.lower()], Counter()
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                h = 0
                for p in points[i : i + n]:
                    h = (h * 0x110001 + p + 1) % 2**64
                out[mixed((h + (n << 58)) % 2**64) >> (64 - buckets.bit_length() + 1)] += 1
        return out

    seen, rows = defaultdict(Counter), Counter()
    for text, lang in labelled:
        seen[lang] += grams(text)
        rows[lang] += 1
    out = []
    for text in texts:
        scores = {}
        for lang in sorted(seen):
            whole = sum(seen[lang].values()) + alpha * buckets
            scores[lang] = math.log(rows[lang] / sum(rows.values())) + sum(k * math.log((seen[lang][g] + alpha) / whole) for g, k in grams(text).items())
        best = max(scores, key=scores.get)
        out.append((best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())) if any(map(str.isalpha, text)) else ("und", 0.0))
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_naive_bayes_against_plain_python(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    draw = random.Random(8)
    seen = [(i, "".join(draw.choice(f"{letters} ") for _ in range(draw.randrange(1, 60))), lang) for i in range(60) for lang, letters in (("aa", "abcde"), ("bb", "bcdef"), ("cc", "öcd"), ("dd", "xyzabcdef"), ("ee", "xyz"))]
    labelled = spark.createDataFrame([(i, t, lang) for i, t, lang in seen], "doc_id long, text string, lang string")
    texts = ["a", "abc def", "ööö", "xyz" * 40, "", "123", "zebra crossing", "é"] + [t for _, t, _ in seen[:40]]
    want = brute_bayes([(t, lang) for _, t, lang in seen], texts, 1 << 16, 0.05)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, language_id.fit(labelled)).collect()}
    for i, (lang, odds) in enumerate(want):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(odds, rel=1e-6)


def test_equally_likely_languages_go_by_name(spark):
    labelled = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (3, "same words", "c")], "doc_id long, text string, lang string")
    for r in language_id.identify(labelled, language_id.fit(labelled)).collect():
        assert r.lang_pred == "a" and r.score == pytest.approx(1 / 3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't there")
def test_held_out_accuracy(spark):
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.identify(labelled, language_id.learn(labelled), keep=("doc_id", "lang")).where(language_id.held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    recall = {r.lang: (r.right, r.n) for r in told.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count("*").alias("n")).collect()}
    assert len(recall) >= 4 and all(right >= 0.97 for right, n in recall.values() if n >= 20), recall


def test_nothing_learned_nothing_told(docs, empty):
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(empty)).collect()} == {"und"}


def test_empty_tables(empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    for out in (ngram_join.jaccard_components(empty), recompression.remove_repeats(empty), token_counts.count_tokens(empty, path), packing.pack(empty, path), mixing.mix(empty), secrets.scan(empty), ngram_join.one_of_each(empty), mixing.mixed_documents(empty), secrets.redacted(empty)):
        assert out.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
