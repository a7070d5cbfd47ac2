"""Manifest, collocations and substring dedup against plain Python, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, LONG, PROSE, TEXTS, WORD
from wirefold.llm import collocations, merkle, repeats


@pytest.fixture(scope="module")
def awkward(spark):
    clash = CLASH + ["hash", "position", "block", "leaf", "path", "lang", "ws", "n", "a", "k1", "starts", "kept_text"]
    rows = [(i, t, "src" if (i or 0) % 2 else None, len(t or ""), *["clash"] * len(clash)) for i, t in TEXTS]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame(rows, schema)


# --- manifest ------------------------------------------------------------------------------------
def sha(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf_of(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Levels from the leaves to the root, and each leaf's siblings (left, right)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i:i + 3]) for i in range(0, len(last), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i - i % 3
            path.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result rows of the query."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        subs[s] = tree([leaf_of(*r) for r in by[s]])
    root, upper = tree([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, upper):
        for r, path in zip(by[s], subs[s][1]):
            d, text = r[0], r[4]
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf_of(*r[:4], text)
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((d, leaf_of(*r), subs[s][0], root, sha(*[a + b for a, b in path + top]), h, h == root))
    return sorted(out, key=repr)


def audited(docs):
    even = F.crc32(docs.doc_id.cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate(docs.text, "\n", "")).otherwise(docs.text)
    found = merkle.audit(docs, {"text": text})
    return sorted((tuple(r) for r in found.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))), "folded_root", "verified").collect()), key=repr)


def test_manifest_awkward_rows(spark, awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    rows = [(i, "src" if (i or 0) % 2 else None, None, len(t or ""), t) for i, t in TEXTS]
    got = audited(docs)
    assert got == manifest(rows)
    assert {r[-1] for r in got} == {True, False} or all(r[-1] for r in got)
    assert audited(docs.limit(0)) == []


@pytest.mark.parametrize("sizes", [(1,), (244, 1, 729, 3), (730, 243)])
def test_manifest_of_every_shape(spark, sizes):
    rows = [(i * 7 - 50, f"s{s}", "en", i, f"t{s}\n{i}" if i % 3 else "plain") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert audited(docs) == manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"s{i % 300}", None, None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert audited(docs) == manifest(rows)


# --- collocations --------------------------------------------------------------------------------
def phrases(rows, longest=5, least=100, inside=100, top=2000):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= inside * f[p[i:i + m]]:
                        covered.add(p[i:i + m])
        found = []
        for p, a in cand.items():
            if p not in covered:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,inside,bits", [(3, 100, 24), (2, 60, 4), (5, 100, 3)])
def test_collocations_match_plain_counts(spark, least, inside, bits):
    texts = ["New York city. New York city! old\tYork, new York; é ß é ß", "a a a a a a a\na a a", "", None, "one", PROSE,
             "b c d e f g " * 6, "c d e f, b c d. b c d e? x", LONG[:20_000]]
    rows = [(lang, t) for lang in ("en", None, "de") for t in texts[: 9 if lang else 5]] + [("en", texts[0])] * 3
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, text string, ws string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=least, inside=inside, bits=bits).collect())
    assert got == phrases(rows, least=least, inside=inside)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_scores_pass_64_bits():
    a = n = l = r = 10 ** 12
    assert 1000 * a * n > 2 ** 64 and 1000 * a * n // (l * r) == 1000


def test_large_products_stay_exact(spark):
    row = spark.createDataFrame([(9_999_999_999_999, 99_999_999_999_999, 10_000_000_000_001, 9_999_999_999_999)],
                                "a long, n long, l long, r long")
    got = row.select(collocations.score("a", "n", "l", "r").alias("s")).first().s
    assert got == 1000 * 9_999_999_999_999 * 99_999_999_999_999 // (10_000_000_000_001 * 9_999_999_999_999)


# --- repeats -------------------------------------------------------------------------------------
def unrepeated(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def kept(docs, **more):
    found = repeats.without_repeats(docs, **more)
    return sorted((tuple(r) for r in found.select("all_words", "repeat_words", "kept_text").collect()), key=repr)


def test_repeats_awkward_rows(spark, awkward):
    assert kept(awkward) == sorted(unrepeated([t for _, t in TEXTS]), key=repr)
    assert kept(awkward.limit(0)) == []
    out = repeats.without_repeats(awkward.drop("kept_text"))
    assert set(awkward.columns) <= set(out.columns)


@pytest.mark.parametrize("bits", [5, 20])
def test_repeats_around_shared_passages(spark, bits):
    w = [f"w{i}" for i in range(400)]
    shared = w[100:160]
    texts = [" ".join([f"a{i}x{j}" for j in range(i)] + shared[: 35 + i % 26] + [f"b{i}x{j}" for j in range(5)]) for i in range(40)]
    texts += [" ".join(w[:34]), " ".join(w[:34]), " ".join(w[200:235]), " ".join(["x", *w[200:235], "y"]), "z " * 36, "q " * 35, "r " * 90]
    texts += [" ".join(w[300:340] + ["m"] + w[300:340]), " ".join(w[300:336]), " ".join(w[301:336] + ["n"])] + ["same text " * 30] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert kept(docs, bits=bits) == sorted(unrepeated(texts), key=repr)


def test_every_window_is_in_one_run():
    for n in (0, 34, 35, 36, 500):
        a, first, size, whole = repeats._seeds(" ".join(f"v{i % 61}" for i in range(n)), 35, 16)
        assert len(whole) == max(0, n - 34) == size.sum() and len(a) == len(first)
