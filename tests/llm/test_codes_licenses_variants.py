"""Vector codes, licence templates and spelling variants against plain Python, on small and awkward tables."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from quillpool.llm import codes, licenses, notices, variants

from .test_operators import awkward, key, nothing, text_of  # noqa: F401

# --- vector codes


def plain_codes(rows, entries=256, parts=4, rounds=4):
    """rows: (vec_id, vec, label). Whole numbers, one distance at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    cut = lambda v: [v[p * size // parts : (p + 1) * size // parts] for p in range(parts)]
    fit = [r for r in order if len(r[1]) == size]
    books = [[cut(v)[p] for _, v, _ in fit[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in fit:
                groups.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        if len(v) != size:
            out.append([i, None, None, label])
            continue
        found = [near(x, b) for x, b in zip(cut(v), books)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
    total = {}
    for _, _, e, label in out:
        if e is not None:
            total[label] = total.get(label, 0) + e
    return sorted(key(i, c, e, total.get(label), sha) for i, c, e, label in out)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, code string, error double"


def test_op11_is_plain(spark, tmp_path):
    rng = np.random.default_rng(2)
    near = lambda: (rng.integers(-6, 6, 8) / 1024 + rng.integers(-1, 1)).astype(np.float32).tolist()  # noqa: E731  many ties
    rows = [(int(i), near(), int(i) % 3 if i % 7 else None, "x", 0.5) for i in rng.permutation(320)]
    rows += [rows[5], rows[5], (None, near(), None, None, None), (400, None, 1, None, None), (401, [1.0, None] * 4, 1, None, None)]
    rows += [(402, [float("nan")] * 8, 1, None, None), (403, [float("inf")] * 8, 1, None, None), (404, [0.5] * 4, 9, None, None), (405, [], 1, None, None)]
    rows += [(406, [float(x) for x in (300, -300, 0.25, 100, -2.5, 7, 77, -0.0001)], 2, None, None)]
    spark.createDataFrame(rows, EMBEDDINGS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = __spark_entry__.queries()["op11_codes"](spark, str(tmp_path)).collect()
    want = plain_codes([r[:3] for r in rows])
    assert sorted(key(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want
    assert len(got) == len(rows) - 4


def test_op11_small_and_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, vec array<float>")
    assert codes.compress(df).count() == 0 and codes.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    few = spark.createDataFrame([("b", None, [1.0, 2.0, 3.0, 4.0]), ("a", None, [1.0, 2.0, 3.0, 5.0])], "vec_id string, label int, vec array<double>")
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in codes.compress(few).collect()} == {("a", "00000000", 0, 0), ("b", "00000001", 0, 0)}
    with pytest.raises(ValueError):
        codes.compress(few.withColumn("vec", F.slice("vec", 1, 3)))
    with pytest.raises(ValueError):
        codes.train(codes.usable(few), entries=300)
    huge = few.withColumn("vec", F.transform("vec", lambda x: x * 1e30))
    with pytest.raises(Exception, match="do not fit a long"):
        codes.compress(huge).collect()


def test_codes_stand_for_vectors(spark):
    rng = np.random.default_rng(4)
    df = codes.usable(spark.createDataFrame([(i, 0, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, label int, vec array<double>"))
    books = codes.train(df, entries=256)
    coded = codes.encode(df, books)
    for r in codes.decode(coded, books).join(df, "vec_id").collect():
        assert np.abs(np.array(r.approximate) - r.vec).max() <= 0.5 / 1024 + 1e-9  # every vector is an entry of its own
    assert books.dimensions == 8 and len(books.sha256()) == 64


@given(st.integers(0, 10**6), st.sampled_from([2, 700, 2**20, 2**27]), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_nearest_is_exact(seed, size, width):
    """Screening in float32 never loses the nearest entry, far beyond what float32 holds exactly."""
    rng = np.random.default_rng(seed)
    points = rng.integers(-size, size, (30, width))
    book = np.concatenate([rng.integers(-size, size, (10, width)), points[:5] + rng.integers(-1, 2, (5, width)), points[:3]])
    index, error = codes.nearest(points, book, at_once=64)
    d = ((points[:, None, :] - book[None]) ** 2).sum(2)
    assert (error == d.min(1)).all() and (index == d.argmin(1)).all()


# --- licence templates


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_accepts(tree, words):
    """Ends of the runs from the first word on that a parsed template accepts."""
    ends = {0}
    for x in tree:
        if isinstance(x, bytes):
            ends = {e + 1 for e in ends if e < len(words) and words[e].encode() == x}
        elif isinstance(x, licenses.Any):
            ends = {e + k for e in ends for k in range(x.least, x.most + 1) if e + k <= len(words)}
        elif isinstance(x, licenses.Choice):
            ends = {e + len(w) for e in ends for w in x.wordings if tuple(y.encode() for y in words[e : e + len(w)]) == w}
        else:
            ends |= {e + k for e in ends for k in plain_accepts(x.inner, words[e:])}
    return ends


def plain_scan(text):
    words = plain_words(text)
    base = [(i, label, len(p.split())) for label, p in notices.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = [(label, m) for _, label, m in base]
    for label, markup in notices.NOTICES:
        tree = licenses.parse(markup)
        if any(plain_accepts(tree, words[i:]) for i in range(len(words))):
            found.append((label, licenses.mandatory(tree)))
    at, most = [i for i, *_ in base], max((m for _, m in found), default=0)
    joined = lambda names: ",".join(sorted(set(names)))
    return len(words), len(at), min(at, default=None), max(at, default=None), joined(x for _, x, _ in base), joined(x for x, _ in found), most / (most + 4)


def filled(markup, rng, drop=0.0):
    """A text that a template accepts: some optional regions, and some wording for others."""
    while "[[" in markup:
        markup = re.sub(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", lambda m: m[1] if rng.random() > drop else "", markup, flags=re.S)
    some = lambda m: " ".join(rng.choice(["Foo", "2021", "bar,", "ACME", "http://x.test/a"]) for _ in range(1))
    return re.sub(r"\{\{(.*?)\}\}", lambda m: some(m) if re.fullmatch(r"\d+-\d+", m[1]) else rng.choice(m[1].split("|")), markup)


@pytest.fixture(scope="module")
def licensed():
    rng = random.Random(8)
    texts = ["Released under the MIT License.", "MIT license, mit LICENSE; Apache-License", "the mit licenses", "GNU Lesser General Public License", "Licensed under CC BY-NC 4.0.", "licensed under cc by sa 4 0 international license", "é mit license"]
    for _, markup in notices.NOTICES:
        whole = filled(markup, rng)
        texts += [whole, text_of(rng, 40) + " " + filled(markup, rng, 0.5).upper() + " " + text_of(rng, 40)]
        words = whole.split()
        k = rng.randrange(len(words))
        texts += [" ".join(words[:k] + ["other"] + words[k:]), " ".join(words[:k] + words[k + 1 :])]
    return texts + ["permission is hereby granted " * 300 + filled(notices.NOTICES[2][1], rng)]


def test_op12_is_plain(spark, awkward, licensed, tmp_path):  # noqa: F811
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(licensed, 1000)]
    awkward.unionByName(spark.createDataFrame(rows, awkward.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in awkward.collect()] + [r[:2] for r in rows]
    got = __spark_entry__.queries()["op12_licenses"](spark, str(tmp_path)).collect()
    mine = sorted(key(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got)
    assert mine == sorted(key(i, *plain_scan(t)) for i, t in docs)
    assert {x for r in got for x in r.labels.split(",") if x} == {label for label, _ in [*notices.NOTICES, *notices.PHRASES]}


def test_op12_empty(spark, nothing):  # noqa: F811
    assert licenses.scan(nothing).count() == 0


def test_mandatory_wording_matches_exactly():
    a = licenses.Automaton(notices.NOTICES)
    labels = lambda text: [a.labels[t] for *_, t in a.places(licenses._ids(a, text.encode(), 1 << 20))]
    isc = filled(dict(notices.NOTICES)["isc"], random.Random(1))
    assert "isc" in labels(isc) and "isc" not in labels(isc.replace("without fee", "a fee")) and "isc" not in labels(isc.replace("hereby", ""))


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_automaton_is_plain(data):
    word = st.sampled_from(["a", "b", "c", "zz"])
    region = st.one_of(word, st.tuples(st.integers(0, 2), st.integers(1, 3)).map(lambda x: f"{{{{{min(x)}-{max(x)}}}}}"), st.sampled_from(["{{a b|c}}", "{{a|b c a}}", "[[b]]", "[[c {{1-2}}]]", "[[a [[b]] a]]"]))
    markups = data.draw(st.lists(st.tuples(word, st.lists(region, max_size=4), st.booleans()).map(lambda x: " ".join([x[0], *x[1]] if x[2] else [*x[1], x[0]])), min_size=1, max_size=3))
    words = data.draw(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=14))
    a = licenses.Automaton([(str(i), m) for i, m in enumerate(markups)], most_sets=data.draw(st.sampled_from([2, 5, 1000])))
    got = a.places(a.ids([w.encode() for w in words]))
    want = []
    for t, m in enumerate(markups):
        tree, starts = licenses.parse(m), {}
        for i in range(len(words)):
            for e in plain_accepts(tree, words[i:]):
                starts.setdefault(i + e, i)
        want += [(s, e, t) for e, s in starts.items()]
        assert bool(re.search(" " + licenses.as_regex(tree), " " + "".join(w + " " for w in words))) == bool(starts)
    assert sorted(got) == sorted(want)
    free = licenses.apart(got)
    assert all(p[1] <= q[0] for p in free for q in free if p[2] == q[2] and p < q)


@pytest.mark.parametrize("markup", ["a [[b", "a ]] b", "a {{3-2}}", "a {{|b}}", "[[a]]", "{{1-3}}", ""])
def test_markup_is_checked(markup):
    with pytest.raises(ValueError):
        licenses.Automaton([("x", markup)])


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_texts_are_cut_between_words(size):
    a = licenses.Automaton(notices.NOTICES)
    text = "é under the MIT license " + "x" * 130 + ", Apache" + "\n" * 9 + " free software"
    assert (licenses._ids(a, text.encode(), size) == a.ids(licenses.words_of(text.encode()))).all()


# --- spelling variants


def plain_variants(docs, least_length=6, least_count=5, times=5):
    n = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    alphabet = sorted(set("".join(words)))
    near = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in alphabet} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in alphabet}
        near[w] = [x for x in made if x != w and x in words]
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append(key(w, form[w], root, c, len(near[w]), words.get(form[w])))
    return sorted(out)


def spelt(rng):
    """Words in texts, often and seldom, with misspellings of misspellings, runs of one letter and very long words."""
    base = ["riverbank", "ñandúes", "straße", "aaaaaa", "aaaaaaa", "Ärgernis", "ÀÉÎÕÜÿ", "x" * 400, "abcdef" * 200]
    out = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(1, 60)):
            w = base[min(rng.randint(0, 9), 8)] if rng.random() < 0.9 else "".join(rng.choice("abé") for _ in range(6))
            for p in (0.15, 0.02):
                if rng.random() < p:
                    k = rng.randrange(min(len(w), 4))
                    w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "o" + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        out.append((i, rng.choice([" ", "1", ", ", "_"]).join(words)))
    return out


def test_op13_is_plain(spark, awkward, tmp_path):  # noqa: F811
    rows = [(i + 500, t, "en", "s", 1, "x") for i, t in spelt(random.Random(12))]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, 0, None)]
    rows += [(900 + i, "lanterns " * 20 + "lanturns " * 3 + "lanturnz " * (i % 2), "en", "s", 1, "x") for i in range(13)]
    awkward.unionByName(spark.createDataFrame(rows, awkward.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in awkward.collect()] + [r[:2] for r in rows]
    got = __spark_entry__.queries()["op13_variants"](spark, str(tmp_path)).collect()
    mine = sorted(key(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got)
    assert mine == plain_variants(docs)
    assert any(r.form and r.root != r.form for r in got) and len(mine) > 60  # a form that has a form


def test_op13_shards_and_edges(spark, nothing):  # noqa: F811
    assert variants.regroup(nothing).count() == 0
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé🙂") for _ in range(rng.randint(0, 7))) for _ in range(700)} - {""})
    df = spark.createDataFrame([(w, i % 90 + 1) for i, w in enumerate(words)], "word string, n long").cache()
    pairs = lambda **k: sorted((r.word, r.near, r.near_n) for r in variants.near(df, **k).collect())
    whole = pairs()
    n = {w: i % 90 + 1 for i, w in enumerate(words)}
    close = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and (lambda s, t: any(t[:i] + t[i + 1 :] == s for i in range(len(t))))(*sorted((a, b), key=len))
    assert whole == sorted((a, b, n[b]) for a in words for b in words if close(a, b))
    assert pairs(shard_words=100, task_words=50) == whole  # a pass for each shard of the vocabulary


def test_roots_of_long_paths(spark):
    path = [f"w{i:03}" for i in range(40)]
    df = spark.createDataFrame([*zip(path, path[1:]), ("x", "w030")], "word string, form string")
    assert {r.word: r.root for r in variants.roots(df).collect()} == {w: "w039" for w in [*path[:-1], "x"]}
