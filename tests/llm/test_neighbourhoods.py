"""Near-duplicate embeddings, ranked lexical search and spelling variants against brute force."""

import collections
import itertools
import random
import re
import zlib
from math import floor, log

import numpy as np
import pytest
from test_corpus import TEXTS, documents

from wayfold.llm import embedding_dedup, lexical_search, spelling

LOWER = {k: k + 32 for k in range(65, 91)}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, label int, rid int, list int, ball int")


def plain_classes(rows, threshold=0.9):
    usual = collections.Counter(len(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)).most_common(1)
    ok = [k for k, (i, v) in enumerate(rows) if usual and i is not None and v and len(v) == usual[0][0] and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([np.array(rows[k][1], np.float32) for k in ok], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True) if len(ok) else 1
    near = x @ x.T >= threshold if len(ok) else np.zeros((0, 0), bool)
    component = [rows[k][0] for k in ok]
    for _ in range(len(ok)):
        new = [min(component[b] for b in np.flatnonzero(near[a])) for a in range(len(ok))]
        if new == component:
            break
        component = new
    out = [(i, 0, i, i is not None) for i, _ in rows]
    for a, k in enumerate(ok):
        out[k] = (rows[k][0], int(near[a].sum()) - 1, component[a], component[a] == rows[k][0])
    return sorted(out, key=repr)


def check_classes(spark, rows):
    got = embedding_dedup.near_classes(vectors(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == plain_classes(rows)


def test_near_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    single = lambda x: [float(np.float32(y)) for y in x]
    rows = [(i, single(rng.normal(size=12))) for i in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(60)] + [(300 + k, single(2 * np.array(rows[k % 7][1]) + rng.normal(size=12) * 0.3 * (k % 5))) for k in range(120)]  # copies and chains of near ones
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [1.0] * 11), (504, [float("nan")] * 12), (505, [None] + [1.0] * 11), (506, [float("inf")] * 12), (None, rows[0][1]), (None, None), (3, rows[3][1]), (4, [1e-30] * 12), (507, [1e30] * 12)]
    check_classes(spark, rows)
    for name in ("CHUNK", "RESIDENTS", "VISITORS"):  # the same with groups split to the last
        monkeypatch.setattr(embedding_dedup, name, 9)
    check_classes(spark, rows)
    check_classes(spark, rows[:1])
    check_classes(spark, [(1, None), (2, [0.0])])
    assert embedding_dedup.near_classes(vectors(spark, rows).where("false")).count() == 0


def test_quantiser_bounds_and_margin():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embedding_dedup.Quantiser(x, 50, 0.9)
    home = model.home(x)
    codes, left = model.encode(x, home)
    told = x[:200] @ model.centres.T[:, home] + sum(t[:, c] for t, c in zip(model.tables(x[:200]), codes.T))
    assert (np.abs(told - x[:200] @ x.T) <= left + 1e-4).all()  # the stored error bounds every estimate
    turned = rng.normal(size=x.shape)
    turned -= (turned * x).sum(axis=1, keepdims=True) * x
    turned = 0.9 * x + np.sqrt(0.19) * turned / np.linalg.norm(turned, axis=1, keepdims=True)
    a, b = x @ model.centres.T, turned @ model.centres.T
    i = np.arange(len(x))
    met = (a[i, b.argmax(1)] >= a.max(1) - model.margin) | (b[i, a.argmax(1)] >= b.max(1) - model.margin)
    assert met.mean() > 0.99  # new turns, not those that set the margin
    leader, radius = embedding_dedup.gather(x, np.zeros(len(x)), 0.9)
    assert all(x[k] @ x[leader[k]] >= np.cos(0.9) - 1e-9 for k in range(len(x))) and (radius <= 0.9).all()


def plain_search(docs, items, k=10):
    term = re.compile(lexical_search.TERM)
    held = [(i, collections.Counter(own)) for i, t in docs if (own := term.findall((t or "").translate(LOWER)))]
    total = sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(term.findall((t or "").translate(LOWER)))
    out = set()
    for i, terms in asked.items():
        w = {t: floor(1000 * log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scored = []
        for d, c in held:
            m = 10 + (90 * c.total() * len(held)) // total
            s = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out |= {(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])}
    return out


def test_lexical_search(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["É", "日本", "X9", "ﬁ", "a_b", "it's"]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.choice((0, 3, 40, 900)))) for _ in range(300)]
    texts += TEXTS + [texts[5]] * 40 + [" ".join(map(str, range(60000))), "A\x7fb\x00c", "w1 " * 70]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(25)] + [(26, texts[5]), (27, None), (28, ""), (29, "unheard"), (None, "w1"), (25, "w1 W1 a"), (25, "b c"), (30, "w1 " * 500)]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:4]))  # rows that repeat
    docs = docs.unionByName(docs.where("doc_id = 6").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "size"))
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, width int")
    want = plain_search([*enumerate(texts), *enumerate(texts[:4]), (None, texts[6])], items)

    def found():
        return [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(lexical_search.build_index(docs), docs, asked).collect()]

    got = found()
    assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 60)  # several blocks of items, bits that are nearly all set, small blocks of documents
    monkeypatch.setattr(lexical_search, "ENTRY_BITS", 2)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    assert set(found()) == want
    none = docs.where("false")
    assert lexical_search.search(lexical_search.build_index(none), none, asked).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), docs, asked.where("false")).count() == 0


def test_bounds_are_bounds():
    """No score lies above its bound, and with rare collisions bounds exclude most documents."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"t{k}" for k in range(3000)], k=rng.randint(1, 300))).encode() for _ in range(200)]
    block = lexical_search._Block()
    for i, t in enumerate(texts):
        own = collections.Counter(lexical_search.terms_of(t))
        block.add(i, i, own, own.total())
    asked = [type("R", (dict,), {})(item_id=1, term=f"t{k}", w=k + 1) for k in range(0, 3000, 60)]
    items = lexical_search.Items(asked)
    total = sum(block.lengths)
    upper = lexical_search.bounds(block.row(), items, len(texts), total)[0]
    exact = []
    for t in texts:
        tf = collections.Counter(lexical_search.terms_of(t))
        m = 10 + 90 * tf.total() * len(texts) // total
        exact.append(sum(r["w"] * (10**9 * tf[r["term"].encode()] // (1000 * tf[r["term"].encode()] + 8 * m)) for r in asked))
    assert (upper >= exact).all()
    floor_ = sorted(exact)[-10]
    assert (upper >= floor_).sum() < 40


def plain_variants(docs):
    seen = collections.Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def variants_of(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, other int")
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()]


def test_spelling(spark, monkeypatch):
    rng = random.Random(7)
    base = ["length", "strength", "naïveté", "Größe", "aaaaaa", "ÿÿÿÿÿ", "abcde", "q" * 300]
    def worn(w):
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2, 3))):
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abzé÷") + w[k:], w[:k] + rng.choice("abzé×") + w[k + 1 :]))
        return w
    rows = [(i if i % 9 else None, rng.choice((" ", "1", "Ā", "日", "\n")).join(worn(rng.choice(base)) for _ in range(40))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Ünïcödé " * 5000), *rows[:3]]
    want = plain_variants(rows)
    got = variants_of(spark, rows)
    assert len(got) == len(want) > 40 and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in got)  # some root lies more than one form away
    monkeypatch.setattr(spelling, "SHARD_WORDS", 5)  # many shards in many rounds, small pieces of edits
    monkeypatch.setattr(spelling, "ROUND_BYTES", 200)
    monkeypatch.setattr(spelling, "EDITS", 500)
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 10)
    assert set(variants_of(spark, rows)) == want
    assert variants_of(spark, [(1, None)]) == [] and variants_of(spark, [(1, "lonely lonely lonely")])[0][:3] == ("lonely", None, "lonely")


@pytest.mark.parametrize("length", [1, 5, 70])
def test_edits_equal_plain_ones(length):
    """With filters that hold all, every deletion and every replacement by a later letter comes once."""
    rng = random.Random(8)
    words, alphabet = ["".join(rng.choices("abcé", k=length)) for _ in range(4)], sorted("abcéz")
    every = spelling.Filters({(n, 0): np.full(1, ~np.uint64(0)) for n in range(spelling.LONG + 1)}, dict.fromkeys(range(spelling.LONG + 1), 1))
    got = list(spelling.edits(words, alphabet, every))
    want = [(i, v) for i, w in enumerate(words) for v in {w[:k] + w[k + 1 :] for k in range(length) if length > 1} | {w[:k] + a + w[k + 1 :] for k in range(length) for a in alphabet if a > w[k]}]
    assert sorted((int(i), w) for i, w in got) == sorted(want)
    held = spelling.build_filter(spelling.mixed(spelling.polynomial(spelling._letters(words))))
    own = spelling.Filters({(min(length, spelling.LONG), 0): held}, {min(length, spelling.LONG): 1})
    hashes = np.array([spelling.polynomial(spelling._letters([w]))[0] for w in words])
    assert own.holds(hashes, length).all()
