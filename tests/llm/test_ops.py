"""The corpus operators against brute force, and on odd tables."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from larkspur.llm import ann, decontaminate, html, langid, mixing, ppm, quality, simhash, suffixdedup, tokens
from larkspur.llm.common import LOWER, by_list, held_out, interned

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
DOC = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "In the beginning a long passage was written, and many copied it word for word without shame. "
ODD = [
    (1, LONG * 3 + "one", "en", "s1", 0),
    (2, LONG * 3 + "two", "en", "s1", 0),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, "   \n\t ", "fr", None, 0),
    (5, "   \n\t ", "fr", None, 0),
    (6, LONG * 3 + "one", "en", "s1", 0),
    (None, "no id here " * 9, "en", "s1", 0),
    (7, "ÄÖ ünïcode \U0001f600 " * 40, "de", "s2", 0),
    (8, "x" * 50_000, "en", "s2", 0),
    (9, "word " * 20_000, "en", "s3", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def clashing(df):
    """Extra columns named like the operators' own."""
    for c in ("id", "h", "row", "size", "part", "score", "p", "fp"):
        df = df.withColumn(c, F.lit("x"))
    return df


def words(text):
    return (text or "").encode().translate(LOWER).split()


def test_helpers():
    values, flat, counts = interned([["a", "b"], [], ["b"]])
    assert values == ["a", "b"] and flat.tolist() == [0, 1, 1] and counts.tolist() == [2, 0, 1]
    assert by_list(np.array([1.0, 2.0, 3.0]), counts).tolist() == [3.0, 0.0, 3.0]


# 1: mixing


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("block", [5000, 7])
def test_mixing(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), "en", s, 0) for i, (n, s) in enumerate(zip(rng.integers(0, 300, 400), rng.choice(["a", "b", "B", "é", None], 400, p=[0.7, 0.1, 0.1, 0.05, 0.05]), strict=True))]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs, block=block).collect()
    again = mixing.mix(docs.repartition(7), block=block).collect()
    assert sorted((r.id, r.copies) for r in got) == sorted((r.id, r.copies) for r in again)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and r.size == len(words(rows[r.id][1]))
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(5, 0.02 * target[s])


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 500, 300).astype(float), np.full(300, 0.37)
    q = mixing.flight(size, p, "seed")
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q @ size == pytest.approx(p @ size) and q.sum() == pytest.approx(p.sum())


def test_mixing_odd(odd, empty):
    got = mixing.mix(clashing(odd).drop("p")).collect()
    assert len(got) == len(ODD) and all(r.copies == 0 for r in got if r.size == 0)
    assert mixing.mix(empty).count() == 0


def test_mixing_repeated_rows(spark):
    rows = [(1, "w " * 50, "en", "a", 0)] * 40 + [(i, "w " * i, "en", "b", 0) for i in range(2, 40)] + [(None, "x y", "en", None, 0)] * 3
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = mixing.mix(docs, block=9).collect()
    assert len(got) == len(rows) and sum(r.copies for r in got if r.id == 1) * 50 == pytest.approx(next(r.target for r in got if r.id == 1), abs=50)
    extra = docs.withColumns({c: F.lit(c) for c in ("copies", "i", "row", "h", "copy", "tie", "target")})
    kept = mixing.keep_mix(spark, extra, "")
    assert kept.columns == extra.columns
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.id] += r.copies
    assert Counter(r.doc_id for r in kept.collect()) == +taken


# 2: SimHash


def brute_fingerprint(text):
    ws = words(text)
    if not ws:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@needs_tables
def test_simhash(spark):
    got = {r.doc_id: r for r in simhash.op2_simhash_dedup(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_groups(fps, 4)


def test_bk_tree():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    values = list({b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for b in base for _ in range(6)})
    tree = simhash.BKTree(values)
    for v in values[:50]:
        assert sorted(tree.near(v, 4)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 4]
    parts = brute_groups(dict(enumerate(values)), 4)
    root = list(range(len(values)))
    for a, b in simhash.stars(values, 4):
        root[b] = a
    assert root == [parts[i] for i in range(len(values))]


def test_every_near_pair_shares_a_band():
    for bands in (5, 6, 7):
        masks = simhash.band_keys(bands, 4)
        for flips in ((0, 13, 26, 39), (60, 61, 62, 63), (1, 2, 30, 63)):
            change = sum(1 << b for b in flips)
            assert any(not change & m for m in masks)


def test_simhash_odd(odd, empty):
    got = simhash.groups(clashing(odd)).collect()
    by = {r.id: r.component for r in got if r.id is not None}
    assert len(got) == len(ODD) and by[6] == 1 and by[3] == by[4] == by[5] == 3
    assert [r.component for r in got if r.id is None] == [None]
    assert simhash.groups(empty).count() == 0


# 3: suffix array


def brute_cut(texts, length=50):
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in texts.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    return out


def cut(df, **how):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.Dedup(df, **how).digests().collect()}


@needs_tables
def test_suffix_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert cut(docs) == brute_cut({r.doc_id: r.text for r in docs.collect()})


def test_suffix_dedup_patches(spark):
    rng = np.random.default_rng(4)
    stock = "".join(rng.choice(list("ab "), 3000))
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            a, n = int(rng.integers(0, 2800)), int(rng.integers(20, 200))
            parts.append(stock[a : a + n] if rng.random() < 0.7 else "".join(rng.choice(list("xyz"), n)))
        texts[i] = "".join(parts)
    texts[60] = "ab" * 400
    texts[61] = "c" + "ab" * 300 + "d"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert cut(docs, parts=3) == brute_cut(texts)


def test_suffix_intervals():
    contents = [b"q" + b"abcdefghij" * 6, b"r" + b"abcdefghij" * 6 + b"s", b"zz" * 40]
    array = suffixdedup.SuffixArray(contents)
    suffixes = [contents[s][o:] for s, o in zip(array.segment, array.offset, strict=True)]
    assert suffixes == sorted(suffixes)
    for i in range(1, len(suffixes)):
        assert array.common[i] == len(os.path.commonprefix([suffixes[i - 1], suffixes[i]]))
    found = {(n, tuple(sorted((int(array.segment[k]), int(array.offset[k])) for k in range(a, b + 1)))) for n, a, b in array.maximal()}
    assert (60, ((0, 1), (1, 1))) in found


def test_repeats_have_all_places(spark):
    docs = spark.createDataFrame([(i, f"{i}" * 9 + LONG + chr(97 + i) * 9) for i in range(4)], "doc_id long, text string")
    rows = suffixdedup.Dedup(docs, parts=2).repeats().collect()
    assert rows and all(len(r.places) == 4 and r.length >= 50 for r in rows)


def test_suffix_dedup_shared_ids(spark):
    rng = np.random.default_rng(6)
    make = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    a, b, c = make(300), make(213), make(150)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + a), (3, c), (4, c[:80] + b[20:90]), (4, None)]
    got = sorted((r.id, r.n_bytes, r.n_removed) for r in suffixdedup.Dedup(spark.createDataFrame(rows, "doc_id long, text string"), parts=3).digests().collect())
    assert got == sorted([(1, 300, 0), (2, 300, 300), (2, 213, 0), (2, 213, 0), (3, 513, 513), (3, 150, 0), (4, 150, 150), (4, 0, 0)])


def test_suffix_dedup_odd(odd, empty):
    got = suffixdedup.Dedup(clashing(odd)).digests().collect()
    assert len(got) == len(ODD)
    by = {r.id: r for r in got}
    assert by[6].n_removed == by[6].n_bytes and by[6].n_spans == 1 and by[1].n_removed == 0 and by[3].n_bytes == 0
    assert by[None].n_removed == 0 and by[8].n_removed == 0
    assert suffixdedup.Dedup(empty).digests().count() == 0


# 4: PPM


def brute_jaccard(texts, least):
    """Components by exact Jaccard similarity of five-word shingles, over all pairs."""
    sets = {}
    for i, t in texts.items():
        ws = words(t)
        sets[i] = {tuple(ws[a : a + 5]) for a in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least if sets[i] | sets[j] else True):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


@needs_tables
def test_similarity_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, extra, at = np.random.default_rng(8), [], 10**6
    for changes in (1, 2, 3, 4, 5, 6, 8, 10, 12):  # of 200 words: similarity from 0.95 down to below 0.6
        for _ in range(6):
            ws = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
            near = list(ws)
            for x in rng.choice(200, changes, replace=False):
                near[x] = "other"
            extra += [(at, " ".join(ws), "en", "s", 0), (at + 1, " ".join(near), "en", "s", 0)]
            at += 2
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = brute_jaccard({r.doc_id: r.text for r in docs.collect()}, 0.8)
    assert {r.id: r.component for r in simhash.groups(docs).collect()} == want
    assert 20 < sum(i != c for i, c in want.items() if i >= 10**6) < 50
    assert {r.doc_id for r in simhash.keep_one_of_each(spark, docs, SF).collect()} == set(want.values())


@needs_tables
def test_ppm(spark):
    got = {r.doc_id: r for r in ppm.op4_ppm_scoring(spark, SF).collect()}
    texts = {r.doc_id: words(r.text) + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    count = Counter()
    for i, ws in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(ws)
    n, v = sum(count.values()), len(count)
    for i, ws in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0


def brute_ppm(trie, context, symbol):
    """Method C with exclusion, one symbol at a time, over the kept contexts."""
    nodes = [0]
    for k in range(1, len(trie.child) + 1):
        if len(context) < k:
            break
        c = 0
        for j, s in enumerate(context[-k:]):
            c = trie.child[j][c, s] if c >= 0 else -1
        if c < 0:
            break
        nodes.append(c)
    mass, gone = 1.0, set()
    for k in range(len(nodes) - 1, -1, -1):
        row = {s: x for s, x in enumerate(trie.counts[k][nodes[k]]) if x and s not in gone}
        total, kinds = sum(row.values()), len(row)
        left = ppm.SYMBOLS - len(gone) - kinds
        under = total + kinds if left else total
        if symbol in row:
            return mass * row[symbol] / under
        if row:
            mass *= kinds / under
        gone |= set(row)
    return mass / (ppm.SYMBOLS - len(gone))


def test_ppm_by_hand(spark):
    texts = ["abracadabra", "abra abra", "cadabra", ""]
    trie = ppm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    for log in trie.log:
        assert np.allclose((10.0 ** log.astype(float)).sum(axis=1), 1)
    for t in ["abracad", "zebra", "", "dabra abr"]:
        syms, want = [*t.encode(), ppm.END], 0.0
        for i, s in enumerate(syms):
            want += math.log10(brute_ppm(trie, syms[max(0, i - 3) : i], s))
        assert trie.score([b"x", t.encode()])[1] == pytest.approx(want, rel=1e-5)


@needs_tables
def test_ppm_keeps_every_context(spark):
    got = {r.doc_id: r for r in ppm.op4_ppm_scoring(spark, SF).collect()}
    texts = {r.doc_id: [*(r.text or "").encode(), ppm.END] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {}
    for i, t in texts.items():
        if not got[i].held_out:
            for at, s in enumerate(t):
                for k in range(min(at, ppm.ORDER) + 1):
                    after.setdefault(tuple(t[at - k : at]), Counter())[s] += 1
    for i in sorted(texts, key=lambda i: (len(texts[i]), i))[::10]:
        want, t = 0.0, texts[i][:3000]
        if len(t) < len(texts[i]):
            continue
        for at, s in enumerate(t):
            mass, gone = 1.0, set()
            for k in range(min(at, ppm.ORDER), -1, -1):
                row = {x: n for x, n in after.get(tuple(t[at - k : at]), {}).items() if x not in gone}
                total = sum(row.values()) + (len(row) if ppm.SYMBOLS > len(gone) + len(row) else 0)
                if s in row:
                    mass *= row[s] / total
                    break
                mass *= len(row) / total if row else 1
                gone |= set(row)
            else:
                mass /= ppm.SYMBOLS - len(gone)
            want += math.log10(mass)
        assert got[i].score == pytest.approx(want, rel=1e-5)


def test_ppm_odd(odd, empty):
    got = ppm.score(clashing(odd)).collect()
    assert len(got) == len(ODD)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert ppm.score(empty).count() == 0


# 5: token files


def test_tokens(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.public_tokenizer())
    rows = [(i, t) for i, t in enumerate(["a b", " a  b", "a\n b", "a b ", "", None, "It's  \n\n x 12 34 <|endoftext|> é b", "  q \x1c r", LONG])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokens.shared_path(spark, "test-tokens")
    tokens.write_token_table(docs, path, partitions=3)
    back = tokens.read_token_table(spark, path)
    digests = {r.doc_id: r for r in tokens.digests(back).collect()}
    start = 0
    for r in back.orderBy("doc_id").collect():
        ids = [*plain.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids, 0]
        assert (list(r.ids), r.start, r.n_tokens) == (ids, start, len(ids))
        assert digests[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert back.where("doc_id = 4").count() == 1


def test_tokens_odd(spark, odd, empty):
    for df, n in ((clashing(odd).drop("part"), len(ODD)), (empty, 0)):
        path = tokens.shared_path(spark, "test-tokens")
        tokens.write_token_table(df, path)
        assert tokens.digests(tokens.read_token_table(spark, path)).count() == n


# 6: language


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces([b"ab", b"abc", b"bc", b"cab"])
    rng = np.random.default_rng(5)
    p = rng.random((len(pieces.pieces) + 1, 2)) / 3
    p[-1] = 0
    index = {x: i for i, x in enumerate(pieces.pieces)}

    def brute(word):
        if not word:
            return np.ones(2)
        return sum((p[index[word[:n]]] * brute(word[n:]) for n in range(1, len(word) + 1) if word[:n] in index), np.zeros(2))

    found = [b"abcab", b"a", b"bcabcabca", b"xxabz"]
    got = langid.forward(found, pieces, p)
    for w, row in zip(found, got, strict=True):
        assert np.allclose(row, np.log(brute(w)))
    uses = langid.expected([b"abcab"], np.array([2.0]), pieces, p[:, :1])
    assert sum(uses[i] * len(x) for i, x in enumerate(pieces.pieces)) == pytest.approx(10)


def test_forward_long_words_and_pieces():
    long = b"abcdefghijklmnopqrst"
    pieces = langid.Pieces([b"ab", long, long[3:15], b"a b"])
    assert long in pieces.pieces and b"a b" not in pieces.pieces
    rng = np.random.default_rng(6)
    p = rng.random((len(pieces.pieces) + 1, 2)) / 300
    p[-1] = 0
    words_ = [long * 5, b"q" + long * 4 + b"ab" * 9, b"x" * 63]
    index = {x: i for i, x in enumerate(pieces.pieces)}
    for w, row in zip(words_, langid.forward(words_, pieces, p), strict=True):
        sums = [(1.0, 1.0)]
        for j in range(1, len(w) + 1):
            sums.append(sum((np.array(sums[j - n]) * p[index[w[j - n : j]]] for n in range(1, j + 1) if w[j - n : j] in index), np.zeros(2)))
            sums = [np.array(x) for x in sums]
        assert np.allclose(row, np.log(sums[-1]))
    uses = langid.expected([long * 12], np.array([1.0]), pieces, p[:, :1])
    assert sum(uses[i] * len(x) for i, x in enumerate(pieces.pieces)) == pytest.approx(len(long) * 12)
    assert uses[index[long]] > 0


def test_long_words_do_not_vanish():
    pieces = langid.Pieces([])
    p = np.full((len(pieces.pieces) + 1, 1), 1 / 256)
    p[-1] = 0
    assert langid.forward([b"y" * 5000], pieces, p)[0, 0] == pytest.approx(5000 * math.log(1 / 256))


@needs_tables
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, odd, empty):
    model = langid.fit(odd)
    got = {r.doc_id: r.guess for r in langid.identify(clashing(odd), model, pred="guess", score="sure").collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] == "en" and len(got) == 10
    assert langid.identify(empty, model, pred="guess", score="sure").count() == 0
    nothing = langid.fit(empty)
    assert {r.guess for r in langid.identify(odd, nothing, pred="guess", score="sure").collect()} == {"und"}


# 7: pages


@pytest.fixture(scope="module")
def extractor():
    return html.fit(html.labelled_pages())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        ("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>One <b>two</b>three<p>Four &lt;5&gt;<br>six</article><footer>&copy; me</footer>", "T One twothree Four <5> six"),
        ("<body><script>var a='</p>';</script><div class='cookie-notice'>We use cookies</div><main><p>" + LONG + "</p></main><div id=comments><p>nice one, thank you</p></div>", LONG.strip()),
        ("<article><p>" + LONG + "<!-- no --><style>p{}</style></p><div class='ad'>Buy now</div><form><label>mail</label><input></form></article><aside><p>other things to read</p></aside>", LONG.strip()),
    ],
)
def test_pages(extractor, page, want):
    assert extractor.extract(page) == want


PROSE = "prose words here and there with some meaning to it "


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='x'><p>{PROSE * 6}</div>",
        f"<body>{PROSE * 4}",
        f"<body>{PROSE}",
        "<body>short article</body>",
        f"<h1>Title</h1>{PROSE * 3}",
        f"<div class=x><div><p>{PROSE * 3}</p><p>{PROSE}</p></div></div>",
    ],
)
def test_pages_without_telling_names(extractor, page):
    assert extractor.extract(page) == " ".join(re.sub("<[^>]*>", " ", page).split())


def test_long_and_broken_pages_take_linear_time(extractor):
    for page in ("<a '" * 250_000, "<a href='" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, f"<p>{PROSE}</p>" * 80_000, "<" * 1_000_000):
        began = time.monotonic()
        extractor.extract(page)
        assert time.monotonic() - began < 30


class Article(HTMLParser):
    """The text in a page's article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out.append(" " if tag in ("p", "h1", "br", "li", "div") else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out.append(" " if tag in ("p", "h1", "li", "div") else "")

    def handle_data(self, data):
        self.out.append(data if self.inside else "")


@needs_tables
def test_pages_table(spark):
    rows = {r.page_id: r for r in html.op7_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for r in pages:
        reader = Article()
        reader.feed(r.html or "")
        assert rows[r.page_id].text == " ".join("".join(reader.out).split())
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_held_out_pages(extractor):
    good = bad = missed = 0
    for page in html.labelled_pages(100, seed=77):
        nodes, flow = html.parse(page)
        label = [False] * len(nodes)
        for n in range(1, len(nodes)):
            label[n] = nodes[n].mark == "content" if nodes[n].mark else label[nodes[n].parent]
        p = extractor.marginals(nodes)
        for n, text in flow:
            if text.strip() and nodes[n].tag not in html.UNSEEN:
                good += len(text) * (p[n] >= 0.5 and label[n])
                bad += len(text) * (p[n] >= 0.5 and not label[n])
                missed += len(text) * (p[n] < 0.5 and label[n])
    assert good / (good + bad) > 0.97 and good / (good + missed) > 0.93


def test_marginals_are_exact(extractor):
    nodes, _ = html.parse("<div><p>aa bb cc</p><ul><li><a>x</a></li></ul></div>")
    size = len(nodes)
    own = [(1.0, 1e-6)] + [extractor.potential(html.signature(nodes, n)) for n in range(1, size)]
    total = np.zeros((size, 2))
    for state in range(1 << size):
        label = [state >> n & 1 for n in range(size)]
        w = own[0][label[0]]
        for n in range(1, size):
            up = nodes[n].parent
            w *= own[n][label[n]] * extractor.edges[html._edge(nodes[up].tag)][label[up]][label[n]]
        for n in range(size):
            total[n, label[n]] += w
    assert np.allclose(extractor.marginals(nodes), total[:, 1] / total.sum(axis=1))


def test_pages_odd(spark, extractor):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" * 400 + "deep"), (4, "u", "<<a <b></c> &bogus; <p"), (4, "u", "<p>same"), (4, "u", "<p>same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit(1))
    got = html.extract(pages, extractor, text="main").collect()
    assert len(got) == 6 and got[0].main == "" and all(r.main is not None for r in got)
    assert html.extract(pages.limit(0), extractor, text="main").count() == 0


# 8: leaks


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_leaks_at_any_edit():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.choice(list(b"abcdefgh "), int(n))) for n in rng.integers(60, 200, 30)]
    items = decontaminate.Items(list(enumerate(texts)), 0.1)
    for i, t in enumerate(items.texts):
        t, k = bytearray(t), int(items.budget[i])
        for _ in range(k):
            at, kind = int(rng.integers(0, len(t))), rng.integers(0, 3)
            if kind == 0:
                t[at] = ord("z")
            elif kind == 1:
                del t[at]
            else:
                t.insert(at, ord("y"))
        found = items.leaks([b"before this " + bytes(t) + b" after it", b"nothing of the kind"])
        hit = [m for m in found[0] if m["item_id"] == items.ids[i]]
        assert hit and hit[0]["edits"] <= k and not found[1]
        text = decontaminate.normal(b"before this " + bytes(t) + b" after it")
        assert edit_distance(items.texts[i], text[hit[0]["start"] : hit[0]["end"]]) == hit[0]["edits"]


@needs_tables
def test_leaks_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.op8_decontamination(spark, sf).collect()}
    items = {r.item_id: decontaminate.normal(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = decontaminate.normal((r.text or "").encode())
        assert {i for i, t in items.items() if t in text} <= set(got[r.doc_id])


def test_leaks_in_passes(spark):
    docs = spark.createDataFrame([(1, "x " + LONG + " y"), (2, "clean text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, LONG), (11, LONG.upper()), (12, None), (13, ""), (14, "clean"), (None, LONG)], "item_id long, text string")
    one = {r.doc_id: sorted(m.item_id for m in r.leaks) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert one == {1: [10, 11], 2: [14], 3: []}
    assert len(decontaminate.passes(bench, limit=100)) > 1


def test_leaks_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    got = decontaminate.find_leaks(clashing(odd), bench, leaks="found").collect()
    assert {r.doc_id for r in got if r.found} == {1, 2, 6} and len(got) == len(ODD)
    assert decontaminate.find_leaks(odd, bench.limit(0), leaks="found").where("size(found) > 0").count() == 0
    assert decontaminate.find_leaks(empty, bench, leaks="found").count() == 0


# 9: quality


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(7)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] == 1)).mean() > 0.93


@needs_tables
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 0), (2, 1), (99, 1), (None, 0), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.rate(clashing(odd), model, score="s").collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    assert quality.rate(odd, quality.fit(odd, labels.limit(0)), score="s").first().s == 0.5
    assert quality.rate(empty, model, score="s").count() == 0


# 10: neighbours


def test_hilbert_is_a_curve():
    for d, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = ann.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(side**d))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@needs_tables
def test_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    got = ann.op10_hilbert_ann(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([list(map(float, r.embedding)) for r in rows]), np.array([r.vec_id for r in rows])
    hits, total = 0, 0
    for q in ids[ids % 100 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len(set(best.tolist()) & {r.vec_id for r in mine}), total + 10
        at = {i: s for i, s in zip(ids.tolist(), d.tolist(), strict=True)}
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(r.score == pytest.approx(at[r.vec_id], abs=1e-12) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
    assert hits / total >= 0.9


def test_neighbours_odd(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 300)] + [(400, [1.5, 2.0]), (401, None), (402, [0.0, 0.0]), (403, [1.0, float("nan")]), (404, [1.0, None]), (405, [1.0]), (None, [1.0, 2.0]), (400, [1.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("entry", F.lit(1)).withColumn("id", F.lit("x")).drop("id")
    got = ann.search(df, F.col("id").isin(0, 5, 400, 402), k=10).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 5, 400, 402)}
    assert by[0] == list(range(1, 11)) and by[5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and by[400] == list(range(10)) and by[402] == []
    assert ann.search(df.limit(0), F.col("id") == 0).count() == 0


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", held_out("doc_id", 7, 2)).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert Row
