"""The operators on small fixtures against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, graph, mixing, ngram_join, pii, quality, sharding, suffix_dedup, token_files, toxicity, url_filters
from tallyspark.llm.common import slices, text_buffer

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Prose of few words, exact and near copies, a shared passage, short, empty, null and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(90)
    texts = []
    for i in range(n):
        t = prose(rng.randint(1, 200))
        if i % 4 == 0:
            t = f"{prose(rng.randint(5, 30))}\n{passage} {prose(rng.randint(5, 30))}"
        if i % 5 == 0 and texts:
            words = (rng.choice([x for x in texts if x]) or "a").split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            t = " ".join(words)
        texts.append(t)
    texts += [None, "", " \n\t ", "one", "One", texts[7], texts[7], prose(3000), "a" * 3000, "\x1f.\x85 two"]
    return texts


def frame(spark, texts, sources=("s1", "s2", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL).withColumns({"size": F.lit("mine"), "key": F.lit(1), "shard": F.lit("x")})


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------------ 1


def brute_removed(texts, length):
    seen, data = {}, [(t or "").encode() for t in texts]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length, reach, most", [(400, 300, 20_000), (60, 40, 20_000), (60, 40, 1)])
def test_long_strings(docs, texts, length, reach, most):
    want = brute_removed(texts, length)
    got = suffix_dedup.dedup_long_strings(docs, length, reach, with_text=True, most=most).collect()
    assert len(got) == len(texts)
    for r in got:
        n, removed, runs, sha, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, runs, sha), texts[r.doc_id]
        assert r.kept is None or bytes(r.kept) == kept
        assert r.kept_chars == sum(b & 0xC0 != 0x80 for b in kept)


def test_passages_of_fifty_words_by_their_bytes(spark):
    """A passage that repeats across documents goes from 400 bytes on, however many words it has; documents without one keep every character."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz\u00e9"), n))
    own = lambda: " ".join(word(6) for _ in range(80))
    short, long = " ".join(word(5) for _ in range(55)), " ".join(word(8) for _ in range(55))
    assert len(short.encode()) < 390 and len(long.encode()) > 410
    texts = [f"{own()} {p} {own()}" for p in (short, short, long, long)] + [own() for _ in range(4)]
    want = brute_removed(texts, 400)
    got = suffix_dedup.dedup_long_strings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]
        assert (r.kept_chars < len(texts[r.doc_id])) == (r.n_removed > 0) == (r.doc_id in (2, 3))


def test_levels_merge_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark, 10, 6)
    sizes = []
    for b in range(5):
        rows = [(1, bytearray(b"abcdefghijkl" + bytes([65 + b])), bytearray(b"x"), b)]
        found = index.add(spark.createDataFrame(rows, "prefix long, suffix binary, left binary, context long")).collect()
        sizes.append([n for n, _ in index.levels])
        assert bool(found) == (b > 0)
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    index.drop()


def test_levels_are_scanned_where_they_lie(spark):
    """Neither a scan nor a merge deals out the rows of a level again."""
    index = suffix_dedup.SuffixIndex(spark, 10, 6)
    rows = [(i % 5, bytearray(b"abcdefghijkl%d" % i), bytearray(b"x"), i) for i in range(20)]
    for b in range(3):
        index.add(spark.createDataFrame([(p, s, x, c + 100 * b) for p, s, x, c in rows], "prefix long, suffix binary, left binary, context long"))
    (_, old), (_, new) = index.levels
    sizes = suffix_dedup.materialize(spark.createDataFrame([(p, 12) for p in range(5)], "prefix long, n long"), "sizes")
    for plan in (index.matches(new, old, sizes), index.matches(new, None, sizes), index.merged(new, old)):
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in said and "hashpartitioning(part" not in said, said
    assert index.matches(new, old, sizes).count() > 0 and index.merged(new, old).count() == 60
    index.drop()


# ------------------------------------------------------------------ 2


def brute_components(texts, n, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = words_of((t or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, num, den, block", [(4, 85, 100, 1000), (5, 80, 100, 1000), (4, 85, 100, 2), (2, 60, 100, 3)])
def test_ngram_classes(docs, texts, n, num, den, block):
    want = brute_components(texts, n, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(docs, n, num, den, block=block).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("seed, n, words, changes", [(1, 60, 120, 3), (2, 60, 120, 6), (3, 40, 12, 1), (4, 50, 300, 20), (5, 5, 40, 0)])
@pytest.mark.parametrize("cross", [False, True])
def test_links_of_near_copies(seed, n, words, changes, cross):
    """What joins in a group of near copies, with and without their original, and of sets with little in common."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, words, dtype=np.uint64)
    sets = []
    for i in range(n):
        s = base.copy()
        s[rng.choice(words, rng.integers(0, changes + 1), replace=False)] = rng.integers(0, 2**62, 1, dtype=np.uint64)[0] + np.uint64(i)
        sets.append(np.unique(np.concatenate((s, rng.integers(0, 9, rng.integers(0, 3), dtype=np.uint64)))))
    sets += [rng.integers(0, 2**62, words, dtype=np.uint64) for _ in range(5)]
    sides = np.arange(len(sets)) % 2
    up = list(range(len(sets)))
    linked = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                linked.add((j, i))
    got = ngram_join.links(sets, sides, cross, 85, 100)
    assert all((min(p), max(p)) in linked for p in got)

    def classes(pairs):
        up = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                up[i] = up[j] = min(up[i], up[j])
        return up

    if cross:  # with the links inside both sides
        assert classes([*got, *[p for p in linked if sides[p[0]] == sides[p[1]]]]) == classes(linked)
    else:
        assert classes(got) == classes(linked) and len(got) == len(sets) - len(set(classes(linked)))


def test_groups_of_near_copies_grow_in_proportion():
    """Twice the near copies take about twice the time, not four times."""
    took = []
    for n in (2000, 4000):
        rng = np.random.default_rng(1)
        base = rng.integers(0, 2**62, 300, dtype=np.uint64)
        sets = []
        for _ in range(n):
            s = base.copy()
            for at in rng.integers(0, 297, 4):
                s[at : at + 4] = rng.integers(0, 2**62, 4, dtype=np.uint64)
            sets.append(np.unique(s))
        t = time.process_time()
        ngram_join.links(sets, np.zeros(n, int), False, 85, 100)
        took.append(time.process_time() - t)
    assert took[1] < 3.5 * took[0] + 0.5 and took[1] < 30, took


def test_similar_sets_share_a_signature():
    """Whatever the sizes, sets at the threshold meet in a fragment."""
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100)):
        for size in (5, 6, 11, 15, 16, 20, 31, 32, 33, 60, 100, 127, 128, 200, 255, 256, 257, 300, 500, 1000, 2000):
            for _ in range(6):
                base = rng.integers(0, 2**63, size, dtype=np.uint64)
                gone = (size * (den - num)) // den
                for other in (base[gone:], np.concatenate((base, rng.integers(0, 2**63, size * (den - num) // num, dtype=np.uint64))), np.concatenate((base[gone // 2 :], rng.integers(0, 2**63, gone // 3, dtype=np.uint64)))):
                    a, b = np.unique(base), np.unique(other)
                    both = len(np.intersect1d(a, b))
                    if den * both >= num * (len(a) + len(b) - both):
                        for frequent in (None, rng.random(1 << ngram_join.COUNTER_BITS) < 0.5):
                            assert len(np.intersect1d(ngram_join.signatures(a, num, den, frequent), ngram_join.signatures(b, num, den, frequent)))


def test_a_common_ending_makes_no_group(spark):
    """Short texts that share eight words, but do not link, are not compared with one another: work grows with their number."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    work = []
    for many in (1000, 2000):
        texts = [" ".join(word() for _ in range(rng.randint(8, 14))) + " kind regards from all of us here today" for _ in range(many)]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
        groups = ngram_join.candidate_groups(ngram_join._sketches(rows, 4, 85, 100)).groupBy("grp").count().collect()
        assert all(r["count"] <= 20 for r in groups)
        work.append(sum(r["count"] ** 2 for r in groups))
    assert work[1] <= 4 * work[0] + 100


def test_chained_groups_are_split(spark):
    """A group chained by small meetings is compared meeting by meeting, one that meets as a whole stays one."""
    chain = [(i, 10 + i // 3) for i in range(300)] + [(i + 1, 10 + i // 3) for i in range(300)]
    dense = [(1000 + i, 9000 + j) for i in range(50) for j in range(40) if (i + j) % 9]
    met = spark.createDataFrame(chain + dense, "node long, sig long").distinct()
    groups = spark.createDataFrame([(i, 0) for i in range(301)] + [(1000 + i, 1000) for i in range(50)], "node long, grp long")
    sizes = [r["count"] for r in ngram_join._split_groups(groups, met, 20).groupBy("grp").count().collect()]
    assert sorted(sizes) == [4] * 100 + [50]


def test_one_of_each_stays(docs, texts):
    want = brute_components(texts, 5, 80, 100)
    got = ngram_join.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, (_, c) in enumerate(want) if i == c]


def test_one_row_of_repeated_and_null_ids_stays(spark, texts):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b + " more"), (2, c), (7, ""), (7, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.keep_one_of_each(df).collect()), key=str)
    assert [r for r in got if r[1] in (a, c)] == [(1, a), (2, c)] and len([r for r in got if (r[1] or "").startswith("b")]) == 1
    assert len([r for r in got if not r[1]]) == 3


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 1)], "u int, v int")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).collect() == []


# ------------------------------------------------------------------ 3


def test_urls(spark):
    cases = {
        "http://A.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "https://x.org/fr/?q": ("x.org", "/fr/", "org/fr/", "allow"),
        "https://x.org/frx": ("x.org", "/frx", None, "allow"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://cheap-pills.x.com/": ("cheap-pills.x.com", "/", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://h#y://net/": ("h", "", None, "allow"),
        "x://net/a\nb": ("net", "/a\nb", "net/", "block"),
        "http://a\nb.net/x": ("a\nb.net", "/x", "net/", "block"),
        "http://a.b\n.org/fr/\n": ("a.b\n.org", "/fr/\n", "org/fr/", "allow"),
        "http://m.casino-win.x.com/en/1": ("m.casino-win.x.com", "/en/1", None, "block"),
        "http://casinos": ("casinos", "", None, "block"),
        "http://mycasinos.com/casino": ("mycasinos.com", "/casino", None, "allow"),
        "http://x.com/a/wp-login.php": ("x.com", "/a/wp-login.php", None, "block"),
        "http://x.com/a/wp-logins/b": ("x.com", "/a/wp-logins/b", None, "allow"),
        "http://x.com/a/login": ("x.com", "/a/login", None, "block"),
        "http://x.com/a.zip?q": ("x.com", "/a.zip", None, "block"),
        "http://x.com/a.zip/b": ("x.com", "/a.zip/b", None, "allow"),
        "http://x.com/a.ZIP": ("x.com", "/a.ZIP", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert got == cases
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, max_inline=0).collect()} == cases
    assert url_filters.judge_urls(df.limit(0)).count() == url_filters.judge_urls(df.limit(0), max_inline=0).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(df, host_rules=(), patterns=()).collect()} == {"allow"}


def test_many_url_rules_beside_brute_force(spark):
    """More rules than travel with a plan, with and without paths, equal lengths and both verdicts."""
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice(["a", "bb", "c-d", "x1", "com", "net"]) for _ in range(rng.randint(1, 3)))
    rules = [url_filters.HostRule(rng.choice(["block", "allow"]), host(), rng.choice(["", "/", "/p", "/p/", "/q/p/"])) for _ in range(1500)]
    urls = [f"http://{host()}{rng.choice(['', '/', '/p', '/px', '/p/q', '/q/p/', '/q/p'])}" for _ in range(400)]

    def judged(url):
        h, slash, p = url[7:].partition("/")
        fits = [(len(r.name), len(r.host), r.verdict == "block", r) for r in rules if (h == r.host or h.endswith("." + r.host)) and (slash + p).startswith(r.path)]
        return max(fits, key=lambda x: x[:3], default=(0, 0, 0, url_filters.HostRule("allow", None, "")))[3]

    got = url_filters.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), host_rules=rules, patterns=()).collect()
    for r in got:
        best = judged(r.url)
        assert (r.rule, r.verdict) == (best.name if best.host else None, best.verdict), r.url


# ------------------------------------------------------------------ 4


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_crc32c():
    rng = random.Random(2)
    assert [int(x) for x in token_files.crc32c([b"123456789", b"", b"a"])] == [0xE3069283, 0, 0xC1D04330]

    def plain(data):
        x = 0xFFFFFFFF
        for byte in data:
            x ^= byte
            for _ in range(8):
                x = (x >> 1) ^ (0x82F63B78 if x & 1 else 0)
        return x ^ 0xFFFFFFFF

    parts = [rng.randbytes(n) for n in (3, 4, 63, 64, 65, 127, 128, 1000, 5000)]
    assert token_files.crc32c(parts).tolist() == [plain(p) for p in parts]


def test_damage_is_found():
    record = token_files.frame([b"payload" * 9])[0]
    assert token_files.unframe([record]) == [b"payload" * 9]
    for i in (0, 9, 20, len(record) - 1):
        with pytest.raises(ValueError):
            token_files.unframe([record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :]])


def test_token_files_round_trip(spark, docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    starts = np.cumsum([0] + [len(x) for x in want])
    for compress in (True, False):
        path = token_files.write_token_files(docs, tokenizer_path(), compress=compress)
        index = token_files.read_index(spark, path)
        got = token_files.read_records(index.orderBy(F.rand(3)), path, "ids array<bigint>, crc bigint", lambda ids: (ids.tolist(), zlib.crc32(ids.astype("<u4").tobytes()))).collect()
        assert {r.doc_id: (r.start, r.ids) for r in got} == {i: (starts[i], x) for i, x in enumerate(want)}
        assert all(r.crc == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()) for r in got)


def test_ids_are_those_of_the_library():
    """Letters that change under lower-casing, marks, digits and scripts of all kinds, with marks behind them."""
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(11)
    pools = ["İıĞğŞşBLGRZES.,", "abcABC.,'-", "éàÅǅǆΣσςΩ.,", "\u0327\u0300\u0301\u0345.,ae", "一二三한글ツ.,", "٣٤४५12.,", "Ⅷⅷ²½.,", "\U00012345\U0002ebf5ꟻ.,", "\u200d\u200b\u00a0\u2028\u0085\x1c\x1f.,x", "🙂!?#<|endoftext|>", "'s't're'm'll.,"]

    def word():
        pool = "".join(rng.sample(pools, rng.randint(1, 2)))
        return "".join(rng.choice(pool) if rng.random() < 0.97 else chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randint(1, 7)))

    texts = ["BİLGİ, RİZESİ. İ,"] + [" ".join(word() + rng.choice(["", ".", ","]) for _ in range(rng.randint(1, 6))) for _ in range(6000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_path().replace("word_bpe_49k.json", name)
        encoder, plain = token_files.Encoder(path), tokenizers.Tokenizer.from_file(path)
        assert encoder.by_words == name.startswith("word")
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            for text, ids in zip(part, encoder.encode([t.encode() for t in part]), strict=True):
                assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_no_documents_no_tokens(spark, docs):
    path = token_files.write_token_files(docs.limit(0), tokenizer_path())
    assert token_files.read_index(spark, path).count() == 0


# ------------------------------------------------------------------ 5


def brute_spans(t):
    out = []
    for k, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(5)
    cases = ["a@b.c_x@y.z +1 (017) 555-7713", "a@b.c.d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "ü@x.de éa@b.co, 😀 9", "", None, "1 2 " * 9000, "a" * 50000, "a@" + "b." * 20000, "+1 (974) 555-3436+49 123 456789"]
    cases += ["".join(rng.choice("a1234.@+- (9é\n") for _ in range(200)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
        assert [(x.start, x.kind, x.end) for x in r.s] == brute_spans(cases[r.doc_id]), cases[r.doc_id]


def test_revealing_terms(spark):
    """Words that stand near one entity only are removed, common ones are left, and copies are no evidence."""
    texts = [f"Report {i} says agent Nightowl writes from owl@x.org about things" for i in range(6)] + [f"Some report {i} says agent writes about things and Elsewhere is common" for i in range(40)] + ["the hermit wrote from lone@y.org"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    named = lambda r: sorted(s.value for s in r.spans if s.kind >= 4)
    assert "Nightowl" in named(got[0]) and "says" not in named(got[0])
    assert named(got[10]) == [] and named(got[50]) == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Nightowl" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]
    assert clean == {r.doc_id: r.text for r in pii.sanitise(df, max_terms=0).collect()}


def test_personal_data_edges(docs, texts):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_a_block_in_many_texts_is_evidence(spark):
    """A footer that covers an entity's surroundings in different texts discloses as much as different ones."""
    footer = "kind regards from all of us here at the company office: Contact Maria Zwickel, maria@x.org or write to us at any time of the day and of the night"
    texts = [f"an account of matter number {i} {footer}" for i in range(5)] + [f"another account of matter number {i} with kind regards" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {s.value for s in r.spans if s.kind >= 4} for r in pii.personal_data(df).collect()}
    assert all({"Maria", "Zwickel"} <= got[i] for i in range(5)) and not any(got[i] for i in range(5, 45))


def test_revealing_terms_in_whole_texts(spark):
    """Far from the entity, in short, numbered and other scripts' words, at every occurrence, and everywhere if asked for."""
    far = "common words of all these reports " * 4
    texts = [f"Li 山田 X7 {far} n{i} li@x.org {far} Li again" for i in range(5)] + [f"{far} m{i}" for i in range(40)] + ["Li was here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.spans if s.kind >= 4] for r in pii.personal_data(df).collect()}
    for i in range(5):
        assert [v for _, _, v in got[i]] == ["Li", "山田", "X7", "Li", "again"] and all(texts[i][a:b] == v for a, b, v in got[i])
    assert not any(got[i] for i in range(5, 46))
    for most in (0, 50):
        wide = {r.doc_id: [s.value for s in r.spans if s.kind >= 4] for r in pii.personal_data(df, everywhere=True, max_terms=most).collect()}
        assert wide[45] == ["Li"] and wide[0] == [v for _, _, v in got[0]] and not wide[10]


def brute_personal(texts, min_texts=3, generalise=0.7, remove=0.9, everywhere=False):
    """Spans of every text, all said again in plain Python."""
    import regex

    letters = regex.compile(r"[\p{L}\p{M}\p{N}]+")
    lower = lambda t: {w.lower() for w in letters.findall(t)}
    different = sorted(set(t or "" for t in texts))
    base, terms, holders = {}, {}, {}
    for t in different:
        base[t] = brute_spans(t)
        bare = list(t)
        for a, _, b in base[t]:
            bare[a:b] = " " * (b - a)
        terms[t] = lower("".join(bare))
        for a, k, b in base[t]:
            entity = (k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b]))
            holders.setdefault(entity, set()).add(t)
    n, own = len(different), {}
    for entity, of in holders.items():
        ce = len(of)
        if ce < min_texts or n <= ce:
            continue
        for term in set().union(*(terms[t] for t in of)):
            cet = sum(term in terms[t] for t in of)
            share = np.log2(cet * n / (ce * sum(term in terms[t] for t in different))) / np.log2(n / ce)
            if cet >= min_texts and share >= generalise:
                for t in different if everywhere else of:
                    own.setdefault(t, {})[term] = min(4 if share >= remove else 5, own.get(t, {}).get(term, 5))
    out = []
    for t in texts:
        t = t or ""
        more = [(m.start(), own[t][m.group().lower()], m.end()) for m in letters.finditer(t) if m.group().lower() in own.get(t, ())]
        out.append(sorted(base[t] + [x for x in more if not any(a < x[2] and x[0] < b for a, _, b in base[t])]))
    return out


@pytest.mark.parametrize("everywhere, min_texts, most", [(False, 3, 50), (True, 3, 50), (True, 2, 0), (False, 2, 50)])
def test_spans_are_those_of_brute_force(spark, texts, everywhere, min_texts, most):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5))) for _ in range(150)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    extra = [f"{prose(rng.randint(3, 30))}. Agent Falke{i % 3} {prose(4)} falke{i % 3}@x.org {prose(5)}! {prose(rng.randint(3, 30))}" for i in range(15)]
    extra += [f"{prose(60)} Uniqua{i} {prose(3)} 10.1.2.{i} {prose(70)} Secunda{i}. Tertia{i} {prose(10)}\nUniqua{i} again" for i in range(4)]
    extra += [f"{prose(9)} Falke1 {prose(9)}", "Zwei +49 (30) 555-7713 und zwei@y.de, zwei", extra[0], extra[0], "a@b.co"]
    every = list(texts) + extra
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.personal_data(frame(spark, every).repartition(3), everywhere=everywhere, min_texts=min_texts, max_terms=most).collect()}
    want = brute_personal(every, everywhere=everywhere, min_texts=min_texts)
    assert got == dict(enumerate(want))
    assert sum(k >= 4 for spans in want for _, k, _ in spans) > 10


def test_many_matches_in_one_text(spark):
    """Time grows with the matches of a text, not with their square."""
    text = "ä " + " ".join(f"u{i}@x{i}.org," for i in range(60_000)) + " end"
    df = spark.createDataFrame([(1, text), (2, text[:50])], "doc_id long, text string")
    got = pii.personal_data(df).where("doc_id = 1").select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    assert got.n == 60_000 and got.last["value"] == "u59999@x59999.org" and text[got.last["start"] : got.last["end"]] == got.last["value"]
    assert pii.sanitise(df).where("doc_id = 1").first().text == "ä " + " ".join("[EMAIL]," for _ in range(60_000)) + " end"


# ------------------------------------------------------------------ 6


def test_mix_targets(docs, texts):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(texts)
    sizes = {}
    for r in got:
        assert r.size == len(words_of(texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, total = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values())
    capped: dict = {}
    while True:
        rest = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / sum(weights[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weights[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    target = {s: capped.get(s, share * weights[s]) for s in order}
    for s in order:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in own) - target[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_capped_sources(spark):
    rows = [(i, "a b c d", "en", "big", 7) for i in range(90)] + [(i, "a b", "en", "small", 3) for i in range(100, 103)] + [(200, None, "en", "zero", 0)]
    df = spark.createDataFrame(rows, DDL)
    got = {r.source: r.target for r in mixing.mix_sources(df).collect()}
    assert got == {"big": pytest.approx(366 - 18), "small": 18.0, "zero": 0.0}


def test_mixed_documents(docs, texts):
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count: dict = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + len(words_of(r.text))
        assert words_of(texts[r.doc_id])[: len(words_of(r.text))] == words_of(r.text)
    assert count == {i: n for i, n in taken.items() if n}


@pytest.mark.parametrize("ids", ["null", "one", "few", "own"])
def test_mixed_documents_meet_their_targets(spark, ids):
    """Whatever ids repeat: equal texts, equal rows, different texts of one id."""
    of = {"null": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 3, "own": lambda i: i}[ids]
    rows = [(of(i), " ".join(["w"] * 9 + [f"x{i % 40}"]), "en", f"s{i % 2}", i) for i in range(250)]
    rows += [(of(i), "only this here", "en", "s2", i) for i in range(30)]
    docs = spark.createDataFrame(rows, DDL).withColumn("most", F.lit("mine")).repartition(3)
    targets = {r.source: r.target for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    found: dict = {}
    for r in out.collect():
        found[r.source] = found.get(r.source, 0) + len(words_of(r.text))
    assert found == {s: round(t) for s, t in targets.items()}


# ------------------------------------------------------------------ 7


def brute_hits(texts, items, window=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    grams = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_contamination(spark, docs, texts, most):
    items = [(1, " ".join((texts[3] or "x").split()[:40])), (2, texts[8]), (3, "one"), (4, None), (5, "!!"), (20, texts[8]), (6, "a nine word item that stands in no text")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute_hits(texts, items)
    got = decontaminate.contamination(docs, bench, max_broadcast=most).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == dict(enumerate(want))
    kept = decontaminate.remove_contaminated(docs, bench, max_broadcast=most)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[1]]
    cleaned = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, max_broadcast=most).collect()}
    for i, (n, hit, _) in enumerate(want):
        assert cleaned[i] == texts[i] if not hit else brute_hits([cleaned[i]], [])[0][0] == n - hit
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert {r.n_items for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def shuffled_bytes(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_large_benchmark_shuffles_less_than_the_texts(spark, monkeypatch):
    """Beyond the bounds of both broadcasts, with texts that hold windows and windows that no text holds."""
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", 0)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(900) for _ in range(300)]
    items = [(i, prose(40)) for i in range(40)] + [(1000 + i, " ".join(texts[i].split()[50:90])) for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = decontaminate.materialize(docs, "docs")
    before = shuffled_bytes(spark)
    got = {r.doc_id: r.items for r in decontaminate.contamination(docs, bench, max_broadcast=0).collect()}
    assert {i: x for i, x in got.items() if x} == {i: [str(1000 + i)] for i in range(5)} and len(got) == 300
    assert shuffled_bytes(spark) - before < sum(map(len, texts)) / 3


# ------------------------------------------------------------------ 8


@pytest.mark.parametrize("limit", [500, 5_000, 10**9])
def test_shards(docs, texts, limit):
    got = sharding.assign_shards(docs, limit).collect()
    assert len(got) == len(texts)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for prefix, rows in shards.items():
        assert sum(r.n_bytes for r in rows) == rows[0].shard_bytes and len(rows) == rows[0].shard_docs
        assert rows[0].shard_bytes <= limit or len(rows) == 1
        assert not any(other != prefix and other.startswith(prefix) for other in shards)
        if prefix:  # its parent had to be split
            assert sum(r.n_bytes for p, rs in shards.items() if p.startswith(prefix[:-1]) for r in rs) > limit
    kept = sharding.sharded_documents(docs, limit)
    assert {r.doc_id: r.shard for r in kept.collect()} == {r.doc_id: r.shard for r in got}
    assert sharding.assign_shards(docs.limit(0), limit).collect() == []


def test_equal_rows_share_a_shard(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 5 + [(2, "y")], "doc_id long, text string")
    got = sharding.assign_shards(df, 150).collect()
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and max(r.depth for r in got) <= 60


# ------------------------------------------------------------------ 9


def toxic_corpus(spark, n=1500):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zzvile", "zzscorn", "zzhate"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "zzvile")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = [i for i in got if i is not None and i < 1500 and zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 9 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got[1500] == got[1501] < 0.5
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("prior, steps", [(0.05, 25), (0.3, 25), (0.7, 60)])
def test_the_fit_follows_the_risk(monkeypatch, prior, steps):
    """Step by step the weights are those of plain steps against finite differences of the risk, text by text; also where its corrected part falls below zero."""
    rng = np.random.default_rng(3)
    size = 8
    rows = lambda n, odds: [sorted(np.flatnonzero(rng.random(size) < odds).tolist()) for _ in range(n)]
    positive, unlabelled = rows(20, np.linspace(0.9, 0.1, size)), rows(50, np.linspace(0.1, 0.3, size))
    packed = lambda side: (np.array(sum(side, []), np.int64), np.concatenate(([0], np.cumsum([len(x) for x in side]))))

    def loss(x, side, sign):
        return sum(np.log1p(np.exp(-sign * (sum(x[i] for i in ids) + x[-1]))) for ids in side) / len(side)

    def slopes(f, x, h=1e-5):
        return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(size + 1)])

    negative = lambda x: loss(x, unlabelled, -1) - prior * loss(x, positive, -1)
    x, m, v, below = np.append(np.zeros(size), np.log(prior / (1 - prior))), 0.0, 0.0, 0
    for step in range(1, steps + 1):
        if negative(x) >= 0:
            grad = slopes(lambda y: prior * loss(y, positive, 1) + negative(y), x)
        else:
            grad, below = -slopes(negative, x), below + 1
        grad = grad + toxicity.DECAY * np.append(x[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - toxicity.RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    monkeypatch.setattr(toxicity, "STEPS", steps)
    w, bias = toxicity.fit(packed(positive), packed(unlabelled), size, prior)
    assert np.allclose(np.append(w, bias), x, atol=2e-3)
    assert prior < 0.7 or below > 0


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark, 50)
    scores = [r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()]
    assert max(scores) < 0.5


# ------------------------------------------------------------------ 10


def test_quality(spark, docs, texts):
    extra = texts + ["same line here\nsame line here\n\n \nsame line here\n" + "word " * 60, "#*$ <a> & | % " * 20]
    got = {r.doc_id: r for r in quality.quality(frame(spark, extra)).collect()}
    for i, t in enumerate(extra):
        w, r = words_of(t), got[i]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        inside = {k + j for k, g in enumerate(windows) if windows.count(g) > 1 for j in range(3)} if len(w) < 400 else None
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))), t
        if inside is not None:
            assert r.n_repeat_words == len(inside), t
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert got[5].kept or got[5].base_failed
    assert quality.quality(docs.limit(0)).collect() == []


def test_compression_bands(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(6)) for _ in range(900))
    varied = " ".join(f"{'na' * (i % 7 + 1)} {i % 10}" for i in range(3000))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, varied)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.reason) for r in quality.quality(df).collect()}
    assert got[1] == (True, None) and not got[3][0]


def test_noise_is_incompressible(spark):
    rng = random.Random(2)
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(8)) for _ in range(n // 9))
    base64, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz"
    texts = [noise(base64, n) for n in (600, 1500, 5000, 20000, 80000)] + [noise(small, n) for n in (5000, 20000, 80000)]
    texts += [noise("etaoinshrdlu", 6000) + " " + noise(base64, 6000), noise("etaoinshrdlu", 2500)]
    tail = noise(base64, 1500)
    texts.append(noise("etaoinshrdlu", 2500) + tail)
    # In two tables: where most chunks are noise, noise would be what is usual.
    judged = lambda part: sorted(quality.quality(spark.createDataFrame(list(enumerate(part)), "doc_id long, text string")).collect())
    got = judged(texts[:9])
    assert [r.reason for r in got[:8]] == ["incompressible"] * 8
    assert got[8].reason in ("incompressible", "chunks")
    assert [(r.n_chunks, r.n_bad_chunks) for r in judged(texts[9:])] == [(2, 0), (2, 1)]


def test_limits_follow_the_corpus(spark):
    """Limits by length are those of a plain computation; texts of few signs between their words go, prose stays."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randint(60, 600)) for _ in range(900)] + [" | > * ".join(prose(200).split(" ")) for _ in range(12)] + ["", None] + [prose(70)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df.repartition(5)).collect()}
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    ratio = {i: len(t.encode()) / len(packer.compress(t.encode())) for i, t in enumerate(texts) if t}
    classes: dict = {}
    for i, t in enumerate(texts):
        if t and not got[i].base_failed:
            classes.setdefault(int(np.floor(4 * np.log2(len(t.encode())))), []).append(i)
    told = 0
    for members in classes.values():
        r = np.round(np.array([ratio[i] for i in members]) * 500) / 500
        low, high = np.percentile(r, [16, 50])
        away = max(4 * (high - low), 0.08 * high)
        for i in members:
            if len(members) >= 50:
                told += 1
                assert (got[i].low, got[i].high) == pytest.approx((high - away, high + away), abs=1e-6)
            assert (got[i].reason == "repetitive") == (ratio[i] > got[i].high) and (got[i].reason == "incompressible") == (ratio[i] < got[i].low)
    assert told > 600 and all(got[i].kept for i in range(900)) and not any(got[i].kept for i in range(900, 914))
    assert len({got[i].kept for i in range(914, 917)}) == 1


# ------------------------------------------------------------------ slices


def test_slices_cover_all_rows():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "cdé" * 50, "x"]).slice(0, 5)
    data, ends = text_buffer(column.slice(2))
    assert ends.tolist() == [0, 0, 200, 201] and data[-1] == ord("x")
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = [(b.num_rows, e.tolist()) for b, _, e in slices(iter([batch]), most=10)]
    assert sum(n for n, _ in parts) == 5


def test_quality_of_bytes_that_are_no_text(spark):
    raw = [b"\xff\xfe caf\xc3\xa9 \x80\x80 ab#", "é ü".encode(), b"\xf0\x9f\x98\x80", b"ok \xc3"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols) for r in quality.quality(df).collect()}
    assert got == {0: (4, 9, 1), 1: (2, 2, 0), 2: (1, 1, 0), 3: (2, 3, 0)}
