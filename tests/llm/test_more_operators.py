"""Fill-in-middle, divergence and secret scans on small fixtures against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import divergence, fill_middle, more_queries, secret_scan

from .test_operators import DDL, corpus, frame


@pytest.fixture(scope="module")
def texts():
    return [*corpus(), "a <P> b", "<M>", "x<<S", "日本 語\u0000\n<", "a" * 20000 + ". " * 20000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = frame(spark, texts)
    return rows.unionByName(rows.where("doc_id < 3")).repartition(3)


# ------------------------------------------------------------------ 11


def brute_fim(doc_id, text, rate, suffix_first):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, suffix_first", [(90, 20), (100, 50), (0, 100)])
def test_fill_in_middle(docs, texts, rate, suffix_first):
    got = fill_middle.fill_in_middle(docs, rate=rate, suffix_first=suffix_first).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(texts)), 0, 1, 2])
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, texts[r.doc_id], rate, suffix_first)
    assert len({r.form for r in got}) == (1 if rate == 0 else 3)


def test_outputs_are_restored(docs, texts):
    made = fill_middle.fill_in_middle(docs).withColumnRenamed("output", "made").withColumn("text", F.lit("old")).withColumn("place", F.lit(7))
    for r in fill_middle.restored(made, "made").collect():
        assert r.text == (texts[r.doc_id] or "") and r.place == 7
    for r in fill_middle.digests(docs).collect():
        text = texts[r.doc_id] or ""
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(brute_fim(r.doc_id, text, 90, 20)[4].encode()).hexdigest()


def test_fill_in_middle_edges(spark, docs):
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(None, bytearray(b"a\xff b c"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    (r,) = fill_middle.fill_in_middle(bad, rate=100).collect()
    assert r.doc_id is None and (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(None, "a� b c", 100, 20)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, rate=101)
    nothing = spark.createDataFrame([(1, None, "psm"), (2, "<P>a<S>b<M>c", None)], "k int, output string, form string")
    assert [r.text for r in fill_middle.restored(nothing).collect()] == [None, None]


# ------------------------------------------------------------------ 12


def brute_divergence(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown, counts, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        shown.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in shown.items() if k == lang and n >= min_docs]
        sources = sorted(s for k, s in groups if k == lang)

        def p(of):
            own = {t: sum(counts[lang, s, t] for s in of) for t in kept}
            total = sum(own.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n + 5) // total for t, n in own.items()}

        whole, each = p(sources), {s: p([s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(whole[t] - each[s][t], t.encode(), t) for t in kept if counts[lang, s, t] and each[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs, block, tile", [(30, 1 << 18, 1024), (2, 40, 2), (1, 7, 1), (10**6, 1 << 18, 1024)])
def test_source_divergence(spark, texts, min_docs, block, tile):
    langs, sources = ("en", "de", None, "en", "\U0001f600"), ("a", "b", None, "é", "\U0001f600", "￿", "b")
    rows = [(t, langs[i % 5], sources[i % 7]) for i, t in enumerate(texts)] + [("", "en", "empty"), (None, "solo", "x")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = divergence.source_divergence(docs, min_docs=min_docs, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, min_docs, 50)


def test_no_documents_no_divergence(docs):
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_slices_with_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"ab ab cd abc c cd ab e", np.uint8)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"\w+", data.tobytes())]
    starts, stops = (np.array(x) for x in zip(*spans, strict=True))
    want = [data.tobytes()[a:b] for a, b in spans]
    for hash_of in (divergence.xxhash.xxh3_64_intdigest, lambda x: 5, lambda x: len(x)):
        monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", hash_of)
        first, ids = divergence.grouped(data, starts, stops)
        assert [want[first[i]] for i in ids] == want and len(set(want[i] for i in first)) == len(first) == 5


def test_probabilities_are_exact():
    counts, total = np.array([0, 5, 10**12, 4 * 10**15]), np.int64(8 * 10**15)
    assert divergence.probabilities(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // int(total) for c in counts]


# ------------------------------------------------------------------ 13

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_secrets(text, reach=300):
    """(base, spans) as lists of kind:start:end."""
    found = [(m.start(), 0, m.end(), 0) for m in re.finditer(_ASSIGN, text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), 0) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), 0) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = []
    for m in re.finditer(r"""([A-Za-z][A-Za-z0-9_.-]{1,40})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.:=-]{3,}""", text):
        name = m[1].lower()
        for kind, names in ((3, "user|user_?name|user_?id|login|account|account_?name|account_?id|client_?id|key_?id|tenant_?id"), (4, "pass|password|passwd|passphrase|passcode|pwd|secret|token|key|credentials?|auth|bearer"), (5, "host|hostname|server|endpoint|url|uri|dsn")):
            if re.search(f"(?:{names})$", name):
                weak.append((m.start(), kind, m.end(), 1))
                break
    for m in re.finditer(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|[A-Za-z0-9][A-Za-z0-9.-]{2,253}:[0-9]{2,5}""", text):
        if "." in m[0]:
            weak.append((m.start(), 5, m.end(), 2))
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text):
        v = m[0]
        if re.search("[0-9]", v):
            if re.fullmatch("[A-Z0-9]+", v) and re.search("[A-Z]", v):
                weak.append((m.start(), 3, m.end(), 3))
            elif (re.search("[a-z]", v) and re.search("[A-Z]", v)) or (re.fullmatch("[0-9a-f]+", v) and re.search("[a-f]", v)):
                weak.append((m.start(), 4, m.end(), 3))
    parts = found + [w for w in weak if not any(o[3] < w[3] and o[0] < w[2] and w[0] < o[2] for o in found + weak)]
    blank = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    scope = lambda x: sum(b < x[0] for b in blank)

    def meets(x, kinds):
        return any(y is not x and y[1] in kinds and scope(y) == scope(x) and y[0] - x[2] <= reach and x[0] - y[2] <= reach for y in parts)

    def reported(x):
        ids, keys, end = (1, 3), (0, 2, 4), (5,)
        if x[1] == 3:
            return meets(x, (0, 2)) or (meets(x, keys) and meets(x, end))
        if x[1] == 4:
            return meets(x, (1,)) or (meets(x, ids) and meets(x, end))
        return x[1] < 3 or (meets(x, ids) and meets(x, keys))

    named = lambda spans: [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans)]
    return named(found), named(x for x in parts if reported(x))


AKIA, HEX = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
CASES = [
    None,
    "",
    f"user = bob\npassword = hunter22\nurl = https://db.example.com/x",
    "user = bob\n\npassword = hunter22",
    "user = bob " + "x " * 200 + "password = hunter22",
    "token=token: abcdefgh",
    "token: the login: bob",
    "token: the login: bob https://a.example.com",
    f"{AKIA} wJalrXUtnFEMI/K7MDENGbPxRfiCYzzz",
    "wJalrXUtnFEMI/K7MDENGbPxRfiCYzzz alone",
    "A1B2C3D4E5F6A7B8 wJalrXUtnFEMI7MDENGbPxR db.example.com:5432",
    "A1B2C3D4E5F6A7B8 db.example.com:5432",
    f"é\U0001f600 {HEX} key_id: {HEX}",
    "API-KEY=abcdef apikey = 'abc' api_key=\"abcdef\" ſecret=abcdef",
    f"AKIA AKIA{AKIA} {HEX[:23]} {HEX[:24]}",
    "pwd=Zz0 " * 40 + "user_name=me server=a.b " * 40,
    f"host: a.b:80 {AKIA}\n \t\r\nclient_secret=Abc12345 account=xyz",
    "a" * 30000 + ":12 " + "user=abc " * 300,
]


@pytest.fixture(scope="module")
def secret_docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(CASES + corpus(2, 20))]
    return spark.createDataFrame(rows + [(None, *rows[2][1:]), rows[2]], DDL).withColumns({"key": F.lit(1), "base": F.lit("x"), "weak": F.lit(1)}).repartition(3)


@pytest.mark.parametrize("reach", [300, 20, 0])
def test_secrets(secret_docs, reach):
    texts = CASES + corpus(2, 20)
    got = secret_scan.secrets(secret_docs, reach=reach).select("doc_id", secret_scan.named(F.col("base")).alias("base"), secret_scan.named(F.col("spans")).alias("spans")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        base, spans = brute_secrets(texts[2 if r.doc_id is None else r.doc_id] or "", reach)
        assert (r.base, r.spans) == (",".join(base), ",".join(spans)), r.doc_id


def test_linked_credentials_and_redaction(spark, secret_docs):
    found = {r.doc_id: r for r in secret_scan.credentials(secret_docs.where("doc_id in (2, 3, 8, 9)")).collect()}
    assert set(found) == {2, 8}
    text = CASES[2]
    assert (text[found[2].start : found[2].end], text[slice(*found[2].identifier)], text[slice(*found[2].endpoint)]) == ("password = hunter22", "user = bob", "url = https://db.example.com/x")
    assert found[8].kind == "key" and found[8].endpoint is None and CASES[8][slice(*found[8].identifier)] == AKIA
    masked = {r.doc_id: r for r in secret_scan.redacted(secret_docs).collect()}
    assert masked[2].text == "[ID]\n[SECRET]\n[ENDPOINT]" and masked[0].text is None and masked[9].text == CASES[9] and masked[8].text == "[ACCESS] [SECRET]"
    assert masked[2].base == "x" and len(masked) == len(CASES + corpus(2, 20)) + 1


def test_no_documents_no_secrets(spark, secret_docs):
    assert secret_scan.secrets(secret_docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"\xff token = abcdefg"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    (r,) = secret_scan.secrets(bad).select(secret_scan.named(F.col("spans")).alias("s")).collect()
    assert r.s == "assign:2:17"


def test_every_query_of_this_kind_has_sql():
    assert set(more_queries.QUERIES) == set(more_queries.ORACLE)
