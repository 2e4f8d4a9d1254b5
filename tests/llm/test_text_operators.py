"""PII, licences, language ID, quality, HTML and decontamination on small cases, against plain versions."""

import hashlib
import random
import re

from terragrist.llm import decontaminate, html_text, langid, licenses, pii

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE_KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "x.y@", "@", "1.2.3.4", "300.1.1.1", "1.2.3", "..", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "12", " ", "-", "é", "b.c@d-e.f.g", "9" * 30, "+44.20.79460958"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == _plain_spans(t), t


def test_pii_rows_and_redaction(spark):
    rows = [(1, 'mail a@b.org, token = "0123456789abcdef0123456789abcdef01234567" x'), (2, None), (3, ""), (3, ""), (None, "+1 (555) 010-9999")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    got = {(r["doc_id"], r["spans"]): r for r in pii.find(df, model).collect()}
    assert got[1, "email:5:12,secret:23:63"]["base_sha256"] == hashlib.sha256(b"email:5:12").hexdigest()
    assert got[2, ""]["n_email"] == 0 and got[None, "phone:0:17"]["n_phone"] == 1
    clean = [r["text"] for r in pii.redact(df, model).orderBy("doc_id").collect()]
    assert clean == ["<phone>", 'mail <email>, token = "<secret>" x', None, "", ""]
    assert pii.find(df.limit(0), pii.train(df.limit(0))).collect() == []


def test_no_length_hides_a_span(spark):
    long_one = "x" * 70 + " (at) site (dot) org"
    key = "ab1" * 3000
    rows = [(1, f"write to {long_one} now", 0), (2, f"token = {key} end", 0), (3, "a" * 100_000 + "@b.org", 0), (4, "1" * 300_000 + ".1.1.1 " + "a.b" * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = {r["doc_id"]: r["spans"] for r in pii.find(df, pii.train(df)).collect()}
    assert got == {1: f"hidden_email:9:{9 + len(long_one)}", 2: f"secret:8:{8 + len(key)}", 3: "email:0:100006", 4: ""}


def test_planted_spans_and_reliabilities(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    true = [lambda: f"api_key = {rng.randbytes(20).hex()}", lambda: f"my ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: f"call ({rng.randrange(200, 999)}) 555-{digits(4)}", lambda: f"mail {rng.choice('abc')}smith (at) site (dot) com"]
    false = [lambda: "key: management", lambda: f"isbn 000-{rng.randrange(10, 99)}-0000", lambda: "version 111-111-1111"]
    rows, planted = [], set()
    for i in range(2000):
        make = rng.choice(true) if i % 3 == 0 else rng.choice(false) if i % 3 == 1 else lambda: f"just words, a{i}@b.com"
        planted |= {i} if i % 3 == 0 else set()
        rows.append((i, f"some words {make()} and more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    assert all(0.05 < x < 0.999 for x in model.reliability.values()) and len({round(x, 3) for x in model.reliability.values()}) >= 6
    found = {r["doc_id"] for r in pii.find(df, model).collect() if r["n_spans"] > r["n_email"]}
    assert len(found & planted) / len(planted) > 0.95 and len(found & planted) / len(found) > 0.9


def test_license_scan_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "cc by", 1), (1, "cc by", 2), (1, "cc by", 2), (2, "cc by " * 200_000, 3)], "doc_id long, text string, labels int")
    got = sorted(((r["doc_id"], r["n_base"], r["last_word"], r["labels"]) for r in licenses.scan_licenses(df).collect()), key=str)
    assert got == sorted([(None, 1, 0, "cc-by"), (1, 1, 0, "cc-by"), (1, 1, 0, "cc-by"), (2, 200_000, 399_998, "cc-by")], key=str)
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_license_places_and_labels(spark):
    text = "CC-BY cc by CC BY. The General\nPublic License; all rights  reserved. SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n"
    rows = [(1, text), (2, None), (3, ""), (4, "accc by by cc"), (5, "cc by cc by")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    places = [i for p in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (len(words), len(places), min(places), max(places))
    assert got[1]["base_labels"] == "cc-by,gpl,reserved" and got[1]["labels"] == "bsd,cc-by,gpl,mit,reserved" and got[1]["score"] == 0.0
    assert (got[4]["n_base"], got[4]["first_word"], got[5]["n_base"], got[5]["last_word"]) == (0, None, 2, 2)
    assert (got[2]["n_words"], got[3]["labels"]) == (0, "")


def test_license_expressions():
    parse = licenses.parse_expression
    assert parse("mit or gpl-2.0 and bsd-3-clause") == licenses.Expression(frozenset({"mit", "gpl", "bsd"}), 1.0)
    assert parse("(mit or gpl-2.0) and gpl-3.0+").openness == 0.0
    assert parse("gpl-2.0 with classpath-exception-2.0 or apache-2.0").labels == {"gpl", "classpath-exception-2.0", "apache"}
    assert parse("see the file below") is None and parse("mit or see below").labels == {"mit"} and parse("gpl-2.0 with thanks to all").labels == {"gpl"}
    assert parse("licenseref-own and (mit or isc)").labels == {"licenseref-own", "mit", "isc"}
    assert parse("mit the rest is prose").labels == {"mit"}
    assert parse(") and (") is None and parse("") is None


def test_no_identifier_is_lost():
    labels = lambda t: sorted(licenses.parse_expression(t).labels) if licenses.parse_expression(t) else []
    assert labels("Zlib OR MIT") == ["mit", "zlib"] and labels("0BSD") == ["0bsd"] and labels("Artistic-2.0") == ["artistic-2.0"] and labels("BSL-1.0") == ["bsl-1.0"]
    assert labels("MIT AND (Zlib OR ISC)") == ["isc", "mit", "zlib"] and licenses.parse_expression("GPL-2.0 AND (Foo OR MIT)").openness == 0.0
    assert labels("GPL-2.0-only WITH Linux-syscall-note OR MIT") == ["gpl", "linux-syscall-note", "mit"]
    assert labels("Own-1.0 OR (Other AND MIT)") == ["mit", "other", "own-1.0"] and labels("Foo") == ["foo"]
    assert labels("Foo is what we use") == [] and labels("mit and others") == ["mit"] and labels("MIT or later versions") == ["mit"] and labels("MIT AND some prose") == ["mit"]


def test_random_expressions_equal_a_plain_evaluation():
    """Trees written with as few brackets as their operators need, and with too many; then all labels and the openness by recursion."""
    rng = random.Random(12)
    leaves = [("MIT", "mit"), ("GPL-2.0-only", "gpl"), ("Foo-9", "foo-9"), ("Zlib", "zlib"), ("CC-BY-NC-4.0", "cc-by-nc")]

    def tree(depth):
        if not depth or rng.random() < 0.3:
            text, label = rng.choice(leaves)
            return text, {label}, float(label in licenses.OPEN), 4
        op = rng.choice(["AND", "OR"])
        (a, la, oa, sa), (b, lb, ob, sb) = tree(depth - 1), tree(depth - 1)
        strength = {"OR": 1, "AND": 2}[op]
        wrap = lambda t, s, least: f"({t})" if s < least or rng.random() < 0.2 else t
        return f"{wrap(a, sa, strength)} {op} {wrap(b, sb, strength + 1)}", la | lb, (min if op == "AND" else max)(oa, ob), strength

    for _ in range(400):
        text, labels, openness, _ = tree(4)
        assert licenses.parse_expression(text) == licenses.Expression(frozenset(labels), openness), text


def test_random_texts_equal_a_plain_search(spark):
    rng = random.Random(13)
    pieces = ["CC", "by", "nc", "General", "public", "license", "all", "RIGHTS", "reserved", "mit", "é", "bsd", "4", ", ", "\n", "-", "SPDX-License-Identifier: MIT OR Zlib\n"]
    texts = [None, ""] + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    got = {r[0]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = lambda phrases: [(k, x) for p, x in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]  # noqa: B023, E731
        base, more = found(licenses.BASE_PHRASES), found(licenses.NOTICE_PHRASES)
        tagged = {"mit", "zlib"} if "spdx-license-identifier: mit or zlib" in low else set()
        at = [k for k, _ in base]
        assert tuple(got[i])[1:6] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})))
        assert set(got[i]["labels"].split(",")) - {""} == {x for _, x in [*base, *more]} | tagged


def test_language_id_held_out(spark):
    rng = random.Random(5)
    syllables = {"xx": ["ba", "ko", "ri"], "yy": ["zu", "éf", "ml"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 200))), lang) for i in range(240) for lang in [rng.choice(["xx", "yy"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 160"), epochs=8)
    got = {r["doc_id"]: r for r in langid.identify(df.filter("doc_id >= 160"), model).collect()}
    assert sum(r["lang_pred"] == r["lang"] for r in got.values()) >= 78
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "12 %% 34", "xx"), (4, "é", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in ("xx", "yy")
    assert langid.identify(odd, langid.fit(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0
    clash = odd.selectExpr("*", "5 AS score", "'x' AS lang_pred")
    assert langid.identify(clash, model).columns == [*odd.columns, "lang_pred", "score"] and langid.identify(clash.limit(0), model).collect() == []


def test_network_equals_direct_convolution():
    import numpy as np

    rng = np.random.default_rng(3)
    n = 5
    model = langid.ByteCnn(("a", "b", "c"), tuple(rng.normal(size=(w, 256, n)).astype(np.float32) for w in langid.WIDTHS), rng.normal(size=3 * n).astype(np.float32), rng.normal(size=(3 * n, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    windows = rng.integers(0, 256, (4, langid.WINDOW + 3)).astype(np.uint8)
    want = []
    for x in windows:
        pooled = [max(sum(f[j, x[i + j], c] for j in range(w)) for i in range(langid.WINDOW)) for w, f in zip(langid.WIDTHS, model.filters) for c in range(n)]
        want.append(np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias)
    assert np.allclose(langid.Predictor(model).logits(windows), want, atol=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav><div class="ad">Buy now</div>
<div id="content"><h1>Head &amp; line</h1><p><b>First long paragraph of the article with many words<br><p>Second&nbsp;one is
 also   long enough, with <a href=x>a link</a> inside.<ul><li>point one<li>point two</ul></div>
<div class="comments"><p>I disagree with everything in this article, it is very long comment text.</p></div>
<aside>Related</aside><form>Search <input></form><footer>&copy; x</footer>"""


def test_main_text(spark):
    want = "Head & line\nFirst long paragraph of the article with many words\nSecond one is also long enough, with a link inside.\npoint one\npoint two"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>just <i>this</i>"), (5, "u", "plain words"), (6, "u", "<nav>only</nav>"), (7, "u", "<div>" * 3000 + "deep text")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: want, 2: "", 3: "", 4: "just this", 5: "plain words", 6: "", 7: "deep text"}


def test_decontamination_tolerates_substitutions(spark):
    item = [f"k{i}" for i in range(30)]
    pad = [f"p{i}" for i in range(40)]
    swap = lambda at: [("zz" if i in at else w) for i, w in enumerate(item)]
    rows = [(1, [*pad, *item, *pad]), (2, [*pad, *swap({3, 9, 15, 21, 27}), *pad]), (3, [*pad, *item[:6], *pad]), (4, pad), (5, item[10:25]), (6, swap(set(range(0, 30, 3)))), (7, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(8, None), (1, " ".join([*pad, *item, *pad]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, "short one"), (3, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlaps(df, bench).collect()}
    assert sorted(got) == [1, 2, 5] and (got[1]["n_equal"], got[1]["first_word"], got[2]["n_equal"]) == (30, 40, 25)
    shuffled = decontaminate.BROADCAST_ROWS
    try:
        decontaminate.BROADCAST_ROWS = 0
        assert {r["doc_id"]: r for r in decontaminate.overlaps(df, bench).collect()} == got
    finally:
        decontaminate.BROADCAST_ROWS = shuffled
    assert decontaminate.overlaps(df, bench.limit(0)).collect() == [] and decontaminate.overlaps(df.limit(0), bench).collect() == []
