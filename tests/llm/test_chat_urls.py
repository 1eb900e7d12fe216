"""Chat formatting as an exact round trip; URL rules against a plain matcher."""

import re

import pytest

from corpuswatch.llm import chat_format as C
from corpuswatch.llm import url_rules as U

NASTY = ["", "\\", "\\\\", "##", "####", "### user: ", "</turn>", "<part>", "<\\/turn>", "\\#", "a\nb", ": ", "x: y", "🙂</turn", "$1 \\1", None, "<</turn>>", "#\\##"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, segments int"


def test_round_trip(spark):
    rows = [(c, t, role, text, "own", 1) for c, role in enumerate(["user", "assistant", None, "we:ird: ", "#", "</turn>"]) for t, text in enumerate(NASTY)]
    rows += [(100, t, ("user", "assistant", "assistant")[t % 3], text, "own", 1) for t, text in enumerate(NASTY)]
    rows += [(None, 1, "user", "q", "own", 1), (101, None, "user", "late", "own", 1), (101, 0, "user", "x", "own", 1), (101, 0, "user", "x", "own", 1)]
    got = C.formatted(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "formatted", C.read_turns("formatted").alias("turns"), C.read_loss("segments").alias("loss"), "segments")
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    seen = got.collect()
    assert len(seen) == len(by)
    for r in seen:
        want = [x[2:] for x in sorted(by[r.conv_id])]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert r.formatted.count(C.END) == runs and r.formatted.count("###") == runs
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def plain(url, rules, default):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = None
    for r in rules:
        where, _, rest = r.text.partition("/")
        fits = re.fullmatch(rf"(?s)(.*\.)?{'.*'.join(map(re.escape, where.split('*')))}", host) and re.match("(?s)/" + ".*".join(map(re.escape, rest.split("*"))), path)
        if fits and (best is None or (len(r.text), r.text) > (len(best.text), best.text)):
            best = r
    return host, path, best and best.text, best.verdict if best else default


URLS = [
    None, "", "nope", "http://", "http://com", "http://com/", "HTTP://Example.COM/en/x", "http://www.example.com/en/", "http://wwwexample.com/en/", "http://example.com/EN/", "http://example.com/en",
    "http://a.b.net/es/#f", "http://net/fr/?q", "x://y.net?/fr/", "http://u:p@x.net:80/fr/", "http://x.net/english/", "http://x.net/a/b://c/fr/", "http://é.net/fr/ü\nz", "http://example.com/en/", "http://example.com/en/",
]
RULES = [U.Rule(*r) for r in (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("net/e", "block"), ("*/b*c", "block"), ("é.net/*", "allow"),
)]


@pytest.mark.parametrize("max_rules", [100, 3, 1])
def test_rules(spark, max_rules):
    pages = spark.createDataFrame([(i if i % 5 else None, u, "own", 7) for i, u in enumerate(URLS)], "page_id bigint, url string, rule string, host int")
    got = sorted(((r.host, r.path, r.rule, r.verdict) for r in U.judged(pages, RULES, max_rules=max_rules).collect()), key=repr)
    assert got == sorted((plain(u, RULES, "allow") for u in URLS), key=repr)
    kept = U.allowed(pages, RULES)
    assert kept.columns == pages.columns and kept.count() == sum(plain(u, RULES, "allow")[3] == "allow" for u in URLS)
    assert U.judged(pages.limit(0), RULES).count() == 0
    assert U.judged(pages, []).where("verdict = 'allow' and rule is null").count() == len(URLS)


def test_index_uses_the_rarest_literal():
    assert U.Rule("example.com/en/", "block").literals() == ["example", "com", "en"]
    assert U.Rule("net/e", "block").literals() == ["net"]
    assert U.Rule("*ads.net/x*y/", "block").literals() == ["net"]
    with pytest.raises(ValueError):
        U.judged(None, [U.Rule("a/", "allow"), U.Rule("a/", "block")])
