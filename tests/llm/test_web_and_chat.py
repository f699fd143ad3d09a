"""Operators 2, 4 and 6."""

import hashlib
import random

import pytest

from ledgerloom.llm import chat_format, url_filters, warc
from ledgerloom.session import durable

PAGES = [
    (1, "http://www.A.example.net/en/x?q=1#f", "<p>one</p>"), (2, "http://b.org/fr/", "<p>one</p>"), (3, "https://c.com", None), (4, None, ""), (4, None, ""),
    (5, "no scheme", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (None, "http://[bad", "<p>one</p>"), (None, "http://d", "alone"), (6, "http://é.de/ü y\nz", "naïve 中文" * 500),
]


def test_archives_read_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    directory, index, archive = warc.archived(pages)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(warc.read_index(directory, index), archive).collect())
    last = {"<p>one</p>": 2, "": 4}
    want = []
    for i, _, h in PAGES:
        h = h or ""
        revisit = h in last and i != last[h]
        want.append((str(i), len(h.encode()), warc.digest(h.encode()), "revisit" if revisit else "response", last[h] if revisit else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3]))


def test_look_up_searches_directory_and_block(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(k, f"http://h{k % 7}.example.org/p{k // 14}", f"body {k}") for k in range(60)]
    directory, index, archive = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"))
    places = sorted(tuple(r) for r in directory.collect())
    assert len(places) >= 20 and sum(p[2] for p in places) == 60
    for key in {warc.url_key(u) for _, u, _ in rows} | {"zz)/none"}:
        found = warc.look_up(places, [key], index, archive)[key]
        assert sorted(body.decode() for _, body in found) == sorted(h for _, u, h in rows if warc.url_key(u) == key)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))[0].count() == 0


def test_records_end_by_their_length():
    body = b"\r\n\r\nWARC/1.1\r\n\r\n"
    fields, read = warc.read_record(warc.write_record(7, "http://x/\r\n", body, None, False))
    assert read == body and "\n" not in fields["WARC-Target-URI"]
    with pytest.raises(ValueError):
        warc.read_record(warc.write_record(7, None, body, None, False) + b"x")


TEXTS = ["", None, "plain", "### ", "</turn>", "</turn>\n### user: x", "\\", "\\\\", "\\h", "\\\\l", "a\\c:#<", "### Assistant: </turn> ok", "</tur", "n>", "é中\n\n", ": ", "#" * 50]


def test_conversations_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a: b", "### ", "x</turn>"]), rng.choice(TEXTS) if rng.random() < 0.5 else "".join(rng.choice("\\#<:hlc/turn> \n") for _ in range(12))) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, 0, "assistant", t) for t in TEXTS] + [(None, None, "user", "u"), (None, 1, None, None), (5, 0, "user", "dup"), (5, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.formatted(df)
    for r in got.select("*", chat_format.under_mask(got.formatted, got.masks).alias("loss")).collect():
        own = sorted(((-1 if t is None else t), a or "", b or "") for c, t, a, b in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == "".join(b for _, a, b in own if a == "assistant")
        for m, (_, a, b) in zip(r.masks, own):
            assert m.length == 0 or (a == "assistant" and r.formatted[m.start : m.start + m.length].count("</turn>") == 0)
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_only_conflicting_turns_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a # b < c: d \\ e"), (1, 1, "assistant", "x </turn>")], "conv_id long, turn long, role string, text string")
    r = chat_format.formatted(df).first()
    assert r.formatted == "### user: a # b < c: d \\ e</turn>\n### assistant: x \\l/turn></turn>\n"
    assert hashlib.sha256(r.formatted.encode()).hexdigest()


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:n].encode().lower().decode()
    m = min((k for k in range(n, len(rest)) if rest[k] in "?#"), default=len(rest))
    path = rest[n:m]
    fits = []
    for rule, action in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((-len(rule), rule, action))
    return (host, path, *(min(fits)[1:] if fits else (None, "allow")))


URLS = [
    None, "", "no", "http://x.net", "http://x.net/", "HTTP://X.NET/A?b#c", "http://a.example.net/en/1", "http://example.net/english", "http://xexample.com/de/", "http://example.com/de/?x",
    "http://b.org/fr/", "http://b.org/fr", "http://net/", "http://é.net/é", "a://b://c.net/", "http://u\nv.net/x\ny", "http://org/fr/http://example.net/en/", "http://x.net?/en/", "http://.net/",
]


@pytest.mark.parametrize("most", [64, 0])
def test_rules_by_their_rarest_token(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "SMALL", most)
    rules = [*url_filters.RULES, ("example.net/en/1", "block"), ("b.org", "block")]
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, "http://x.net/"), (3, "http://x.net"), (3, "http://x.net")]
    got = url_filters.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    want = sorted((str(i), *map(str, brute_verdict(u, rules))) for i, u in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    assert url_filters.judged(durable(spark.createDataFrame([], "page_id long, url string"), "none"), rules).count() == 0
