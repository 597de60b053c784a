import base64
import hashlib
import itertools
import random
from collections import defaultdict

from tidemark.llm.common import fresh_path, materialize
from tidemark.llm.html_extract import blocks_of, edges_of, extract_pages, log_odds, main_text, minimum_cut
from tidemark.llm.warc import archive_round_trip, assemble, capture_records, parse_archive, read_archives, write_archives

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p><p>no";</script>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>Head&nbsp;line</h1></header>
<!-- ad > 3 --><p title="a > b">One&#32;&lt;two&gt;   three<b>!<p>Four<br>five.<div class="ad">Buy now, it is cheap.</div>
<table><tr><td>a<td>b<tr><td>c</table><p hidden>secret</p></article>
<section id="comments"><article><p>I liked this very much, thank you.</p></article></section></main>
<aside>Aside</aside><form><p>Join us</p><input></form><footer>&copy; 2024</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head line\n\nOne <two> three!\n\nFour five.\n\na b\n\nc"
    long = "A sentence of the text that goes on for a while and has no article around it. " * 3
    assert main_text(f"<div><a href=x>one</a> <a href=y>two</a></div><div>{long}</div>") == long.strip()
    for odd in ("", None, "<", "<p", "<!-- open", "<script>x", "<nav>only</nav>", "</p></div>", "<article></article>"):
        assert main_text(odd) == ""
    assert main_text("<article>a < b &unknown; &#x41;</article>") == "a < b &unknown; A"
    many = "".join(f"<p>Paragraph number {i}, with some words in it.</p>" for i in range(5000))
    assert main_text(f"<article>{many}</article>").count("\n\n") == 4999


ONE = "The first paragraph of the article says a good deal in one long sentence, as articles do."
TWO = "The second paragraph goes on in the same way, and it ends with a full stop as well."
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
WANT = f"{ONE}\n\n{TWO}"
MUCH = "".join(f"<p>Something else number {i} that has many words and reads like the text of an article.</p>" for i in range(40))


def test_wrappers_with_boilerplate_words():
    for page in (
        f'<div class="page has-sidebar">{BODY}</div>',
        f'<div id="search-main">{BODY}</div>',
        f'<div class="post comments"><article>{BODY}</article></div>',
        f'<div class="widget"><div class="content">{BODY}</div><div class="related">{MUCH}</div></div>'.replace(MUCH, "<p>Read this too</p>"),
        f'<form id="page"><nav><a href="/">Home page of this site with its eight or more words</a></nav>{BODY}</form>',
        f'<div class="no-sidebar banner-top"><p>Ours</p><div class="wrap subscribe">{BODY}</div></div>',
    ):
        assert main_text(page).endswith(WANT), page


def test_boilerplate_stays_boilerplate_inside():
    for extra in (
        '<div class="related"><article><h2>Another</h2><p>Another article that has a teaser of its own here.</p></article></div>',
        f'<div class="advert"><div class="content">{MUCH}</div></div>',
        f'<div class="post-comment-list"><div class="entry">{MUCH}</div></div>',
        f'<section id="comments"><article>{MUCH}</article></section>',
        f"<aside><main>{MUCH}</main></aside>",
        f'<form class="signup"><h1>Join</h1>{MUCH}</form>',
        '<b style="display: none">hidden text that nobody sees on the page at all</b>',
        '<span hidden>a <span>nested</span> and hidden text that nobody sees</span>',
        '<em aria-hidden="true">also hidden, with <i>more</i> in it</em>',
    ):
        assert main_text(f"<article>{BODY}{extra}</article>") == WANT, extra
        assert main_text(f"<article>{BODY}</article>{extra}") == WANT, extra
    assert main_text(f"<p>{ONE} <b hidden>never closed</p><p>{TWO}</p>").startswith(ONE)


def test_whole_pages_are_cut_at_least_cost():
    rng = random.Random(8)
    tags = ['<div class="ad">', '<div class="content">', "<article>", "<div>", "<aside>", '<div class="related">', "<section>"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 9)):
            tag = rng.choice(tags)
            words = " ".join(["word"] * rng.randint(1, 30)) + rng.choice([".", ""])
            body = f"<p>{words}</p>" if rng.random() < 0.7 else f'<p><a href="/">{words}</a></p>'
            parts.append(f"{tag}{body}</{tag[1:].split(' ')[0].rstrip('>')}>")
        page = "".join(parts)
        blocks = blocks_of(page)
        odds, edges = [log_odds(b) for b in blocks], edges_of(blocks)

        def cost(keep, odds=odds, edges=edges):
            own = sum(max(z, 0) if not k else max(-z, 0) for z, k in zip(odds, keep))
            return own + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(itertools.product([False, True], repeat=len(blocks)), key=cost)
        text = "\n\n".join(b.text for b, k in zip(blocks, minimum_cut(odds, edges)) if k)
        assert main_text(page) == text and abs(cost(minimum_cut(odds, edges)) - cost(best)) < 1e-9


def test_long_page():
    page = f"<article>{'<div>' * 3000}<p>{'Many words here. ' * 100_000}</p>{'<span hidden>' * 2000}</article>"
    assert len(main_text(page)) == 1_699_999


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep, odds=odds, edges=edges):
            own = sum(max(z, 0) if not k else max(-z, 0) for z, k in zip(odds, keep))
            return own + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(odds, edges)) - best) < 1e-9


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x"), (2, None, "", "")]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out) == [(0, 0), (1, len(main_text(PAGE))), (1, len(main_text(PAGE))), (2, 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


PAGES = [
    (1, "http://a/1 x\r\ny", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "u", None), (7, "u", ""),
    (8, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx" * 50), (9, "u", "z" * 300000), (5, "http://a/5", "same"),
    (None, "n", "alone"), (None, "n", "same"),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    out = archive_round_trip(df).collect()
    groups = defaultdict(list)
    for page_id, _, html in PAGES:
        groups[base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()].append((page_id, len((html or "").encode())))
    assert len(out) == len(PAGES)
    responses = defaultdict(int)
    for r in out:
        ids = [i for i, _ in groups[r["payload_digest"]]]
        assert r["page_id"] in ids and r["payload_bytes"] == groups[r["payload_digest"]][0][1]
        owner = max((i for i in ids if i is not None), default=None)
        if r["record_type"] == "response":
            responses[r["payload_digest"]] += 1
            assert r["page_id"] == owner and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == owner
    assert set(responses.values()) == {1} and len(responses) == len(groups)
    assert archive_round_trip(df.limit(0)).collect() == []


def test_warc_payloads_and_assembly(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    write_archives(capture_records(df), path)
    read = read_archives(spark, path)
    assert sorted(bytes(r["payload"]) for r in read.where("warc_type = 'response'").collect()) == sorted(
        {(h or "").encode() for _, _, h in PAGES}
    )
    small = capture_records(df, least_bytes=5)
    kinds = [r["value"].split("\r\n")[1] for r in small.collect()]
    assert kinds.count("WARC-Type: revisit") == 0

    def record(i, kind, *to):
        lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {i}"] + [f"WARC-Concurrent-To: {t}" for t in to]
        return "\r\n".join(lines) + "\r\nContent-Length: 0\r\n\r\n\r\n\r\n"

    # The response names its request; a metadata record names the request only.
    raw = record("r1", "response", "q1") + record("q1", "request") + record("m1", "metadata", "q1") + record("r2", "response")
    records = list(parse_archive(raw.encode()))
    from tidemark.llm.warc import RECORD_SCHEMA

    table = materialize(
        spark.createDataFrame([{**r, "fields": dict(r["fields"])} for r in records], RECORD_SCHEMA), "records"
    )
    got = {r["capture_id"]: r for r in assemble(table).collect()}
    assert [q["record_id"] for q in got["r1"]["requests"]] == ["q1"]
    assert [m["record_id"] for m in got["r1"]["metadata"]] == ["m1"]
    assert got["r2"]["requests"] == []
