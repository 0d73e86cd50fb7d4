import html
import random

import pytest
from llm_data import prose

from stratalake.llm import html_text as H


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple\n text", ["plain & simple text"]),
        ("<html><head><title>t</title></head><body><nav>n</nav><article><h1>T</h1><p>One<br>two <b>bo</b>ld<p>Three</article><footer>f</footer></body></html>", ["T", "One two bold", "Three"]),
        ("<article><p>a &lt;b&gt; &eacute;&#233;&#xe9; &nbsp; x &amp y</p></article>", ["a <b> ééé x & y"]),
        ("<article><p>kept</p><div class='comments'><p>no</p></div><aside>no</aside><form>no<input></form><p>end</p></article>", ["kept", "end"]),
        ("<body><div id=cookie-notice>no</div><div class='ad'>no</div><main><header><h1>yes</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main></body>", ["yes", "a", "b", "c d"]),
        ("<article><script>var t='</p><p>x';</script><style>p{}</style><p>y<!-- <p>z --></p></article>", ["y"]),
        ("<article><p>cut off &am", ["cut off &am"]),
        ("<article><p>cut off</p><p clas", ["cut off"]),
        ("<article><p>1 < 2 and 3 > 2</p></article>", ["1 < 2 and 3 > 2"]),
        ("<article><section><p>a</section></div></p>b</article>after", ["a", "b"]),
        ("<ARTICLE><P hidden>no</P><P style='display: none'>no</P><P>yes</P></ARTICLE>", ["yes"]),
        ("<div role='navigation'>no</div><div role=main>yes<div role=search>no</div></div>", ["yes"]),
        ("<article><p>let <math><mi>x</mi> = 1</math> be</p></article>", ["let x = 1 be"]),
        ('<article><p>a</p><section class="related work"><p>b</p></section><p class="legal">c</p></article>', ["a", "b", "c"]),
        ('<article><p title="a>b</p><p>c</p></article>', ["b", "c"]),
        ("<article><div class='ad related'>no</div><p>yes</p></article>", ["yes"]),
        ('<article><ul class="menu"><li>soup<li>bread</ul><p id="share-price">up</p><div class="social-history">old</div><h2 class="comment-title">On a comment</h2></article>', ["soup", "bread", "up", "old", "On a comment"]),
        ('<article><p>a</p><div class="share-buttons">no</div><div id="comment-12">no</div><div class="post ad-slot-3">no</div><div class="comments-area"><h2 class="comment-title">no</h2></div></article>', ["a"]),
        ('<article><p>a</p><object data="x.svg"><p>b</p></object></article>', ["a", "b"]),
        ('<div class="share-price">no</div><article>yes</article>', ["yes"]),
        ("<article class=comment>no</article><article>yes</article>", ["yes"]),
    ],
)
def test_parse(page, want):
    marked, loose, *_ = H.parse(page)
    assert (marked or loose) == want


def pages(spark):
    menu = "Home News Sport Weather Business Technology Travel Culture Contact About"
    rows = [(i, "http://Host.example/x%d" % i, f"<body><div>{menu}</div><div>{prose(i, 40)}</div><div>all rights reserved by the people who wrote these many pages here</div></body>", 1, "x") for i in range(6)]
    rows += [(100, "http://host.example/a", f"<body><div>{menu}</div><article><p>{menu}</p><p>{prose(1, 40)}</p></article></body>", 1, "x"), (101, "http://other.example/", f"<body><div>{menu}</div><div>{prose(70, 20)}</div></body>", 1, "x"), (102, None, None, 1, "x"), (103, "http://z/", "", 1, "x"), (104, "http://twin/1", f"<p>{prose(80, 60)}</p>", 1, "x"), (105, "http://twin/2", f"<p>{prose(80, 60)}</p>", 1, "x"), (105, "http://twin/2", f"<p>{prose(80, 60)}</p>", 1, "x"), (106, "http://long/", "<article>" + "".join(f"<p>{prose(k, 50)}</p>" for k in range(2000)) + "</article>", 1, "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, uid long, host string")


def test_extract(spark, folder):
    rows, df = pages(spark)
    out = H.query(spark, folder(pages=df)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    squash = lambda x: " ".join(x.split())
    assert all(got[i] == squash(prose(i, 40)) for i in range(6))
    assert got[100].startswith("Home News") and got[100].count("\n\n") == 1
    assert got[101].startswith("Home News") and got[102] == got[103] == ""
    assert got[104] == got[105] == squash(prose(80, 60))
    assert got[106].count("\n\n") == 1999


def test_repeats_decide_what_is_in_doubt_inside_articles(spark, folder):
    note = "sign up here to read all of these pages before any one else can do so"
    page = lambda i: f"<article><p>{prose(i, 30)}</p><div class=promo>{note}</div><div class='related work'>{prose(900 + i, 30)}</div><div class='share-story'>{note}</div><p>{note}</p></article>"
    rows = [(i, f"http://host/{i}", page(i)) for i in range(5)] + [(9, "http://other/", page(9))]
    got = {r.page_id: r.text.split("\n\n") for r in H.query(spark, folder(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    squash = lambda x: " ".join(x.split())
    for i in range(5):
        assert got[i] == [squash(prose(i, 30)), squash(prose(900 + i, 30)), note]  # what is surely article stays, though it is repeated
    assert len(got[9]) == 5


def test_repeats_equal_brute_force(spark, folder):
    rng = random.Random(8)
    lines = [prose(3000 + k, rng.randint(4, 14)) for k in range(12)]
    rows = [(i, f"http://h{i % 2}/{i}", "".join(f"<div>{b}</div>" for b in [*rng.sample(lines, 3), prose(i, 20), *rng.sample(lines, 2)])) for i in range(16)]
    blocks = {i: H.parse(h)[1] for i, _, h in rows}
    streams = {i: " ".join(b).lower().split() for i, b in blocks.items()}
    want = {}
    for i in streams:
        others = {tuple(s[k : k + 8]) for j, s in streams.items() if j != i and j % 2 == i % 2 for k in range(len(s) - 7)}
        covered = set()
        for k in range(len(streams[i]) - 7):
            covered |= set(range(k, k + 8)) if tuple(streams[i][k : k + 8]) in others else set()
        kept, at = [], 0
        for b in blocks[i]:
            n = len(b.split())
            kept += [b] if sum(x in covered for x in range(at, at + n)) < 0.5 * n else []
            at += n
        want[i] = "\n\n".join(kept)
    got = {r.page_id: r.text for r in H.query(spark, folder(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got == want and any(len(t.split("\n\n")) < 6 for t in got.values())


def test_empty(spark, folder):
    assert H.query(spark, folder(pages=pages(spark)[1].limit(0))).count() == 0


def test_names_are_windows():
    import numpy as np

    toks = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 4], np.uint64)
    names = H.names_at_depth(toks, 4)
    windows = [tuple(toks[i : i + 4]) for i in range(7)]
    assert all((names[i] == names[j]) == (windows[i] == windows[j]) for i in range(7) for j in range(7))
    assert html.unescape("&amp") == "&" and len(H.names_at_depth(toks[:3], 4)) == 0


def test_repeated_regions_go_inside_marked_articles(spark, folder):
    squash = lambda x: " ".join(x.split())
    call, card = "get every one of these stories in your letter box", prose(50, 20)
    page = lambda i: f"<article><p>{prose(i, 30)}</p><div class='cta-strip'>{call}</div><section id=part-{i}>{prose(700 + i, 30)}</section></article><article class=card>{card}</article>"
    rows = [(i, f"http://host/{i}", page(i)) for i in range(5)]
    rows += [(10 + i, f"http://two/{i}", page(10 + i)) for i in range(2)]  # too few pages to tell
    rows += [(20 + i, f"http://copies/{i}", f"<nav>{prose(60, 12)}</nav><main><p>{prose(61, 40)}</p></main><footer>{i} of these</footer>") for i in range(6)]  # nothing else would be left
    got = {r.page_id: r.text.split("\n\n") for r in H.query(spark, folder(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    for i in range(5):
        assert got[i] == [squash(prose(i, 30)), squash(prose(700 + i, 30))]
    assert all(len(got[10 + i]) == 4 for i in range(2))
    assert all(got[20 + i] == [squash(prose(61, 40))] for i in range(6))


@pytest.mark.parametrize("chunk", [1, 300, 1 << 20])
def test_region_shares_equal_brute_force(monkeypatch, chunk):
    from collections import Counter, defaultdict

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(H, "text_slices", lambda batch, column: ((batch.slice(i, 1), batch.column(column).slice(i, 1)) for i in range(batch.num_rows)))
    rng = random.Random(5)
    lines = [prose(4000 + k, rng.randint(9, 16)) for k in range(6)]
    html_of = lambda i: f"<nav>{rng.choice(lines)}</nav><article><p>{prose(i, 20)}</p><p>{rng.choice(lines)}</p><p class=by>{rng.choice(lines)}</p></article>" if i % 3 else "".join(f"<div class=c{k}>{rng.choice(lines)}</div>" for k in range(4))
    pages = [(i % 2 + 1, html_of(i)) for i in range(18)]
    pages += pages[:2] * 3  # copies count as one page, but weigh in the sums
    seen, asked = defaultdict(set), set()
    total, repeated = Counter(), Counter()
    windows = []
    for host, h in pages:
        tokens = [(w, said, inside, region) for text, said, inside, region in H.read(h) for w in text.lower().split()]
        text = tuple(t[0] for t in tokens)
        for k in range(len(tokens) - 7):
            _, said, inside, region = tokens[k]
            if len({t[3] if t[2] and t[1] == H.SETTLED else None for t in tokens[k : k + 8]}) > 1:
                continue
            windows.append((host, region, (host, inside and said == H.SETTLED, text[k : k + 8]), "<article" not in h))
            seen[windows[-1][2]].add(text)
    for host, region, name, ask in windows:
        total[host, H.region_id(region)] += 1
        repeated[host, H.region_id(region)] += len(seen[name]) >= H.MANY
        if ask and len(seen[name]) >= 2:
            asked.add(name)
    parts, cells = {1: 3}, 5
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pages], pa.int64()), pa.array([p[1] for p in pages])], names=["host", "html"])
    got_total, got_repeated, names = Counter(), Counter(), set()
    for turn in range(H.ROUNDS):
        packed = pa.Table.from_batches(H._pack([batch], parts, cells, turn))
        for cell in set(packed.column("cell").to_pylist()):
            assert cell % H.ROUNDS == turn
            for r in H._repeats(packed.filter(pa.array(np.array(packed.column("cell")) == cell))).to_pylist():
                if r["name"] is None:
                    got_total[r["host"], r["region"]] += r["total"]
                    got_repeated[r["host"], r["region"]] += r["repeated"]
                else:
                    names.add((r["cell"], r["name"]))
    assert got_total == total and got_repeated == repeated and any(0 < repeated[k] < total[k] for k in total)
    assert len(names) == len(asked) > 0
