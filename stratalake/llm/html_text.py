"""Main text of HTML pages, with boilerplate found by a host suffix array.

Each page is cut into blocks, and each block lies in a region: the nearest element around it with a class or id, or an article, menu, footer and the like. The token
streams of all pages of a host, articles included, form one sequence whose suffix array to a depth of DEPTH tokens shows the substrings that distinct pages share.

What repetition decides: a region of which at least REGION of the substrings stand in MANY pages of its host goes, inside marked articles (article, main, role=main) too;
a block that no mark settles goes if repeats cover it, and so does one inside an article whose class or id says a word (DOUBTFUL) that articles use for their own
parts too, or says it beside words of its own (PARTS). What marks decide: regions whose tag, role, class or id names a menu, header, footer, sidebar, notice,
advert, form or comments go though no other page has their words, what stands around a marked article goes, and a marked article stays
where repetition would leave nothing of it (a host of copies). Single passages that the pages of a host share inside an article's own region are content.

Suffixes are named by prefix doubling: the name of a position at depth 2d is made of two names at depth d, so equal names are suffixes with that many tokens
in common. Names are dealt to cells by host, those of hosts with many pages to several, and sorted there. A name found in MANY pages of one task is known to be repeated and only
its first MANY pages travel, so a hot host or line makes no hot cell. Names travel packed, in ROUNDS, so that the shuffled data of a round stays below the input; nothing of the pages is
written, each pass parses them anew.

Defined cases: a null or empty page has empty text; markup cut off at the end is dropped; a null url is a host of its own; two pages of a
host with the same text don't make each other boilerplate; what is surely article is compared with such text only; repeated rows are extracted alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import U64, bounded, mix64, table, text_slices, word_hashes, written

DEPTH = 8  # tokens that a repeated substring has at least; a power of two
COVER = 0.5  # share of a block's tokens that repeats must cover for it to go
REGION = 0.5  # share of a region's substrings, over all pages of its host, that must be repeated for it to go
MANY = 3  # pages that have a repeated substring of a region
ROUNDS = 2  # parts of the names that are shuffled one after the other
CHUNK = 1 << 20  # positions that a task packs at once
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark deletes a query's shuffle files when it ends; set while rounds are written

RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav aside footer form button select option datalist dialog menu audio video canvas head fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar "
    "sidebar aside footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup social share sharing sharebar related recommended recommendations comment comments commentlist discussion disqus "
    "respond replies pagination pager toolbar widget widgets skip legal copyright hidden".split()
)
#: Words that name boilerplate outside articles, but inside them may name an article's own parts: repetition decides there.
DOUBTFUL = frozenset("menu related recommended recommendations legal notice notices widget widgets promo promotion banner skip overlay copyright respond sponsor sponsored sponsors".split())
#: Words that say which part of a region an element is. A class or id inside an article names boilerplate outright only if nothing but these, digits and
#: MARKS are in it: "share-buttons" does, "share-price" leaves it to repetition.
PARTS = frozenset(
    "area author bar block body bottom box button buttons container content count date entry footer form grid group header icon icons inline inner item items left "
    "line link links list meta middle outer panel reply right row section slot text thread top unit wrap wrapper zone".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
REGIONS = frozenset("article main nav header footer aside form dialog menu".split())
SCOPES = frozenset("ul ol dl table select menu body article section div".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
MAIN = re.compile(r"role\s*=\s*[\"']?main")
SPLIT_MARK = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


SETTLED, DOUBT, BOILERPLATE = 0, 1, 2


def verdict(tag: str, attributes: str, in_article: bool) -> int:
    """What a region's tag and attributes say of it: BOILERPLATE, DOUBT or nothing (SETTLED)."""
    if tag in DROP or (tag == "header" and not in_article):
        return BOILERPLATE
    if not attributes or not attributes.strip():
        return SETTLED
    found = SETTLED
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return BOILERPLATE
        if name == "role" and value in ROLES:
            return BOILERPLATE
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for words in map(set, map(SPLIT_MARK.split, value.split())):
                marks = words & MARKS
                if marks and (not in_article or (not marks <= DOUBTFUL and all(w in MARKS or w in PARTS or w.isdigit() or not w for w in words))):
                    return BOILERPLATE
                found = DOUBT if marks else found
        if name in ("class", "id") and tag == "article" and {"comment", "comments", "ad", "promo"} & set(SPLIT_MARK.split(value)):
            return BOILERPLATE
        if name == "style" and "display:none" in value.replace(" ", ""):
            return BOILERPLATE
    return found


def region_of(tag: str, attributes: str) -> str:
    """The region that an element opens: its tag with the words of its class and id, digits left out; "" if it opens none."""
    if tag not in BLOCK or not attributes and tag not in REGIONS:
        return ""
    words = {w for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in SPLIT_MARK.split((a or b or c).lower()) if w and not w.isdigit()} if attributes else set()
    return ".".join([tag, *sorted(words)]) if words or tag in REGIONS else ""


def read(page: str) -> list[tuple[str, int, bool, str]]:
    """(text, verdict, whether inside a marked article, region) of the blocks in page order."""
    blocks: list[tuple[str, int, bool, str]] = []
    stack: list[tuple[str, int, bool, str]] = []  # tag, and from here on: verdict, in the article, region
    pieces: list[str] = []
    said, article, region = SETTLED, False, ""

    def flush():
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((text, said, article, region))

    def pop_to(n: int):
        nonlocal said, article, region
        del stack[n:]
        said, article, region = stack[-1][1:] if stack else (SETTLED, False, "")

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes, end = m.groups()
        if tag is None:
            text = m.group()
            if not text.startswith(("<!", "<?")) or text == "<":
                pieces.append(html.unescape(text) if "&" in text else text)
            continue
        if not end:
            break  # a tag cut off at the end
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    if stack[n][1] != (stack[n - 1][1] if n else SETTLED) or stack[n][2] != (stack[n - 1][2] if n else False):
                        flush()
                    pop_to(n)
                    break
            continue
        if tag in RAW:
            end = re.compile(r"</" + re.escape(tag) + r"\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br" or tag in ("td", "th"):
            pieces.append(" ")
        if tag in BLOCK:
            flush()
            # A block ends an open paragraph; a list item, cell or option ends the one before it.
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "p" or stack[n][0] in CLOSES.get(tag, ()):
                    pop_to(n)
                    break
                if stack[n][0] in SCOPES:
                    break
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        now = max(said, verdict(tag, attributes, article))
        now_article = article or (now != BOILERPLATE and (tag in ("article", "main") or (attributes != "" and MAIN.search(attributes) is not None)))
        if now != said or now_article != article:
            flush()
        if said != BOILERPLATE:
            region = region_of(tag, attributes) or ("main" if now_article != article else region)
        stack.append((tag, now, now_article, region))
        said, article = now, now_article
    flush()
    return blocks


def parse(page: str) -> tuple[list[str], list[str], list[str], list[bool]]:
    """(blocks of the marked article, unsettled blocks outside it, blocks of dropped regions, whether each block of the article is in doubt), in page
    order."""
    blocks = read(page)
    marked = [b for b in blocks if b[2] and b[1] != BOILERPLATE]
    loose = [b[0] for b in blocks if not b[2] and b[1] != BOILERPLATE]
    return [b[0] for b in marked], loose, [b[0] for b in blocks if b[1] == BOILERPLATE], [b[1] == DOUBT for b in marked]


def names_at_depth(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Names of the positions of one stream at the given depth, by doubling; of fewer tokens, none."""
    names, width = tokens, 1
    while width < depth:
        if len(names) <= width:
            return np.zeros(0, U64)
        names = mix64(names[:-width] * U64(0x9E3779B97F4A7C15) + names[width:] + U64(width))
        width *= 2
    return names


@lru_cache(1 << 16)
def region_id(region: str) -> int:
    return int.from_bytes(hashlib.blake2b(region.encode(), digest_size=8).digest(), "little", signed=True)


def suffixes(pages: list[list[tuple[str, int, bool, str]]], hosts: np.ndarray, parts: dict[int, int], cells: int, pairs: dict[tuple[int, str], int]) -> dict[str, np.ndarray]:
    """The suffixes of the pages of given hosts: of each position with DEPTH tokens, all of one region of what is surely article or all outside of that, its page, place in the page, cell, name, mark of the page's text (its last bit says whether
    an unsettled block may ask for it) and number of its host and region in `pairs`, to which new ones are added. Names of what is surely article differ from the same
    words elsewhere."""
    blocks = [(i, b) for i, p in enumerate(pages) for b in p]
    words, bounds = word_hashes(pa.array([b[0] for _, b in blocks], pa.string())) if blocks else (np.zeros(0, U64), np.zeros(1, np.int64))
    of_block = np.repeat(np.arange(len(blocks)), np.diff(bounds))
    page = np.array([i for i, _ in blocks], np.int64)[of_block]
    starts = np.searchsorted(page, np.arange(len(pages) + 1))
    place = np.arange(len(words)) - starts[page]
    mixed = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(words + place.astype(U64)), dtype=U64)])
    whole = mix64(mixed[starts[1:]] - mixed[starts[:-1]])
    names = names_at_depth(words)
    # A region of what is surely article is a run of its own, so that a short one isn't judged by the words beside it.
    kinds = [(i, b[3] if b[2] and b[1] == SETTLED else None) for i, b in blocks]
    run = np.cumsum([k != before for k, before in zip(kinds, [None, *kinds[:-1]], strict=True)])[of_block] if kinds else of_block
    at = np.flatnonzero(run[: len(names)] == run[DEPTH - 1 : DEPTH - 1 + len(names)])
    sure = np.array([k[1] is not None for k in kinds], bool)[of_block[at]]
    unsettled = np.array([any(b[1] == DOUBT and b[2] for b in p) or not any(b[2] and b[1] != BOILERPLATE for b in p) and any(b[1] != BOILERPLATE for b in p) for p in pages], bool)
    host = hosts.view(U64)[page[at]]
    names = mix64(names[at] ^ mix64(host + sure.astype(U64)))
    of_host = hosts.tolist()
    part = names % np.array([parts.get(h, 1) for h in of_host], U64)[page[at]]
    return {
        "page": page[at],
        "place": place[at],
        "cell": (mix64(host ^ mix64(part)) % U64(cells)).astype(np.int64),
        "name": names >> U64(24),
        "mark": ((whole & U64(0x7FFFFF)) << U64(1))[page[at]] | (~sure & unsettled[page[at]]),
        "pair": np.array([pairs.setdefault((of_host[i], b[3]), len(pairs)) for i, b in blocks], np.int64)[of_block[at]],
    }


def groups_of(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def pages_of_names(key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by name and page mark: where each name begins, how many rows it has, and the number of the row's mark among its name's."""
    first = groups_of(key)
    sizes = np.diff(np.append(first, len(key)))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    nth = np.cumsum(new)
    return first, sizes, nth - np.repeat(nth[first], sizes) + 1


def _packed(chunk: list[dict[str, np.ndarray]], pairs: dict[tuple[int, str], int]):
    """One row for each cell: names with page marks, region by region, and their weights; of names that MANY pages of the chunk have, MANY pages, whose weights are in `local`."""
    cell, name, mark, pair = (np.concatenate([x[k] for x in chunk]) for k in ("cell", "name", "mark", "pair"))
    if not len(name):
        return
    key = (cell.astype(U64) << U64(40)) | name
    order = np.argsort(key)
    key = key[order]
    # Most names stand alone; the rows of the others are sorted by page and region, too.
    sizes = np.diff(np.append(groups_of(key), len(key)))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    rows = order[several]
    order[several] = rows[np.lexsort((pair[rows], mark[rows], key[several]))]
    mark, pair = mark[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (pair[1:] != pair[:-1])]))
    weight = np.diff(np.append(first, len(key)))
    key, mark, pair = key[first], mark[first], pair[first]
    begin, sizes, nth = pages_of_names(key, mark >> U64(1))
    known = np.repeat(np.maximum.reduceat(nth, begin) >= MANY, sizes)
    new = np.ones(len(nth), bool)
    new[1:] = (nth[1:] != nth[:-1]) | (key[1:] != key[:-1])
    mark = np.where(known, mark | np.repeat(np.bitwise_or.reduceat(mark & U64(1), begin), sizes), mark)
    cell = (key >> U64(40)).astype(np.int64)
    order = np.argsort(cell * len(pairs) + pair, kind="stable")
    key, mark, pair, cell, weight, known = key[order], mark[order], pair[order], cell[order], weight[order], known[order]
    keep = ~known | (new & (nth <= MANY))[order]
    groups = groups_of(cell * len(pairs) + pair)
    local = np.add.reduceat(np.where(known, weight, 0), groups).astype(np.int32)
    lengths = np.add.reduceat(keep.astype(np.int32), groups, dtype=np.int32)
    entry, weight = ((key << U64(24)) | mark)[keep], np.where(known, 0, weight)[keep].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cells = cell[groups]
    cut = np.append(groups_of(cells), len(cells))
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    known_pairs = list(pairs)
    hosts = np.array([h for h, _ in known_pairs], np.int64)[pair[groups]]
    regions = np.array([region_id(r) for _, r in known_pairs], np.int64)[pair[groups]]
    by_group = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary())
    by_entry = lambda x: pa.array([x[ends[lo] : ends[hi]].tobytes() for lo, hi in spans], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(cells[cut[:-1]], pa.int64()), by_entry(entry), by_entry(weight), by_group(lengths), by_group(local), by_group(hosts), by_group(regions)],
        names=["cell", "entries", "weights", "lengths", "local", "hosts", "regions"],
    )


def _pack(batches, parts: dict[int, int], cells: int, turn: int):
    chunk, pairs, held = [], {}, 0
    for batch in batches:
        for part, texts in text_slices(batch, "html"):
            found = suffixes([read(t) for t in texts.to_pylist()], part.column("host").to_numpy(zero_copy_only=False), parts, cells, pairs)
            mine = np.flatnonzero(found["cell"] % ROUNDS == turn)
            chunk.append({k: found[k][mine] for k in ("cell", "name", "mark", "pair")})
            held += len(mine)
            if held >= CHUNK:
                yield from _packed(chunk, pairs)
                chunk, pairs, held = [], {}, 0
    if chunk:
        yield from _packed(chunk, pairs)


def _repeats(rows: pa.Table) -> pa.Table:
    """Of one cell: how many substrings of each region there are and how many are in MANY pages; and the names, in two pages at least, that unsettled blocks ask for."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows.column(name)])
    entry, weight, length, local, host, region = (joined(*x) for x in (("entries", U64), ("weights", np.int32), ("lengths", np.int32), ("local", np.int32), ("hosts", np.int64), ("regions", np.int64)))
    order = np.argsort(entry)
    key, mark = entry[order] >> U64(24), (entry[order] >> U64(1)) & U64(0x7FFFFF)
    begin, sizes, nth = pages_of_names(key, mark)
    pages = np.maximum.reduceat(nth, begin)
    many = np.zeros(len(entry), bool)
    many[order] = np.repeat(pages >= MANY, sizes)
    names = key[begin][(pages >= 2) & (np.bitwise_or.reduceat(entry[order] & U64(1), begin) > 0)].view(np.int64)
    group = np.repeat(np.arange(len(length)), length)
    total = local + np.bincount(group, weights=weight, minlength=len(length))
    repeated = local + np.bincount(group, weights=weight * many, minlength=len(length))
    _, some, pair = np.unique(mix64(host.view(U64) ^ mix64(region.view(U64))), return_index=True, return_inverse=True)
    none, sums = [None] * len(names), [np.bincount(pair, weights=x, minlength=len(some)).astype(np.int64) for x in (total, repeated)]
    columns = [host[some], region[some], *sums]
    return pa.table(
        [pa.array([rows.column("cell")[0].as_py()] * (len(some) + len(names)), pa.int64())]
        + [pa.concat_arrays([pa.array(x, pa.int64()), pa.array(none, pa.int64())]) for x in columns]
        + [pa.concat_arrays([pa.array([None] * len(some), pa.int64()), pa.array(names, pa.int64())])],
        names=["cell", "host", "region", "total", "repeated", "name"],
    )


def _asked(batches, parts: dict[int, int], cells: int):
    """The names that unsettled blocks ask for, and their places in the page."""
    for batch in batches:
        for part, texts in text_slices(batch, "html"):
            found = suffixes([read(t) for t in texts.to_pylist()], part.column("host").to_numpy(zero_copy_only=False), parts, cells, {})
            mine = np.flatnonzero(found["mark"] & U64(1))
            take = pa.array(found["page"][mine])
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(take), part.column("row").take(take), pa.array(found["cell"][mine]), pa.array(found["name"][mine].view(np.int64)), pa.array(found["place"][mine].astype(np.int32))],
                names=["key", "row", "cell", "name", "place"],
            )


def settle(blocks: list[tuple[str, int, bool, str]], gone: set[int], places: list[int]) -> str:
    """Joins the blocks of the main text: without regions that the host repeats, and without unsettled blocks that repeats, beginning at the given tokens, cover."""
    sizes = [b[0].count(" ") + 1 for b in blocks]
    covered = np.zeros(sum(sizes) + DEPTH, bool)
    for p in places:
        covered[p : p + DEPTH] = True
    article = any(b[2] and b[1] != BOILERPLATE for b in blocks)
    # Where repetition would take all that is surely article, it can't tell it from the rest, and marks decide.
    telling = gone and any(b[2] and b[1] == SETTLED and region_id(b[3]) not in gone for b in blocks)
    kept, at = [], 0
    for (block, said, inside, region), size in zip(blocks, sizes, strict=True):
        if said != BOILERPLATE and inside == article:
            if said == SETTLED and article:
                goes = telling and region_id(region) in gone
            else:
                goes = covered[at : at + size].sum() >= COVER * size
            if not goes:
                kept.append(block)
        at += size
    return "\n\n".join(kept)


def _settle_batches(batches):
    for batch in batches:
        for part, texts in text_slices(batch, "html"):
            got = [settle(read(t), set(g or []), p or []) for t, g, p in zip(texts.to_pylist(), *(part.column(c).to_pylist() for c in ("gone", "places")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(got, pa.string())], names=["page_id", "url", "text"])


def dealing(pages: DataFrame) -> tuple[dict[int, int], int]:
    """(over how many cells the names of a host with more than a cell's share of pages go, number of cells)."""
    sizes = pages.groupBy("host").count()
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    cells = max(16, min(rows // 64, 4096), rows // 4096)
    share = max(1, rows // cells)
    return {r[0]: -(-r[1] // share) for r in sizes.where(F.col("count") > share).collect()}, cells


def repeats(pages: DataFrame, parts: dict[int, int], cells: int) -> list[DataFrame]:
    """For each round, of the pages' (host, html) suffixes: substrings of each region (host, region, total, repeated), and names (cell, name) that unsettled blocks ask for."""
    spark, found = pages.sparkSession, []
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        for turn in range(ROUNDS):
            packed = pages.select("host", "html").mapInArrow(partial(_pack, parts=parts, cells=cells, turn=turn), "cell long, entries binary, weights binary, lengths binary, local binary, hosts binary, regions binary")
            found.append(written(packed.groupBy("cell").applyInArrow(_repeats, "cell long, host long, region long, total long, repeated long, name long"), f"repeats{turn}"))
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html)."""
    page_type = pages.schema["page_id"].dataType.simpleString()
    pages = pages.select("page_id", "url", "html", F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))).alias("host"))
    parts, cells = dealing(pages)
    first, *others = repeats(pages, parts, cells)
    for other in others:
        first = first.unionByName(other)
    regions = first.where("region is not null").groupBy("host", "region").agg(F.sum("total").alias("total"), F.sum("repeated").alias("repeated"))
    gone = written(regions.where(F.col("repeated") >= REGION * F.col("total")).groupBy("host").agg(F.collect_list("region").alias("gone")), "gone")
    asked = first.where("name is not null").select("cell", "name")
    out = pages.join(gone, "host", "left")
    if asked.isEmpty():
        out = out.withColumn("places", F.lit(None).cast("array<int>"))
    else:
        keyed = lambda df: df.withColumns({"key": F.xxhash64("html"), "row": F.xxhash64("page_id", "url", "html")})
        own = keyed(pages).select("key", "row", "host", "html").mapInArrow(partial(_asked, parts=parts, cells=cells), "key long, row long, cell long, name long, place int")
        # Only the names of unsettled blocks meet the repeats; the places of one page are no more than its tokens.
        places = written(own.join(asked, ["cell", "name"]).groupBy("key", "row").agg(F.collect_set("place").alias("places")), "places")
        out = keyed(out).join(places, ["key", "row"], "left")
    return out.select("page_id", "url", "html", "gone", "places").mapInArrow(_settle_batches, f"page_id {page_type}, url string, text string")


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
