"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: tags, with the containers they stand in, and text blocks. A token's
occurrence vector says how often it stands in each page of its host. Tokens that share a
vector are an equivalence class; classes that stand on ``SUPPORT`` of the host's different pages, keep
one order and nest without crossing make up the host's template. Zeros in a vector are allowed, so an
error page or one of another layout leaves the template as it is; null and blank pages are not
counted, and copies of a page count once. What the template does not fix are its slots, and a
container's varying text is what stands in its slots.

The article is the slot that holds the host's varying text: the article or main elements of the template, if half of
the varying text is theirs; else the innermost container of the template that is reached from the
page by going, each time, into one that has ``MOST`` of the varying text around it, unless more than
``STRAY`` of that text is in no container of the template (so a headline beside the container of the
paragraphs keeps them together). Menus, footers and notices stand outside of it, whatever their names. Where the template has no such container, and
on a page that lacks it, the page's own text is weighed the same way; where that finds none
either, the page is taken without the texts that its template fixes. Within the article nothing is left
out because other pages share it. Names only settle ties: elements that are no article (aside,
form, ...) and containers named as adverts, comments and the like are not weighed and not taken; names
that an article may use for its own parts (share, related, notice, ...) count only outside of an article element.

Vectors are never laid out: each task adds up a 128-bit sum over its pages for every token of a host,
and equal sums are equal vectors. So a host with a third of all pages costs one row a token and
task. Pages themselves are not shuffled. A host of one page has no template beyond that page.

Defined results: null or empty html gives empty text; an article element without text counts as none;
unclosed elements end with the page, or with their container; a null url, or one without a
host, belongs to a host of that name; equal rows get equal results; where containers tie, the first in
order of their hash is taken; a very long page is read whole in time in proportion to it; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_in_parts, materialise

#: Share of a host's different pages that a token of its template stands on.
SUPPORT = 0.8
#: Share of the varying text around it that a container needs to be gone into.
MOST = 0.8
#: Share of the varying text of a container that may be in none of its containers when one of them is gone into.
STRAY = 0.02
#: Up to so many different pages that have copies are broadcast.
MAX_COPIED = 100_000
#: So many hosts' numbers of pages, and about so many tokens of templates, are broadcast at a time.
MAX_BROADCAST = 20_000
MAX_TOKENS = 500_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|object|math|canvas|audio|video)\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that start a block, and those that are no article.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav ol section table ul".split())
_FURNITURE = frozenset("aside dialog footer form head menu nav button".split())
_ARTICLE = frozenset("article main".split())
#: Names of containers that are no article anywhere, and those that are none outside of an article.
_NEVER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|comments?|complementary|contentinfo|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|popup|sidebar|sponsor\w*|subscribe|subscription)(?:$|[\s_-])",
    re.I,
)
_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:alert|banner|disclaimer|header|notice|notification|promo\w*|related|replies|respond|share|sharing|social|toolbar|warning|widget)(?:$|[\s_-])",
    re.I,
)
TAG, TEXT, CONTAINER, ARTICLE = range(4)


class Page(NamedTuple):
    """Tokens of a page, in order; the first is the page itself, a container of the empty path."""

    keys: list[str]
    kinds: list[int]
    #: The path of the container that a token stands in.
    paths: list[str]
    #: A block's text; empty for other tokens and for furniture.
    texts: list[str]
    #: Path of the container around each container.
    around: dict[str, str]


def read(page: str) -> Page:
    """The tokens of a page. A container's key is its path, a text block's is its path and text."""
    found = Page([""], [CONTAINER], [""], [""], {})
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, article, furniture
    path, article, furniture, parts = "", False, False, []
    lower = None

    def add(key, kind, text=""):
        found.keys.append(key)
        found.kinds.append(kind)
        found.paths.append(path)
        found.texts.append(text)

    def block():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                add(f"{path}#{text}", TEXT, "" if furniture else text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCKS and tag != "button":
            continue
        block()
        if m["end"]:
            add(f"{path}</{tag}>", TAG)
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                _, path, article, furniture = stack[-1] if stack else ("", "", False, False)
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m["attrs"])) if m["attrs"] else ""
        key = f"{tag}.{names}" if names else tag
        own = tag in _FURNITURE or (tag == "header" and not article)
        if tag not in _CONTAINERS and not own:
            add(f"{path}<{key}>", TAG)
            continue
        if names and tag not in ("html", "body", "main"):
            never = bool(_NEVER.search(names)) and (tag != "article" or "comment" in names.lower())
            own = own or never or (tag != "article" and not article and bool(_OUTSIDE.search(names)))
        if own and not furniture:
            lower = page.lower() if lower is None else lower
            own = lower.find(f"</{tag}", at) >= 0  # one that is never closed does not take the rest of the page
        inner = f"{path}/{key}"
        add(inner, ARTICLE if tag in _ARTICLE and not (own or furniture) else CONTAINER)
        found.around.setdefault(inner, path)
        path, article, furniture = inner, article or tag in _ARTICLE, furniture or own
        stack.append((tag, path, article, furniture))
    if at < len(page):
        parts.append(page[at:])
    block()
    return found


def _hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - 2**63


PAGE = _hash("")


def weights(page: Page, fixed=()) -> dict[str, int]:
    """Characters of text below each container path, without the text tokens in ``fixed`` (hashes)."""
    own: dict[str, int] = defaultdict(int)
    for key, kind, path, text in zip(page.keys, page.kinds, page.paths, page.texts):
        if kind == TEXT and text and not (fixed and _hash(key) in fixed):
            own[path] += len(text)
    total: dict[str, int] = defaultdict(int)
    for path, n in own.items():
        total[path] += n
        while path:
            path = page.around[path]
            total[path] += n
    return total


def valid_tokens(tokens: list[int], classes: dict[int, tuple[int, int]]) -> set[int]:
    """The tokens of a page that its host's template fixes: those in classes whose tokens keep their
    order on the page, each class within one slot of another or apart from it."""
    places = defaultdict(list)
    for i, t in enumerate(tokens):
        if t in classes:
            places[classes[t][0]].append((i, classes[t][1]))
    spans = []
    for c, found in places.items():
        ranks = [r for _, r in found]
        size = len(set(ranks))
        if all(r == ranks[i % size] for i, r in enumerate(ranks)) and ranks[:size] == sorted(ranks[:size]):
            for a in range(0, len(found), size):
                spans.append((found[a][0], found[min(a + size, len(found)) - 1][0], c))
    crossing = set()
    open_ones: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        while open_ones and open_ones[-1][1] < span[0]:
            open_ones.pop()
        if open_ones and span[1] > open_ones[-1][1]:
            crossing.add(span[2])
            continue
        open_ones.append(span)
    good = {c for _, _, c in spans} - crossing
    return {t for t in set(tokens) if t in classes and classes[t][0] in good}


def article_of(nodes: dict[int, tuple[int, int, int]], weight: dict[int, int]) -> set[int]:
    """The containers that are the article, none if no container is: ``nodes`` has (parent, kind, rank) of each."""
    total = weight.get(PAGE, 0)
    if total <= 0:
        return set()

    def below(node):
        while node != PAGE and node in nodes:
            node = nodes[node][0]
            if node in nodes and nodes[node][1] == ARTICLE:
                return True
        return False

    named = {n for n, (_, kind, _) in nodes.items() if kind == ARTICLE and not below(n)}
    if 2 * sum(weight.get(n, 0) for n in named) >= total:
        return named
    inner = defaultdict(list)
    for n, (parent, _, _) in nodes.items():
        if n != PAGE:
            inner[parent].append(n)
    now = PAGE
    while inner[now]:
        best = max(inner[now], key=lambda n: (weight.get(n, 0), -n))
        stray = weight[now] - sum(weight.get(n, 0) for n in inner[now])
        if weight.get(best, 0) < MOST * weight[now] or stray > STRAY * weight[now]:
            break
        now = best
    return {now} if nodes[now][2] else set()


def plan_of(tokens) -> tuple[dict[int, tuple[int, int]], set[int], set[int]]:
    """Of a host's template (token, class, rank, kind, parent, size, inner): classes, fixed text tokens, article."""
    classes = {t["token"]: (t["class"], t["rank"]) for t in tokens}
    fixed = {t["token"] for t in tokens if t["kind"] == TEXT}
    nodes = {t["token"]: (t["parent"], t["kind"], t["inner"]) for t in tokens if t["kind"] >= CONTAINER}
    weight = {t["token"]: t["size"] for t in tokens if t["kind"] >= CONTAINER}
    for t in tokens:
        if t["kind"] == TEXT:
            node = t["parent"]
            while node in weight:
                weight[node] -= t["size"]
                if node == PAGE:
                    break
                node = nodes[node][0]
    return classes, fixed, article_of(nodes, weight)


def _deep(path: str) -> int:
    """1 for a container that can be the article: not the page, html or body."""
    return int(path.rsplit("/", 1)[-1].split(".")[0] not in ("", "html", "body"))


NO_PLAN: tuple = ({}, set(), set())


def main_text(page: str | None, plan=NO_PLAN) -> str:
    """Blocks of the article, in page order; ``plan`` is ``plan_of`` the host's template."""
    if not page:
        return ""
    classes, fixed, article = plan
    tokens = read(page)
    hashes = [_hash(k) for k in tokens.keys] if classes else []
    valid = valid_tokens(hashes, classes) if classes else set()
    fixed = fixed & valid
    main = article if article and article <= valid else set()
    by_hash = main or {_hash(p) for p in own_article(tokens, fixed)}
    inside = {"": PAGE in by_hash}
    for path, around in tokens.around.items():  # a container comes after the one around it
        inside[path] = inside[around] or _hash(path) in by_hash
    blocks = []
    for i, text in enumerate(tokens.texts):
        if text and (inside[tokens.paths[i]] if by_hash else not (fixed and hashes[i] in fixed)):
            blocks.append(text)
    return "\n\n".join(blocks)


def own_article(tokens: Page, fixed: set[int] = frozenset()) -> set[str]:
    """Paths of the containers that are the article by this page's own text, none if no container is."""
    weight = weights(tokens, fixed) if fixed else weights(tokens)
    if not weight.get(""):
        weight = weights(tokens)
    kinds = {k: kind for k, kind in zip(tokens.keys, tokens.kinds) if kind >= CONTAINER}
    name = {_hash(p): p for p in kinds}
    nodes = {h: (_hash(tokens.around.get(p, "")), kinds[p], _deep(p)) for h, p in name.items()}
    return {name[h] for h in article_of(nodes, {_hash(p): n for p, n in weight.items()})}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _vectors(batches):
    """(host, token, kind, parent, inner, size, pages, v1, v2, at): sums over the pages of a batch."""
    mask = (1 << 64) - 1
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for name, page in zip(*(batch.column(i).to_pylist() for i in range(2))):
            tokens = read(page or "")
            weight = weights(tokens)
            seed = xxhash.xxh128_intdigest(page or "")
            counts: dict[str, list] = {}
            for i, k in enumerate(tokens.keys):
                if k in counts:
                    counts[k][0] += 1
                else:
                    counts[k] = [1, i]
            mixed = {n: xxhash.xxh128_intdigest(seed.to_bytes(16, "little") + n.to_bytes(4, "little")) for n in {c[0] for c in counts.values()}}
            for k, (n, i) in counts.items():
                v, kind = mixed[n], tokens.kinds[i]
                size = n * len(tokens.texts[i]) if kind == TEXT else weight.get(k, 0) if kind >= CONTAINER else 0
                row = sums.get((name, h := _hash(k)))
                if row is None:
                    sums[name, h] = [kind, _hash(tokens.paths[i]) if kind else 0, _deep(k) if kind >= CONTAINER else 0, size, 1, v & mask, v >> 64, i]
                else:
                    row[3] += size
                    row[4] += 1
                    row[5] = (row[5] + (v & mask)) & mask
                    row[6] = (row[6] + (v >> 64)) & mask
                    row[7] += i
        if sums:
            names, found = zip(*sums)
            kind, parent, inner, size, pages, a, b, at = zip(*sums.values())
            sign = lambda v: [x - (1 << 64) if x >> 63 else x for x in v]
            cols = [pa.array(names), *(pa.array(c, t) for c, t in ((found, pa.int64()), (kind, pa.int32()), (parent, pa.int64()), (inner, pa.int32()), (size, pa.int64()), (pages, pa.int64()), (sign(a), pa.int64()), (sign(b), pa.int64()), (at, pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "token", "kind", "parent", "inner", "size", "pages", "v1", "v2", "at"])


def _wrapping_sum(column: str) -> Column:
    """Sum modulo 2**64, exact for any number of rows: 32-bit halves are summed apart."""
    low = F.sum(F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.sum(F.shiftrightunsigned(F.col(column), 32))
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def different_pages(pages: DataFrame) -> DataFrame:
    """host, digest, html of each different page that is not blank; only pages that have copies are shuffled."""
    keyed = pages.where(F.col("html").rlike("\\S")).select("host", F.xxhash64("html").alias("digest"), "html")
    copied = materialise(keyed.groupBy("host", "digest").count().where("count > 1").select("host", "digest"), "copied")
    key = ["host", "digest"]
    if copied.limit(MAX_COPIED + 1).count() > MAX_COPIED:
        return keyed.groupBy(*key).agg(F.first("html").alias("html"))
    once = keyed.join(F.broadcast(copied), key, "left_anti").select(*key, "html")
    return once.unionByName(keyed.join(F.broadcast(copied), key, "left_semi").groupBy(*key).agg(F.first("html").alias("html")))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, tokens array<struct<token, class, rank, kind, parent, size, inner>>: the template of each host of two
    different pages or more.

    ``pages`` has host and html. The tokens of a class are ranked by their mean place.
    """
    different = different_pages(pages)
    schema = "host string, token long, kind int, parent long, inner int, size long, pages long, v1 long, v2 long, at long"
    sums = different.select("host", "html").mapInArrow(_vectors, schema)
    first = [F.max(c).alias(c) for c in ("kind", "parent", "inner")]
    sums = sums.groupBy("host", "token").agg(*first, F.sum("size").alias("size"), F.sum("pages").alias("pages"), _wrapping_sum("v1").alias("v1"), _wrapping_sum("v2").alias("v2"), F.sum("at").alias("at"))
    of_host = materialise(different.groupBy("host").agg(F.count("*").alias("host_pages")).where("host_pages > 1"), "host_pages")
    often = join_in_parts(sums, of_host, "host", MAX_BROADCAST, lambda df: df.where(F.col("pages") >= F.lit(support) * F.col("host_pages")))
    token = F.struct("at", "token", "kind", "parent", "size", "inner")
    classes = often.groupBy("host", "v1", "v2").agg(F.array_sort(F.collect_list(token)).alias("ts"))
    ranked = F.transform("ts", lambda t, i: F.struct(t["token"].alias("token"), F.xxhash64("v1", "v2").alias("class"), i.alias("rank"), t["kind"].alias("kind"), t["parent"].alias("parent"), t["size"].alias("size"), t["inner"].alias("inner")))
    return classes.groupBy("host").agg(F.flatten(F.collect_list(ranked)).alias("tokens"))


def _texts(batches):
    known: dict[str, tuple] = {}
    for batch in batches:
        ids, urls = batch.column(0), batch.column(1)
        out = []
        for name, page, tokens in zip(*(batch.column(i).to_pylist() if i < 4 else batch.column(i) for i in (2, 3, 4))):
            if name not in known:
                if len(known) > 1000:
                    known.clear()
                known[name] = plan_of(tokens.as_py()) if tokens.is_valid else NO_PLAN
            out.append(main_text(page, known[name]))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    keyed = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    known = materialise(templates(keyed.select("host", "html")), "templates")
    types = dict(pages.select("page_id", "url").dtypes)

    def texts(df):
        return df.select("page_id", "url", "host", "html", "tokens").mapInArrow(_texts, f"page_id {types['page_id']}, url {types['url']}, text string")

    size = known.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens")).first()
    hosts = max(1, size["n"] * MAX_TOKENS // max(1, size["tokens"] or 0))
    return join_in_parts(keyed, known, "host", hosts, texts, "left").withColumn("n_chars", F.char_length("text").cast("long"))
