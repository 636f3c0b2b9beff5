"""The main text of web pages: pages of a host are merged into a style tree, and branches of little importance go."""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import materialize

#: Importance below which what stands outside an article goes, and inside one; pages of a host that this takes, and the share
#: of them that must have what an article is to lose; the share of a branch's text above which all of it goes.
LOW, LOW_INSIDE, PAGES, PAGES_INSIDE, SHARE_INSIDE, BRANCH = 0.3, 0.05, 3, 5, 0.5, 0.7
#: A branch of at least so many links with this share of its text inside them is a menu.
LINKS, LINKED = 3, 0.8

# Elements and names that say by themselves what they hold.
NO_TEXT = frozenset("script style noscript template iframe object embed svg canvas audio video map applet head title textarea select option button input datalist meter progress xmp noembed noframes".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("head html title meta link script style base noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody tfoot thead caption tr ul hr".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
CELLS = frozenset("td th br".split())
SCOPES = frozenset("table ul ol dl div section article main body nav aside form".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promotion promotions nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs header masthead topbar "
    "footer bottombar sidebar sidebars aside rail cookie cookies consent gdpr privacy notice notices notification notifications alert alerts popup popups modal overlay dialog disclaimer comment comments reply replies respond discussion disqus share sharing social "
    "related recommended recommendations newsletter newsletters subscribe subscription signup login form forms search pagination pager copyright skip toolbar widgets paywall commentlist commentform commentbox adbox adslot adspace adunit topnav sidenav mainnav sidemenu cookiebar infobar".split()
)
HEADS = frozenset("header masthead banner".split())
CONTENT_WORDS = frozenset("article entry post story page content text title".split())
MODIFIERS = frozenset("has with no without is".split())

_TAG, _STOP, _COMMENT_END = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']"), re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS, _DIGITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str):
    """(kind, name, rest): text, start and end tags of any string, malformed markup included. Comments, declarations and what
    script-like elements hold are skipped; an unclosed one reaches to the end, as browsers have it."""
    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", "", page[at:]
            return
        if tag > at:
            yield "text", "", page[at:tag]
        mark = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            if page.startswith((">", "->"), tag + 4):
                at = page.find(">", tag + 4) + 1
            else:
                end = _COMMENT_END.search(page, tag + 4)
                at = end.end() if end else size
        elif mark in ("!", "?") or (mark == "/" and not _TAG.match(page, tag + 2)):
            at = (page.find(">", tag) + 1) or size
        elif name := _TAG.match(page, tag + 1 + (mark == "/")):
            end = _tag_end(page, name.end())
            lower = name[0].lower()
            yield ("end" if mark == "/" else "start"), lower, page[name.end() : end]
            at = end + 1
            if mark != "/" and lower in RAW:
                close = re.compile(rf"</{lower}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else size
        else:
            yield "text", "", "<"
            at = tag + 1


def _tag_end(page: str, at: int) -> int:
    """Where the tag closes; a quoted value may hold the mark that closes it."""
    end = page.find(">", at)
    if end >= 0 and page.find('"', at, end) < 0 and page.find("'", at, end) < 0:
        return end
    while stop := _STOP.search(page, at):
        if stop[0] == ">":
            return stop.start()
        opened = page[at : stop.start()].rstrip().endswith("=")
        close = page.find(stop[0], stop.end()) if opened else -1
        at = close + 1 if close >= 0 else stop.end()
    return len(page)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if "=" in rest or "hidden" in rest.lower() else {}


def _named_noise(names: str, in_article: bool) -> bool:
    """Whether a class or id names something other than the article. Each name is judged by its parts: the head of an article is its title, has-sidebar is no sidebar."""
    for name in names.split():
        parts = {x.lower() for x in _PARTS.findall(name)}
        noise = parts & NOISE_WORDS
        if noise <= HEADS and (in_article or parts & CONTENT_WORDS - {"page"}):
            noise = set()
        if noise and not parts & MODIFIERS:
            return True
    return False


def _key(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest()


def _number(key: bytes) -> int:
    return int.from_bytes(key, "little", signed=True)


@dataclass(slots=True)
class Open:
    """An element that is open: its place in the tree (inline ones stand at their block's), and what holds for all inside it."""

    name: str
    at: int
    block: bool = True
    noise: str = ""
    anchor: bool = False
    link: bool = False


@dataclass(slots=True)
class Element:
    """A block: where it stands, its path, how often each kind of child came, and the kinds of its children in turn."""

    parent: int
    key: bytes
    seen: dict = field(default_factory=dict)
    style: list = field(default_factory=list)
    runs: int = 0


@dataclass(slots=True)
class Run:
    """Text between two block boundaries."""

    at: int
    text: str
    noise: str
    anchor: bool
    linked: float
    links: int
    head: bool
    key: bytes = b""


def runs_of(page: str) -> tuple[list[Element], list[Run]]:
    """The blocks of a page as a tree, and its runs of text in page order, those of named noise marked as such."""
    tree, found = [Element(-1, b"")], []
    stack = [Open("", 0)]
    pieces: list[str] = []
    linked = links = 0
    in_head = False

    def flush() -> None:
        nonlocal linked, links
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        if text:
            place = len(stack) - 1
            while not stack[place].block:
                place -= 1
            top = stack[place]
            run = Run(top.at, text, top.noise, top.anchor, linked / sum(map(len, pieces)), links, any(x.name == "h1" for x in stack))
            if not top.noise:
                own = tree[top.at]
                own.style.append("#")
                run.key = _key(own.key, b"#", b"%d" % own.runs)
                own.runs += 1
            found.append(run)
        pieces.clear()
        linked = links = 0

    def close(place: int) -> None:
        for x in stack[place:]:
            if x.block:
                flush()
                break
        del stack[place:]

    for kind, name, rest in tokens(page):
        if kind == "text":
            top = stack[-1]
            if top.noise != "none":
                rest = entities.unescape(rest)
                pieces.append(rest)
                if top.link:
                    linked += len(rest)
        elif kind == "start":
            block = name in BLOCKS
            if in_head and name not in IN_HEAD:
                del stack[next((i for i, x in enumerate(stack) if x.name == "head"), len(stack)) :]
                in_head = False
            if block:
                flush()
                place = len(stack) - 1
                while not stack[place].block:
                    place -= 1
                if stack[place].name == "p":  # an open paragraph ends here
                    del stack[place:]
            if ends := CLOSES.get(name):
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].name in ends:
                        close(place)
                    elif stack[place].name in SCOPES:
                        break
            if name in CELLS:
                pieces.append(" ")
            if name in VOID:
                continue
            links += name == "a"
            in_head = in_head or name == "head"
            above = stack[-1]
            noise, at, inside = above.noise, above.at, above.anchor
            if noise != "none":
                values = _attributes(rest) if rest else {}
                role = values.get("role", "").lower() if values else ""
                main = name == "main" or role == "main"
                names = f"{values.get('class', '')} {values.get('id', '')}".strip() if values else ""
                if name in NO_TEXT or (values and ("hidden" in values or values.get("aria-hidden") == "true" or _HIDDEN.search(values.get("style", "")))):
                    noise = "none"
                elif main:
                    noise = ""
                elif not noise and name not in ("html", "body"):
                    if name == "form":
                        noise = "form"
                    elif name in NOISE_TAGS or role in NOISE_ROLES or (name == "header" and not inside) or (names and _named_noise(names, inside)):
                        noise = "named"
                if noise and not block and not above.noise:
                    noise = "none"
                anchor = not noise and (inside or main or name == "article" or (values.get("itemprop", "").lower() == "articlebody" if values else False))
                if block and not noise:
                    sign = f"{name}|{' '.join(sorted(_DIGITS.sub('0', names).split()))}" if names else name
                    own = tree[at]
                    turn = own.seen[sign] = own.seen.get(sign, 0) + 1
                    own.style.append(sign)
                    tree.append(Element(at, _key(own.key, sign.encode("utf-8", "surrogatepass"), b"%d" % turn)))
                    at = len(tree) - 1
            else:
                anchor = False
            stack.append(Open(name, at, block, noise, anchor, above.link or name == "a"))
            if rest.endswith("/") and name in ("svg", "template"):
                close(len(stack) - 1)
        elif name == "br":
            pieces.append(" ")
        elif name not in ("html", "body"):
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].name == name:
                    if name in BLOCKS or not any(x.block for x in stack[place + 1 :]):
                        close(place)
                    else:  # an inline element that was closed beyond a block that it holds
                        del stack[place]
                    break
                if name not in BLOCKS and name not in CELLS and stack[place].name in SCOPES:
                    break
    flush()
    return tree, found


def _chosen(found: list[Run], tree: list[Element]) -> list[Run]:
    """The runs that are no named noise: those of articles, if there are any, with a heading outside if the articles hold none; else all but menus."""
    kept = [r for r in found if not r.noise] or [r for r in found if r.noise == "form"]  # some sites wrap a page in a form
    if any(r.anchor for r in kept):
        headed = any(r.anchor and r.head for r in kept)
        return [r for r in kept if r.anchor or (r.head and not headed)]
    sums = [[0, 0.0, 0] for _ in tree]
    for r in kept:
        at = r.at
        while at >= 0:
            for i, x in enumerate((len(r.text), len(r.text) * r.linked, r.links)):
                sums[at][i] += x
            at = tree[at].parent
    menu = [n > 0 and links >= LINKS and linked >= LINKED * n for n, linked, links in sums]
    for at in range(1, len(tree)):
        menu[at] = menu[at] or menu[tree[at].parent]
    return [r for r in kept if not menu[r.at]]


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; the empty string where there is none."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _hash(*parts: str) -> bytes:
    return _key(*(p.encode("utf-8", "surrogatepass") for p in parts))


def read_page(page: str | None, url: str | None) -> tuple[int, int, list[int], list[int], list[str], list[list[int]]]:
    """Host, version, nodes, states, texts and branches of a page.

    Pages of a host with the same longest run are copies of one version. Nodes are those of the runs, whose ``texts`` stand in page
    order, then of the blocks outside articles that hold one, with the runs in their ``branches``. A node's last two bits say
    which: 0 a block, whose state is the kinds of its children, 1 a run outside an article, 2 one inside, whose states are their
    texts without numbers. A page without a host has texts only.
    """
    host = host_of(url)
    tree, found = runs_of(page or "")
    kept = _chosen(found, tree)
    texts = [r.text for r in kept]
    if not host or not kept:
        return 0, 0, [], [], texts, []
    site = host.encode("utf-8", "surrogatepass")
    number = lambda key, kind: (_number(_key(site, key)) & ~3) | kind
    nodes = [number(r.key, 2 if r.anchor else 1) for r in kept]
    states = [_number(_hash(_DIGITS.sub("0", t.lower()))) for t in texts]
    inside: dict[int, list[int]] = {}
    for i, r in enumerate(kept):
        at = -1 if r.anchor else r.at
        while at >= 0:
            inside.setdefault(at, []).append(i)
            at = tree[at].parent
    blocks = sorted(inside)
    nodes += [number(tree[at].key, 0) for at in blocks]
    states += [_number(_hash(*tree[at].style)) for at in blocks]
    return _number(_key(site)), _number(_hash(host, max(texts, key=len))), nodes, states, texts, [inside[at] for at in blocks]


def without(texts: list[str], branches: list[list[int]], low: list[int]) -> str:
    """The text of a page without what stands at the places ``low`` of its nodes: a run there goes; a block there goes as a whole
    if most of its text does."""
    runs = {i for i in low if i < len(texts)}
    gone = set(runs)
    for i in low:
        branch = branches[i - len(texts)] if i >= len(texts) else []
        size = sum(len(texts[j]) for j in branch)
        if size and sum(len(texts[j]) for j in branch if j in runs) >= BRANCH * size:
            gone |= set(branch)
    return "\n\n".join(t for i, t in enumerate(texts) if i not in gone)


def unimportant(nodes: DataFrame) -> DataFrame:
    """node, state: what the style trees of the hosts say is of little importance.

    ``nodes`` has a row (host, node, state) for each node of each version of a page. Of m versions with a node, k share a state.
    The importance of a block is the entropy of its states to base m: 0 if all pages lay it out alike, 1 if each does otherwise.
    The importance of a run is 1 - log k / log m, the same for its own text. Inside an article only what half of a host's pages
    have, and nearly all that have the place, is of little importance.
    """
    counts = materialize(nodes.groupBy("host", "node", "state").agg(F.count(F.lit(1)).alias("k")), "states")
    per = counts.groupBy("node").agg(F.sum("k").cast("double").alias("m"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("klogk"))
    pages = counts.where("node = host").select("host", F.col("k").alias("pages"))
    each = counts.where("k >= 2 AND node <> host").join(per.where(f"m >= {PAGES}"), "node").join(pages, "host")
    kind, log_m = F.col("node").bitwiseAND(3), F.log("m")
    own = 1 - F.log(F.col("k").cast("double")) / log_m
    low = F.when(kind == 0, (log_m - F.col("klogk") / F.col("m")) / log_m < LOW).when(kind == 1, own < LOW)
    low = low.otherwise((own <= LOW_INSIDE) & (F.col("pages") >= PAGES_INSIDE) & (F.col("k") >= SHARE_INSIDE * F.col("pages")))
    return each.where(low).select("node", "state")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Elements and names that say what they are (menus, heads, feet, sidebars, notices, adverts, forms, comments, hidden ones) go by
    that; where a page marks its article, the rest goes. The style tree then takes what it finds of little importance. It is
    never in one place: a node is a row of a count, and copies of a page count once. Pages without such nodes are not moved.

    Null and empty html give an empty text, malformed html is read as far as browsers would, html of any length is read whole; a
    null or odd url has no host, so nothing is taken for repeating; repeated rows come back each; of equal importance nothing
    depends on order; other columns are ignored; an empty table gives an empty one.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("row", F.unhex(F.md5(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own.columns)).cast("binary"))))
    numbers, lists = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))

    def read(batches):
        for b in batches:
            found = [read_page(h, u) for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True)]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), numbers, numbers, pa.list_(pa.string()), lists))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("row"), *columns], ["page_id", "url", "row", "host", "version", "nodes", "states", "texts", "branches"])

    kinds = [("row", "binary"), ("host", "bigint"), ("version", "bigint"), ("nodes", "array<bigint>"), ("states", "array<bigint>"), ("texts", "array<string>"), ("branches", "array<array<int>>")]
    fields = [own.schema["page_id"], own.schema["url"], *(T.StructField(c, T.StructType.fromDDL(f"x {k}")[0].dataType) for c, k in kinds)]
    trees = materialize(own.select("page_id", "url", "row", "html").mapInArrow(read, T.StructType(fields)), "trees")
    versions = trees.where(F.size("nodes") > 0).groupBy("host", "version").agg(F.min(F.struct("row", "nodes", "states")).alias("p"))
    site = F.array(F.struct(F.col("host").alias("nodes"), F.lit(0).cast("long").alias("states")))
    nodes = versions.select("host", F.explode(F.concat(site, F.arrays_zip(F.col("p.nodes").alias("nodes"), F.col("p.states").alias("states")))).alias("x"))
    low = materialize(unimportant(nodes.select("host", F.col("x.nodes").alias("node"), F.col("x.states").alias("state"))), "low")
    places = trees.select("row", F.posexplode(F.arrays_zip("nodes", "states")).alias("place", "x")).select("row", "place", F.col("x.nodes").alias("node"), F.col("x.states").alias("state"))
    cuts = materialize(places.join(low, ["node", "state"]).groupBy("row").agg(F.collect_set("place").alias("low")), "cuts")

    def write(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("texts", "branches", "low")), strict=True)
            texts = [without(t, branches, low or []) for t, branches, low in rows]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, "string"), pa.array([len(t) for t in texts], "int64")], ["page_id", "url", "text", "n_chars"])

    whole = trees.join(cuts, "row", "left").select("page_id", "url", "texts", "branches", "low")
    return whole.mapInArrow(write, T.StructType([*fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op12_style_tree_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op12_style_tree_text": op12_style_tree_text}
SQL: dict[str, str] = {}
