"""Main text of a page by composite text density.

The page becomes a tree. Every node has its characters C, tags T (but marks inside a sentence, as bold type), characters
in links LC and tags of links LT, and the
link-adjusted characters per tag C/T * (1 - LC/C) * (1 - LT/(T+1)). (The published form takes logarithms of these ratios
to a base that falls to 1 where a page has few links, so small blocks would outgrow all others there; shares don't.) A
block's sum is that of the densities of its child blocks and of its own text. The subtree with the largest sum is the
content. On the way from it up to the body, the largest density so far (at first that of its typical child), times SLACK,
is the level's threshold: a child
beside the way is content if its density reaches the threshold (and its sum the WEIGHT) or its sum the SHARE of the largest. What stands between
content children stays, however short, and so do headings right before the first. Around them, low blocks go; in the
content subtree itself only generic ones that are unlike its dense leaves go.

What the result never holds is cut first: scripts, styles and other markup, form controls (with their labels and outputs,
and embedded objects, inside a sentence, too), and menus, sidebars, footers, notices, adverts and reader comments by tag,
role or name; blocks of nothing but links go, too. Names are also given to what encloses a page (`site nav-closed`): if
what names leave is next to nothing beside the largest sum, the named parts around that sum stay, the outermost first.
Where tag or name don't tell (forms, headers, widgets), density decides: one that encloses the content stays, and so does
a header inside it.

Text: character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined in
page order by one space. Defined cases: a null or empty page, or one without text, gives an empty text; unclosed tags end
where their parent or the next such block does; a tag without its end hides the rest, a comment or script without its
end, too, as in browsers; any depth and length is handled without recursion in time proportional to the page; repeated
rows repeat; other columns are not read.
"""

from __future__ import annotations

import html as std
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A child is content from SLACK of the path's largest density on; a generic block beside the content subtree must also
#: have WEIGHT of the largest sum, or SHARE of it if it holds no block. SHARE of the largest sum alone is enough.
SLACK, WEIGHT, SHARE = 0.3, 0.1, 0.25
#: A named part that encloses the page's largest sum is kept if what names leave has less than this share of it; the
#: second is for reader comments, which often are longer than the article.
ENCLOSING, DISCUSSION = 0.15, 0.02

#: Elements of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noframes ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An opening tag ends an open one of these, up to the elements at which the search stops.
SAME = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
STOP_P = frozenset("html body article aside blockquote td th table button div section main li dd caption object".split())
#: Elements whose content is text for the parser alone; of the first, references are not decoded.
RAW = frozenset("script style xmp iframe noembed noframes noscript template title textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Marks inside a sentence: they are no tags for the densities.
PHRASING = frozenset("abbr b bdi bdo big br cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks that are parts of running text whatever their length.
TEXTUAL = HEADINGS | frozenset("p blockquote pre ul ol dl figure table address br hr".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed footer frame head iframe input label legend map menu nav noembed noframes noscript object option output script search select style svg template textarea title video xmp".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|adverts?|advertisements?|advertising|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|footer|masthead|"
    r"menu|nav|navbar|navigation|newsletter|subscribe|signup|pagination|pager|popup|modal|promo|promoted|sponsor|sponsored|related|recommended|recommendations|"
    r"share|sharing|social|sidebar|side-bar|skip-?link)(?:$|[\s_-])",
    re.IGNORECASE,
)
READERS = re.compile(r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:comments?(?!-(?:open|closed|on|off|enabled|disabled))|comment-?list|disqus|replies|respond)(?:$|[\s_-])", re.IGNORECASE)
#: Names that page builders also give to what encloses an article: density decides.
OPEN_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|login|overlay|toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)

_NAME = re.compile(r"[^\s/>]+")
_TURN = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_LONG = re.compile(r"&#0*[0-9]{8,};?")
TOLD = frozenset("class id role hidden".split())


class _Tree:
    """Nodes in page order; texts belong to the node they stand in."""

    def __init__(self, page: str):
        self.tag, self.parent, self.shape = ["#root"], [-1], [""]
        #: 1: cut; 2: cut unless density says otherwise; 3, 4: cut by role or name, or by a name of reader comments.
        self.cut = bytearray(1)
        #: (node, text), (node, None) where a block begins or ends.
        self.runs: list[tuple[int, str | None]] = []
        self.open = [0]
        #: Places in `open` of each tag's elements, and of all blocks.
        self.places: dict[str, list[int]] = {}
        self._read(page)

    def _read(self, s: str) -> None:
        """Tokens of the page; every step goes forward, so time is proportional to it."""
        at, n, last = 0, len(s), {c: s.rfind(c) for c in "\"'>"}
        quoted, text = True, 0
        while True:
            at = s.find("<", at)
            if at < 0 or at + 1 >= n:
                break
            c = s[at + 1]
            if c.isalpha() and c.isascii():
                self._text(s[text:at])
                name = _NAME.match(s, at + 1)
                k = name.end()
                while k <= last[">"]:  # to the end of the tag
                    m = _TURN.search(s, k)
                    if m is None:
                        k = n
                    elif m[1] is None:
                        k = m.end()
                        break
                    elif quoted and m.end() <= last[m[1]]:
                        k = s.find(m[1], m.end()) + 1
                    else:
                        k = m.end()
                else:
                    k = n + 1
                if k > n and quoted and last[">"] > name.end():
                    quoted, k = False, s.find(">", name.end()) + 1  # a quote without its end: from here on quotes don't count
                if k > n or (k == n and s[n - 1] != ">"):
                    return
                tag = name[0].lower()
                self._start(tag, s[name.end() : k - 1])
                at = text = k
                if tag in RAW:
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(s, at)
                    if end is None:
                        return
                    at = text = end.start()  # never part of a text
            elif c == "/" and at + 2 < n and s[at + 2].isalpha() and s[at + 2].isascii():
                self._text(s[text:at])
                k = s.find(">", at) if at < last[">"] else -1
                if k < 0:
                    return
                self._end(_NAME.match(s, at + 2)[0].lower())
                at = text = k + 1
            elif s.startswith("<!--", at):
                self._text(s[text:at])
                if s.startswith((">", "->"), at + 4):
                    at = text = s.index(">", at + 4) + 1
                    continue
                ends = [k for k in (s.find("-->", at + 4), s.find("--!>", at + 4)) if k >= 0] if last[">"] > at else []
                if not ends:
                    return
                at = text = s.index(">", min(ends)) + 1
            elif c in "!?/":
                self._text(s[text:at])
                k = s.find(">", at) if at < last[">"] else -1
                if k < 0:
                    return
                at = text = k + 1
            else:
                at += 1
        self._text(s[text:])

    def _text(self, s: str) -> None:
        if s:
            self.runs.append((self.open[-1], std.unescape(_LONG.sub("\N{REPLACEMENT CHARACTER}", s)) if "&" in s else s))

    def _start(self, tag: str, attrs: str) -> None:
        stack, places = self.open, self.places
        if tag in ("html", "body") and places.get(tag):
            return
        if tag in CLOSES_P:
            self._close(frozenset(["p"]), STOP_P)
        if tag in SAME:
            self._close(*SAME[tag])
        if tag == "a" and places.get("a") and places["a"][-1] > (places["#block"][-1] if places.get("#block") else 0):
            self._cut_off(places["a"][-1])
        n = len(self.tag)
        cut, shape = (1 if tag in NEVER else 2 if tag in ("form", "header") else 0), ""
        if attrs:
            told = {}
            for m in _ATTR.finditer(attrs):
                k = m[1].lower()
                if k in TOLD:
                    told.setdefault(k, m[2] or m[3] or m[4] or "")
            if told:
                shape = told.get("class", "")
                named = "" if tag in ("html", "body", "article", "main") else f"{shape} {told.get('id', '')}"
                if "hidden" in told:
                    cut = 1
                elif cut != 1 and READERS.search(named):
                    cut = 4
                elif cut != 1 and (told.get("role", "").strip().lower() in ROLES or NAMES.search(named)):
                    cut = 3
                elif not cut and OPEN_NAMES.search(named):
                    cut = 2
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.cut.append(cut)
        self.shape.append(shape)
        if tag in BLOCK:
            self.runs.append((n, None))
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                places.setdefault("#block", []).append(len(stack))
            stack.append(n)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        k = self._innermost(tag)
        if tag in BLOCK:
            self.runs.append((self.open[k], None))
        if k > 0:
            self._cut_off(k)

    def _innermost(self, tag: str) -> int:
        """Place of the tag's innermost open element, -1 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _cut_off(self, k: int) -> None:
        for i in self.open[k:]:
            self.places[self.tag[i]].pop()
            if self.tag[i] in BLOCK:
                self.places["#block"].pop()
        del self.open[k:]

    def _close(self, tags, stop) -> None:
        k = max(map(self._innermost, tags))
        if k > 0 and not any(self._innermost(t) > k for t in stop):
            self._cut_off(k)


def link_adjusted(c: int, t: int, lc: int, lt: int) -> float:
    """Density of c characters in t tags, lc of them in lt links."""
    return c / max(1, t) * (1 - lc / max(1, c)) * (1 - lt / (t + 1))


class Densities:
    """Of every node not cut: characters, links, density, sum, and whether it is a block or holds one."""

    def __init__(self, tree: _Tree, cut: list[bool]):
        n = len(tree.tag)
        self.cut = cut
        in_link = [False] * n
        for i in range(1, n):
            p = tree.parent[i]
            cut[i] = cut[i] or cut[p]
            in_link[i] = in_link[p] or tree.tag[i] == "a"
        c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
        for i, s in tree.runs:
            if s is not None and not cut[i]:
                k = len("".join(s.split()))
                c[i] += k
                if in_link[i]:
                    lc[i] += k
        block = [tag in BLOCK and tag != "br" for tag in tree.tag]
        #: Characters, tags and links of a block's own text, outside of its child blocks.
        oc, ot, olc, olt = c[:], [0] * n, lc[:], [0] * n
        leaf = [True] * n
        self.density, self.total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):  # parents come before their children
            if cut[i]:
                continue
            self.density[i] = link_adjusted(c[i], t[i], lc[i], lt[i]) if c[i] else 0.0
            if block[i] and oc[i]:
                self.total[i] += link_adjusted(oc[i], ot[i], olc[i], olt[i])
            if i:
                p, link = tree.parent[i], tree.tag[i] == "a"
                c[p] += c[i]
                lc[p] += lc[i]
                tag = tree.tag[i] not in PHRASING
                t[p] += t[i] + tag
                lt[p] += lt[i] + link
                if block[i]:
                    self.total[p] += self.density[i]
                    if c[i]:
                        block[p], leaf[p] = True, False
                else:
                    oc[p] += oc[i]
                    olc[p] += olc[i]
                    ot[p] += ot[i] + tag
                    olt[p] += olt[i] + link
        self.block, self.leaf, self.chars, self.own = block, leaf, c, oc
        #: Nothing but links, with a separator or so each.
        self.links = [lt[i] >= 3 and c[i] - lc[i] < 3 * lt[i] and 3 * lc[i] >= 2 * c[i] for i in range(n)]

    def typical(self, nodes: list[int]) -> float:
        """The density that a character of these blocks lies in on average."""
        live = [i for i in nodes if self.block[i] and not self.cut[i]]
        return sum(self.chars[i] * self.density[i] for i in live) / max(1, sum(self.chars[i] for i in live))

    def best(self) -> int:
        """The block with the largest sum, of equals the outermost; -1 without text."""
        live = [i for i in range(len(self.cut)) if self.block[i] and not self.cut[i] and self.chars[i]]
        return max(live, key=lambda i: (self.total[i], self.density[i], -i), default=0 if self.chars[0] else -1)


def _way(tree: _Tree, i: int) -> list[int]:
    """i and its ancestors."""
    out = [i]
    while i > 0:
        i = tree.parent[i]
        out.append(i)
    return out


def _named(tree: _Tree, hard: list[bool]) -> list[bool]:
    """hard without the parts that a name or role alone cuts and that enclose the article: from the outermost inwards on
    the way to the page's largest sum, as many as it takes until what is left has its share of that sum."""
    named = [h and c in (3, 4) for h, c in zip(hard, tree.cut, strict=True)]
    if not any(named):
        return hard
    d = Densities(tree, [h and not x for h, x in zip(hard, named, strict=True)])
    best = d.best()
    way = [i for i in _way(tree, best)[::-1] if named[i]] if best >= 0 else []
    if not way:
        return hard
    # A part of reader comments ends the way, unless nothing else is there.
    least = (DISCUSSION if any(tree.cut[i] == 4 for i in way) else ENCLOSING) * d.total[best]

    def without(k: int) -> list[bool]:
        kept = set(way[:k])
        return [h and i not in kept for i, h in enumerate(hard)]

    low, high = 0, len(way)
    while low < high:
        k = (low + high) // 2
        left = Densities(tree, without(k))
        top = left.best()
        if top >= 0 and left.total[top] >= least:
            high = k
        else:
            low = k + 1
    return without(low)


def select(tree: _Tree) -> list[bool]:
    """Whether each node's own text is content."""
    n = len(tree.tag)
    around = [False] * n  # what encloses a main element isn't a part beside the article, whatever its name
    for i in range(n - 1, 0, -1):
        around[tree.parent[i]] |= around[i] or tree.tag[i] == "main"
    hard = _named(tree, [tree.cut[i] in (1, 3, 4) and (not around[i] or tree.tag[i] in NEVER) for i in range(n)])
    d = Densities(tree, hard[:])
    best = d.best()
    if best >= 0 and any(tree.cut[i] == 2 for i in range(n)):
        way = set(_way(tree, best))
        under = [False] * n
        for i in range(n):
            under[i] = i == best or (i > 0 and under[tree.parent[i]])
        body = tree.tag[best] in ("body", "#root", "html")
        for i in range(n):
            if tree.cut[i] == 2 and i not in way and not (tree.tag[i] == "header" and under[i] and not body):
                hard[i] = True
        d = Densities(tree, hard[:])
        best = d.best()
    if best < 0:
        return [False] * n
    keep: list[bool | None] = [None] * n
    keep[0] = False
    children: dict[int, list[int]] = {}
    way = _way(tree, best)
    for i in way:
        children[i] = []
    for i in range(1, n):
        if tree.parent[i] in children:
            children[tree.parent[i]].append(i)
    top, came = d.typical(children[best]), -1
    for q in way:
        top = max(top, d.density[q])
        low, much = SLACK * top, SHARE * d.total[best]
        live = [x for x in children[q] if not d.cut[x] and d.chars[x]]
        weighty = lambda x: q == best or tree.tag[x] in TEXTUAL or d.total[x] >= (SHARE if d.leaf[x] else WEIGHT) * d.total[best]
        dense = {x for x in live if x == came or (not d.links[x] and d.block[x] and ((d.density[x] >= low and weighty(x)) or (q != best and d.total[x] >= much)))}
        keep[q] = q == best or (0 < d.own[q] and d.own[q] >= low)
        order = [k for k, x in enumerate(live) if x in dense]
        if order:
            first, end = order[0], order[-1]
            while first > 0 and tree.tag[live[first - 1]] in HEADINGS:
                first -= 1
            if tree.tag[q] not in ("body", "html", "#root"):
                first = next((k for k in range(first) if tree.tag[live[k]] in HEADINGS), first)
            shapes = {(tree.tag[x], tree.shape[x]) for x in dense if d.leaf[x]}
            for k, x in enumerate(live):
                if not d.block[x]:
                    if q != best and not first <= k <= end:
                        keep[x] = False
                elif x != came:
                    alike = q == best and (tree.tag[x] in TEXTUAL or (d.leaf[x] and (tree.tag[x], tree.shape[x]) in shapes))
                    keep[x] = not d.links[x] and (first <= k <= end or alike)
        came = q
    for i in range(1, n):
        if d.cut[i] or (d.links[i] and d.block[i]):
            keep[i] = False
        elif keep[i] is None:
            keep[i] = keep[tree.parent[i]]
    return keep


def extract(page: str | None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    tree = _Tree(page)
    keep = select(tree)
    parts = []
    for i, s in tree.runs:
        if s is None:
            parts.append(" ")
        elif keep[i]:
            parts.append(s)
    return " ".join("".join(parts).split())


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [extract(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})
