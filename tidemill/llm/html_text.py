"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path; container elements of
different classes make different paths. For each path the text lengths and the punctuation of its
blocks are summed and divided by their number; along the page both ratios are smoothed by a small
Gaussian window and fused by their product. Paths whose mean fused ratio passes a share of the
deviation over the page are content, and along the tree of paths the parts of what holds most of
the content are too. The text is the blocks of these paths.

What element, role and class say enters the fusion: paths of menus, footers, forms, readers'
comments, adverts and the like count as empty, unless such a class or form holds most of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.session import ship

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML: element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPES = frozenset("html body article main section div td th table ul ol dl aside nav header footer form blockquote".split())
#: Elements that hold no text to be read, elements that are never article text, and such roles.
UNREAD = frozenset("script style noscript template iframe noframes xmp textarea title head button select datalist svg canvas audio video object embed applet map".split())
NEVER = frozenset("nav aside footer dialog menu".split())
LIFTABLE = frozenset("form fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip status".split())
#: Class or id words of what is no article text, and those that an article's own parts may have.
NEVER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|adunit|dfp|sponsor(?:ed|s)?|promos?|promoted|promotions?|banners?|cookies?|cookiebar|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|paywall|nav|navs?|navbar|navigation|menus?|submenu|topbar|breadcrumbs?|sidebars?|sidenav|footers?|masthead|widgets?|newsletter|subscribe|signup|login|pagination|pager|toolbar|hidden|sr-only|visually-hidden)(?=$|[\s_-])", re.I
)
WEAK_WORDS = re.compile(r"(?:^|[\s_-])(?:foot|share|sharing|social|related|recommend(?:ed|ations?)?|search|tags?|skip|print)(?=$|[\s_-])", re.I)
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond|discussion|reviews?|user-?comments?)(?=$|[\s_-])", re.I)
STATE_WORDS = re.compile(r"(?:^|\s)(?:has|with|without|no|is|single|page|post-type)[\w]*-\S+", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WHITE = re.compile(r"\s+")

#: Gaussian weights of the smoothing window; shares of the deviation and of the mean that a path must pass.
WINDOW, SHARE, LEAST = (0.25, 0.5, 0.25), 0.4, 0.1
#: Share of the content that a trunk must hold, and of links in a path's text that makes it a list of links.
CONTAINED, LINKED = 0.75, 2 / 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a text, never what holds it; their classes don't part paths.
PARTS = frozenset("p b i em strong span a li ul ol dl dt dd blockquote h1 h2 h3 h4 h5 h6 pre code table tbody tr td th figure figcaption u s small sub sup q cite font".split())
#: What hints say of a path: nothing, no article by a word that an article's parts may have,
#: no article unless it is most of the page, and no article.
OPEN, WEAK, SOFT, HARD = 0, 1, 2, 3


class Paths:
    """The distinct root-to-leaf paths of a page, as a tree; a parent comes before its children."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.parent, self.tag, self.hint, self.depth = [-1], [""], [OPEN], [0]

    def step(self, parent: int, tag: str, names: str, hint: int) -> int:
        key = (parent, tag, names, hint)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.hint.append(hint)
            self.depth.append(self.depth[parent] + 1)
        return found

    def sums(self, values: list) -> list:
        """For each path the sum of ``values`` over it and all below it."""
        total = list(values)
        for p in range(len(total) - 1, 0, -1):
            total[self.parent[p]] += total[p]
        return total

    def below(self, roots: set[int]) -> list[bool]:
        """For each path whether it is one of ``roots`` or below one."""
        inside = [False] * len(self.parent)
        for p in range(len(inside)):
            inside[p] = p in roots or (p > 0 and inside[self.parent[p]])
        return inside


class Unit:
    """The text of one block, with the path of the block; inline elements belong to it."""

    __slots__ = ("path", "parts", "size", "linked", "marks", "heading")

    def __init__(self, path: int, heading: bool):
        self.path, self.heading, self.parts, self.size, self.linked, self.marks = path, heading, [], 0, 0, 0

    def add(self, text: str, link: bool) -> None:
        self.parts.append(text)
        size = len(text.strip())
        self.size += size
        if link:
            self.linked += size
        self.marks += len(PUNCTUATION.findall(text))

    def length(self) -> float:
        """Characters of text; those of links count for an eighth."""
        return self.size - self.linked + self.linked // 8


def _hint(tag: str, attrs: str, inside: bool) -> tuple[int | None, str]:
    """(what element, role and class say; None: not to be read at all), and the class or id that parts paths."""
    if tag in UNREAD:
        return None, ""
    found = HARD if tag in NEVER else SOFT if tag in LIFTABLE and not (inside and tag == "header") else OPEN
    if not attrs or attrs == "/":
        return found, ""
    named = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in named or named.get("aria-hidden") == "true" or HIDDEN_STYLE.search(named.get("style", "")):
        return None, ""
    names = f"{named.get('class', '')} {named.get('id', '')}"
    label = "" if tag in PARTS else named.get("class") or named.get("id", "")
    if COMMENT_WORDS.search(names) and tag not in ("html", "body", "main"):
        if tag != "article" or re.search(r"(?:^|\s)comment", names, re.I):
            return max(found, HARD if not STATE_WORDS.search(names) else SOFT), label
    if tag in ("html", "body", "main", "article"):
        return found, label
    if named.get("role") in ROLES:
        return max(found, SOFT), label
    words = STATE_WORDS.sub(" ", names)
    if NEVER_WORDS.search(words):
        return max(found, SOFT), label
    if WEAK_WORDS.search(words):
        return max(found, WEAK if inside else SOFT), label
    return found, label


class Reader:
    """Reads a page once, front to back: its paths, and its blocks of text in page order.

    Work is linear in the page: an end tag looks for its element only if one is open, and elements
    passed on the way are closed.
    """

    def __init__(self, page: str):
        self.paths, self.units = Paths(), []
        self.stack: list[tuple[str, int, bool]] = []  # tag, path, whether its text is read
        self.opened: dict[str, int] = {}
        self.unit: Unit | None = None
        self.read(page)

    def text(self, raw: str) -> None:
        if self.stack and not self.stack[-1][2]:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        if not raw:
            return
        if self.unit is None:
            if not raw.strip():
                return
            path = self.stack[-1][1] if self.stack else 0
            while self.paths.tag[path] and self.paths.tag[path] not in BLOCK:
                path = self.paths.parent[path]
            self.unit = Unit(path, any(self.opened.get(h) for h in HEADINGS))
            self.units.append(self.unit)
        self.unit.add(raw, bool(self.opened.get("a")))

    def pop(self, to: int) -> None:
        for tag, *_ in self.stack[to:]:
            self.opened[tag] -= 1
            if tag in BLOCK:
                self.unit = None
        del self.stack[to:]

    def close(self, tag: str) -> None:
        if self.opened.get(tag):
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name == tag:
                    self.pop(k)
                    break
                if tag not in SCOPES and name in SCOPES and tag != "p":
                    break
        if tag in BLOCK:
            self.unit = None

    def implied(self, tag: str) -> None:
        """Closes what the start of ``tag`` closes."""
        if tag in BLOCK:
            self.unit = None
            if self.opened.get("p"):  # a block ends an open paragraph
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == "p":
                        self.pop(k)
                        break
                    if self.stack[k][0] in SCOPES:
                        break
        ended = CLOSES.get(tag)
        if ended and any(self.opened.get(t) for t in ended):
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in ended:
                    self.pop(k)
                    if tag not in ("tr", "tbody"):
                        break
                elif name in SCOPES and name not in ("td", "th"):
                    break

    def read(self, page: str) -> None:
        at, length, last = 0, len(page), page.rfind(">")
        while at < length:
            m = TOKEN.search(page, at) if at <= last else None
            if not m:
                rest = page.find("<!--", at)
                self.text(page[at:] if rest < 0 else page[at:rest])
                break
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self.close(tag)
                continue
            self.implied(tag)
            if tag == "br":
                self.text(" ")
            if tag in VOID:
                continue
            attrs = m["attrs"].strip()
            if attrs.endswith("/") and tag in ("svg", "path", "use"):
                continue
            if tag in RAW:
                at = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at).end()
                continue
            above, seen = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, True)
            hint, label = _hint(tag, attrs, bool(self.opened.get("article") or self.opened.get("main")))
            path = self.paths.step(above, tag, label, hint or OPEN)
            self.stack.append((tag, path, seen and hint is not None))
            self.opened[tag] = self.opened.get(tag, 0) + 1


def states(paths: Paths, lifted: set[int]) -> list[int]:
    """What the hints along each path say together; an article or main inside a SOFT one is OPEN."""
    state = [OPEN] * len(paths.parent)
    for p in range(1, len(state)):
        above, own = state[paths.parent[p]], OPEN if p in lifted else paths.hint[p]
        if above == SOFT and own == OPEN and paths.tag[p] in ("article", "main"):
            above = OPEN
        state[p] = max(above, own)
    return state


def judged(paths: Paths, units: list[Unit]) -> list[int]:
    """The state of each path. On a page without text in an open article, what is SOFT is lifted
    where it holds most of the text weight, in two unlinked blocks or more, with punctuation."""
    state = states(paths, set())
    within = paths.below({p for p in range(len(state)) if paths.tag[p] in ("article", "main")})
    if any(state[u.path] <= WEAK and within[u.path] for u in units):
        return state
    weight, blocks, marked = ([0.0] * len(state) for _ in range(3))
    for u in units:
        if state[u.path] < HARD:
            weight[u.path] += u.length() * (1 + u.marks)
            blocks[u.path] += u.linked < u.size
            marked[u.path] += u.marks > 0 and u.linked < u.size
    weight, blocks, marked = paths.sums(weight), paths.sums(blocks), paths.sums(marked)
    lifted = {p for p in range(len(state)) if paths.hint[p] == SOFT and 2 * weight[p] > weight[0] and blocks[p] > 1 and marked[p]}
    return states(paths, lifted) if lifted else state


def path_scores(units: list[Unit], open_: list[bool]) -> tuple[dict[int, float], float]:
    """(fused score of each path, threshold). The ratios of a path are its text length and its
    punctuation by number of blocks; both are smoothed along the page and fused by their product,
    and a path's score is the mean over its blocks. Paths that hints shut count as empty."""
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    count: dict[int, int] = {}
    for u in units:
        length[u.path] = length.get(u.path, 0) + u.length()
        marks[u.path] = marks.get(u.path, 0) + u.marks
        count[u.path] = count.get(u.path, 0) + 1

    def smoothed(sums: dict[int, float]) -> list[float]:
        values = [sums[u.path] / count[u.path] if open_[u.path] else 0.0 for u in units]
        wide = [values[0], *values, values[-1]]
        return [sum(w * x for w, x in zip(WINDOW, wide[i : i + 3])) for i in range(len(values))]

    fused = [t * (1 + m) if open_[u.path] else 0.0 for u, t, m in zip(units, smoothed(length), smoothed(marks))]
    mean = sum(fused) / len(fused)
    deviation = sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    score: dict[int, float] = {}
    for u, x in zip(units, fused):
        score[u.path] = score.get(u.path, 0) + x / count[u.path]
    return score, max(SHARE * deviation, LEAST * mean)


def content_paths(paths: Paths, units: list[Unit]) -> set[int]:
    """The paths whose blocks are the text.

    First those whose score passes the threshold. Their scores are then spread along the tree: of
    the paths below the trunk, the deepest that holds CONTAINED of the passed weight, those pass
    as well that are neither lists of links nor of a WEAK word, and so do headings below what all
    passed paths have in common. An article or main that holds half of the passed weight is
    trunk and bound: paths outside it are shut.
    """
    state = judged(paths, units)
    open_ = [s <= WEAK for s in state]
    score, limit = path_scores(units, open_)
    linked, size, count = ([0] * len(state) for _ in range(3))
    for u in units:
        linked[u.path] += u.linked
        size[u.path] += u.size
        count[u.path] += 1

    def passed() -> set[int]:
        return {p for p, s in score.items() if open_[p] and s > 0 and s >= limit}

    core = passed()
    if not core:
        return core

    def weights() -> list[float]:
        return paths.sums([score[p] * count[p] if p in core else 0.0 for p in range(len(state))])

    weight, trunk = weights(), 0
    landmarks = [p for p in range(1, len(state)) if paths.tag[p] in ("article", "main") and open_[p] and 2 * weight[p] > weight[0]]
    if landmarks:
        trunk = min(landmarks, key=lambda p: (paths.depth[p], paths.tag[p] != "article"))
        same = {p for p in range(1, len(state)) if paths.tag[p] == paths.tag[trunk]}
        inside = paths.below(same)
        open_ = [o and i for o, i in zip(open_, inside)]
        core = passed()
    else:
        within = [p for p in range(1, len(state)) if weight[p] >= CONTAINED * weight[0] and paths.tag[p] not in PARTS and paths.tag[p] not in ("html", "body")]
        trunk = max(within, key=lambda p: paths.depth[p], default=0)
        inside = paths.below({trunk} if trunk else set())
    held = paths.sums([1 if p in core else 0 for p in range(len(state))])
    shared = max((p for p in range(len(state)) if held[p] == len(core) and paths.tag[p] not in PARTS), key=lambda p: paths.depth[p])
    beside = paths.below({shared})
    headed = {u.path for u in units if u.heading}
    plain = {p for p in score if open_[p] and state[p] == OPEN}
    spread = {p for p in plain if inside[p] and linked[p] <= LINKED * size[p]}
    return core | spread | {p for p in plain if p in headed and beside[p]}


def title_above(paths: Paths, units: list[Unit], chosen: set[int]) -> set[int]:
    """Positions of the nearest heading before the text, if the text has none of its level: it
    stands beside the text, a menu or an advert may be between."""
    first = next((i for i, u in enumerate(units) if u.path in chosen), None)
    if first is None:
        return set()
    levels = [paths.tag[u.path] for u in units if u.heading and u.path in chosen]
    above, p = {0}, paths.parent[units[first].path]
    while p > 0:
        above.add(p)
        p = paths.parent[p]
    for i in range(first - 1, -1, -1):
        u = units[i]
        if u.heading and paths.hint[u.path] == OPEN and paths.parent[u.path] in above:
            return {i} if min(levels, default="h9") > paths.tag[u.path] else set()
        if paths.hint[u.path] == OPEN and not u.linked:
            break
    return set()


def main_text(page: str | None) -> str:
    """The article of a page: one line for each of its blocks; empty if it has none."""
    reader = Reader(page or "")
    units = [u for u in reader.units if u.size]
    if not units:
        return ""
    chosen = content_paths(reader.paths, units)
    extra = title_above(reader.paths, units, chosen)
    kept = (WHITE.sub(" ", "".join(u.parts)).strip() for i, u in enumerate(units) if u.path in chosen or i in extra)
    return "\n".join(x for x in kept if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of each of ``pages`` (page_id, url, html), from the whole html.

    Returns page_id, url, text, n_chars (code points). Character references are decoded, white
    space in a block is one space, blocks are joined by one line feed. Null or empty html, and
    pages of boilerplate alone, give the empty text. Markup may be broken: open elements end where
    HTML implies it. Repeated rows are read one by one. No rows give no rows; other columns are
    ignored.
    """
    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
