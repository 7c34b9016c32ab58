"""Main text of web pages by wrapper induction over the pages of a host.

Pages become trees of elements. For each host one page of typical length is its wrapper's skeleton, and every other page
is aligned with it by simple tree matching. Subtrees without a counterpart, of a name and role new to the place, that ``MIN_PAGES``
pages have there are merged into the wrapper in Spark rounds, until no wrapper grows; alike siblings count as one repeated
slot. Then each matched text node votes whether it says the same as the wrapper's, with its words and words in links.
Votes are counts per (host, node), summed before the shuffle, so a host with a third of all pages is no burden to any
task. A node that says the same on nearly all distinct pages is template; nodes that vary are slots. In a last pass
each page is aligned again, template nodes go, and the text of the content slots remains.

Content slots are those with running text: ``RUNNING`` words a block or more, most of them outside links, averaged over the host
where the wrapper has the element, else as the page has it. Article and main elements settle doubt: all slots in them are content
but for boilerplate, and where they hold most of the running text, others must have running text; where they
do not, or are missing, only slots that are rich in links all over the host go.

An element that is boilerplate by its name, role or being hidden goes unless it holds most of the page's running text (words
outside links) and no article or main element elsewhere settles the doubt; so does a header outside article and main.
Words of a class or id, and forms, only lower the standing: such an element goes if it is rich in links or its blocks are
short, never if it holds most of the running text.

Defined results: null or empty html, and html without text, give an empty text; a null or hostless url forms the host ""
whose pages use no template; pages repeated word for word vote once; fewer than ``MIN_PAGES`` distinct pages
make no template; an empty table gives an empty result; extra columns are not read. Markup may be broken or cut short.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from embertrace.llm.common import map_batches, sheltered
from embertrace.staging import stage

MIN_PAGES = 10
#: Share of a node's matched pages that say the same.
TEMPLATE_SHARE = 0.9

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
_CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that gather links.
CONTAINERS = set("ul ol dl table div section".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "tr", "body", "html", "div", "article", "section", "main", "select", "td", "th"}

#: Elements without running text.
NEVER_TEXT = set("""head title script style noscript template iframe button select option textarea input svg canvas object embed
video audio map datalist""".split())
#: Elements and roles that are boilerplate by their meaning.
NAMED_TAGS = {"nav", "footer", "aside", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert"}
#: Elements, and words of a class or id, that only lower an element's standing.
DOUBTED_TAGS = {"form", "fieldset", "label"}
WORDS = set("""ad ads advert adverts advertisement advertising adsense banner sponsored sponsor promo promotion sidebar
navigation nav navbar menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice newsletter subscribe
subscription signup popup modal overlay paywall comment comments commentlist disqus reply replies respond share sharing social related
recommended recommendations widget pagination pager toolbar skip teaser teasers""".split())
#: Standing of an element: nothing known, some words of a name speak against it, a whole name does, its meaning does, no text at all.
PLAIN, WEAK, STRONG, NAMED, NEVER = range(5)
#: Words a block from which text runs.
RUNNING = 15

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<",
                    re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element, or a text (tag ""). ``role`` tells elements of one name apart in matching.

    ``words``, ``linked`` (words in links) and ``blocks`` (blocks with words of their own) count what lies below, and
    ``landmarks`` the article and main elements there.
    """

    __slots__ = ("tag", "role", "text", "children", "standing", "dropped", "size", "words", "linked", "blocks", "landmarks", "template", "hashed")

    def __init__(self, tag: str, role: str = "", text: str = "", standing: int = PLAIN) -> None:
        self.tag, self.role, self.text, self.standing = tag, role, text, standing
        self.children: list[Node] = []
        self.size, self.dropped, self.template = 1, False, False
        self.hashed: int | None = None
        self.words = self.linked = self.blocks = self.landmarks = 0


def _standing(tag: str, attributes: str) -> tuple[str, int]:
    """(class and role of an element as matching sees them, its standing)."""
    known = NEVER if tag in NEVER_TEXT else NAMED if tag in NAMED_TAGS else STRONG if tag in DOUBTED_TAGS else PLAIN
    if not attributes:
        return "", known
    values: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        values.setdefault(key.lower(), value.strip("\"'").lower())  # the first of two of one name counts
    role = " ".join(v for k, v in values.items() if k in ("class", "role"))
    if tag in ("html", "body"):
        return role, PLAIN
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        against = [w in WORDS for w in _WORD.findall(name)]
        if any(against):
            known = max(known, STRONG if all(against) else WEAK)
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
    if hidden or values.get("role") in ROLES:
        known = max(known, NAMED)
    elif values.get("role") == "form":
        known = max(known, STRONG)
    return role, known


def parse(page: str) -> Node:
    """Tree of a page; unclosed and misnested elements are closed where the standard closes them."""
    root = Node("html")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.match(page, at)
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            text = found.group()
            if text[0] != "<" or text == "<":
                _add_text(stack[-1], text)
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in ("html", "body"):
            if tag == "html" or any(x.tag == "body" for x in stack):
                continue
        if tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in _SCOPE:
                    break
        if tag in _SIBLING:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in _SIBLING[tag]:
                    del stack[depth:]
                    break
                if stack[depth].tag in _SCOPE:
                    break
        if tag == "body" and len(stack) > 1 and stack[1].tag == "head":
            del stack[1:]
        role, standing = _standing(tag, attributes)
        node = Node(tag, role, standing=standing)
        if standing != NEVER:
            stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if len(stack) < 400:  # deeper elements become siblings
            stack.append(node)
    _measure(root)
    return root


def _add_text(parent: Node, text: str) -> None:
    if "&" in text:
        text = entities.unescape(text)
    if parent.children and parent.children[-1].tag == "":
        parent.children[-1].text += text
    else:
        parent.children.append(Node("", text=text))


def _measure(node: Node) -> int:
    node.size = 1 + sum(map(_measure, node.children))
    return node.size


# --- alignment ---------------------------------------------------------------------------


def numbered(root: Node) -> dict[int, int]:
    """Numbers of all nodes of a tree in page order, by identity."""
    numbers: dict[int, int] = {id(root): 0}

    def walk(node: Node) -> None:
        for child in node.children:
            numbers[id(child)] = len(numbers)
            walk(child)

    walk(root)
    return numbers


def said(node: Node) -> int:
    """Hash of what a text says."""
    if node.hashed is None:
        node.hashed = xxh3_64_intdigest(" ".join(node.text.split()).encode("utf-8", "surrogatepass")) >> 1
    return node.hashed


def written(node: Node) -> str:
    """A tree in page order as JSON: elements [depth, tag, role, standing], texts [depth, hash, words, words in links]."""
    out: list[list] = []

    def walk(x: Node, depth: int) -> None:
        out.append([depth, said(x), x.words, x.linked] if x.tag == "" else [depth, x.tag, x.role, x.standing])
        for child in x.children:
            walk(child, depth + 1)

    walk(node, 0)
    return json.dumps(out, separators=(",", ":"))


def read(tree: str) -> Node:
    """The tree that :func:`written` wrote; its texts have hashes only."""
    path: list[Node] = []
    for depth, name, role, last in json.loads(tree):
        if isinstance(name, str):
            node = Node(name, role, standing=last)
        else:
            node = Node("")
            node.hashed, node.words, node.linked = name, role, last
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    _measure(path[0])
    return path[0]


def _alike(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.role == b.role


class Matcher:
    """Simple tree matching: the largest set of node pairs that keeps parents and sibling order."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}
        #: Matched elements, of the wrapper and of the page.
        self.elements: list[tuple[Node, Node]] = []

    def weight(self, a: Node, b: Node) -> int:
        if not _alike(a, b):
            return 0
        if not a.children or not b.children:
            return 1
        key = (id(a), id(b))
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = 1 + self._table(a.children, b.children)[-1][-1]
        return found

    def _table(self, left: list[Node], right: list[Node]) -> list[list[int]]:
        table = [[0] * (len(right) + 1)]
        for a in left:
            above, row = table[-1], [0]
            for j, b in enumerate(right):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if a.tag == b.tag:
                    with_pair = above[j] + self.weight(a, b)
                    if with_pair > best:
                        best = with_pair
                row.append(best)
            table.append(row)
        return table

    def pairs(self, a: Node, b: Node, out: list[tuple[Node, Node]]) -> None:
        """Matched text nodes below two matched elements, appended to ``out``."""
        self.elements.append((a, b))
        left, right = a.children, b.children
        first = 0
        while first < len(left) and first < len(right) and self._same_shape(left[first], right[first]):
            self._take(left[first], right[first], out)
            first += 1
        left, right = left[first:], right[first:]
        if not left or not right:
            return
        table = self._table(left, right)
        i, j = len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                self._take(left[i], right[j], out)

    def _same_shape(self, a: Node, b: Node) -> bool:
        """Leading siblings that match in full need no table."""
        return _alike(a, b) and a.size == b.size and self.weight(a, b) == a.size

    def _take(self, a: Node, b: Node, out: list[tuple[Node, Node]]) -> None:
        if a.tag == "":
            out.append((a, b))
        else:
            self.pairs(a, b, out)


def align(skeleton: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs of text nodes, of the skeleton and of the page."""
    return matched(skeleton, page)[0]


def matched(wrapper: Node, page: Node) -> tuple[list[tuple[Node, Node]], list[tuple[Node, Node]]]:
    """Pairs of text nodes and of elements, of the wrapper and of the page."""
    out: list[tuple[Node, Node]] = []
    matcher = Matcher()
    matcher.pairs(wrapper, page, out)
    return out, matcher.elements


def unmatched(texts: list[tuple[Node, Node]], elements: list[tuple[Node, Node]]) -> dict[tuple[int, str, str], tuple[str, int]]:
    """Subtrees with words, of a name and role that their place in the wrapper lacks: by (identity of the wrapper's element, tag,
    role), the subtree and the place among the element's children before which it stands."""
    own = {id(b): a for a, b in texts}
    own.update((id(b), a) for a, b in elements)
    found: dict[tuple[int, str, str], tuple[str, int]] = {}
    for a, b in elements:
        names = places = None
        place = 0
        for child in b.children:
            twin = own.get(id(child))
            if twin is not None:
                if places is None:
                    places = {id(x): i for i, x in enumerate(a.children)}
                place = places[id(twin)] + 1
            elif child.words:
                if names is None:
                    names = {(x.tag, x.role) for x in a.children}
                if (child.tag, child.role) not in names:
                    found.setdefault((id(a), child.tag, child.role), (written(child), place))
    return found


# --- standing ------------------------------------------------------------------------------


#: Words, words in links and blocks with words, of an element.
Facts = tuple[int, int, int]


def _landmark(node: Node) -> bool:
    return node.standing == PLAIN and (node.tag in ("article", "main") or node.role == "main")


def _facts(node: Node, known: dict[int, Facts]) -> Facts:
    """Facts of the host where the wrapper has the element, else of the page."""
    return known.get(id(node)) or (node.words, node.linked, node.blocks)


def _runs(facts: Facts) -> bool:
    words, linked, blocks = facts
    return 2 * linked < words and words >= RUNNING * max(blocks, 1)


def _count(node: Node, linked: bool) -> bool:
    """Count words, links, blocks and landmarks below ``node``; whether words of it belong to a block around it."""
    loose = False
    node.words = node.linked = node.blocks = node.landmarks = 0
    for child in node.children:
        if child.tag == "":
            child.words = 0 if child.template else len(child.text.split())
            child.linked = child.words if linked else 0
            loose = loose or child.words > 0
        elif child.dropped:
            continue
        else:
            loose = _count(child, linked or child.tag == "a") or loose
            node.blocks += child.blocks
            node.landmarks += child.landmarks + _landmark(child)
        node.words += child.words
        node.linked += child.linked
    if node.tag in BLOCKS and loose:
        node.blocks += 1
        return False
    return loose


def _goes(node: Node, standing: int, root: Node, inside: bool, known: dict[int, Facts]) -> bool:
    """Whether an element of low standing is boilerplate on this page."""
    running = node.words - node.linked
    # An article or main element elsewhere settles the doubt about an element that holds most of the page's text.
    settled = root.landmarks and not node.landmarks and not inside
    if 2 * running > root.words - root.linked and not (settled and standing == NAMED):
        return False
    if standing == NAMED:
        return True
    words, linked, blocks = _facts(node, known)
    blocks = max(blocks, 1)
    if standing == WEAK:
        return 2 * linked >= words and words < RUNNING * blocks
    rest = (root.words - node.words) / max(root.blocks - node.blocks, 1)
    return 3 * linked >= words or words < max(RUNNING, rest / 2) * blocks


def judge(root: Node, known: dict[int, Facts]) -> bool:
    """Mark the boilerplate elements of a page; whether its article and main elements hold most of the running text left."""
    _count(root, False)

    def walk(node: Node, inside: bool) -> None:
        for child in node.children:
            standing = child.standing
            if standing == PLAIN and not inside:
                if child.tag == "header":
                    standing = NAMED
                # The host's wrapper may speak against a slot that is rich in links.
                elif not child.landmarks and child.tag in CONTAINERS and id(child) in known:
                    standing = WEAK
            if standing:
                child.dropped = _goes(child, standing, root, inside, known)
            if child.children and not child.dropped:
                walk(child, inside or _landmark(child))

    def held(node: Node) -> int:
        return sum(x.words - x.linked if _landmark(x) else held(x) for x in node.children if x.landmarks or _landmark(x))

    walk(root, False)
    _count(root, False)
    return root.landmarks > 0 and 2 * held(root) >= root.words - root.linked


# --- text ----------------------------------------------------------------------------------


def main_text(root: Node, known: dict[int, Facts]) -> str:
    """Blocks of the content slots, without template texts; ``known`` has facts of the host by the identity of elements."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    def walk(node: Node, content: bool) -> None:
        for child in node.children:
            if child.tag == "":
                if not child.template and (content or _runs((child.words, child.linked, 1))):
                    line.append(child.text)
                continue
            if child.dropped:
                close() if child.tag in BLOCKS else None
                continue
            chosen = content or _landmark(child) or not child.landmarks and _runs(_facts(child, known))
            if child.tag in BLOCKS:
                close()
                walk(child, chosen)
                close()
            else:
                if child.tag == "br":
                    line.append(" ")
                walk(child, chosen)

    walk(root, not judge(root, known))
    close()
    return "\n".join(blocks)


# --- Spark -----------------------------------------------------------------------------------


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def trees(pages: DataFrame) -> DataFrame:
    """``host, key, n, tree`` of the distinct pages (host, html): hash and length of the page, and its tree without texts."""

    def run(batches):
        for batch in batches:
            out: list[str] = []
            for page in batch.column(3).to_pylist():
                root = parse(page)
                _count(root, False)
                out.append(written(root))
            yield {"host": batch.column(0), "key": batch.column(1), "n": batch.column(2), "tree": out}

    keyed = pages.filter("host <> ''").select("host", F.xxhash64("html").alias("key"), F.length("html").alias("n"), "html")
    made = map_batches(keyed, "host:string, key:long, n:int, tree:string", run)
    return stage(made.dropDuplicates(["host", "key"]), "page-trees")


def grown(wrapper: str, additions: list[tuple[int, int, str]]) -> str:
    """A wrapper with subtrees (number of the element, place among its children, subtree) merged in."""
    root = read(wrapper)
    numbers = numbered(root)
    by_number: dict[int, Node] = {}

    def walk(node: Node) -> None:
        by_number[numbers[id(node)]] = node
        for child in node.children:
            walk(child)

    walk(root)
    for number, place, tree in sorted(additions, reverse=True):  # from the back, so that places stay right
        by_number[number].children.insert(place, read(tree))
    return written(root)


class Host:
    """A wrapper as a task uses it."""

    def __init__(self, wrapper: str, votes: list[int] = (), min_pages: int = 1, share: float = 1.0) -> None:
        self.root = read(wrapper)
        self.numbers = numbered(self.root)
        #: (seen, same, words, words in links) by text node.
        self.votes = {votes[i]: tuple(votes[i + 1: i + 5]) for i in range(0, len(votes), 5)}
        self.template = {n for n, (seen, same, _, _) in self.votes.items() if seen >= min_pages and same >= share * seen}
        self.facts: dict[int, Facts] = {}
        self.min_pages = min_pages
        if votes:
            self._gather(self.root)

    def _gather(self, node: Node) -> tuple[int, int, int, int, int]:
        """(words, in links, blocks, words of the slots' pages not yet in a block, pages that voted)."""
        words = linked = blocks = loose = pages = 0
        for child in node.children:
            if child.tag == "":
                number = self.numbers[id(child)]
                seen, _, w, k = self.votes.get(number, (0, 0, 0, 0))
                pages = max(pages, seen)
                if number not in self.template and w:
                    words, linked, loose = words + w, linked + k, max(loose, seen)
            else:
                w, k, b, open_, seen = self._gather(child)
                words, linked, blocks, loose, pages = words + w, linked + k, blocks + b, max(loose, open_), max(pages, seen)
        if node.tag in BLOCKS:
            blocks, loose = blocks + loose, 0
        if pages >= self.min_pages and words:
            self.facts[id(node)] = words, linked, blocks
        return words, linked, blocks, loose, pages


def hosts_by_name(make):
    """A memory of wrappers by host name."""
    known: dict[str, Host] = {}

    def get(name: str, *values) -> Host:
        if name not in known:
            if len(known) > 256:
                known.clear()
            known[name] = make(*values)
        return known[name]

    return get


_ROUND = "host:string, node:int, tag:string, role:string, tree:string, place:int, seen:long, same:long, words:long, linked:long"


def _aligned(batches):
    """Votes (tag null) and unmatched subtrees of pages (host, tree, wrapper)."""
    host_of_name = hosts_by_name(Host)
    for batch in batches:
        votes: dict[tuple[str, int], list[int]] = {}
        extra: dict[tuple, list[int]] = {}
        for name, tree, wrapper in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
            host, page = host_of_name(name, wrapper), read(tree)
            _sum_words(page)
            texts, elements = matched(host.root, page)
            for a, b in texts:
                vote = votes.setdefault((name, host.numbers[id(a)]), [0, 0, 0, 0])
                vote[0] += 1
                vote[1] += a.hashed == b.hashed
                vote[2] += b.words
                vote[3] += b.linked
            for (a, tag, role), (subtree, place) in unmatched(texts, elements).items():
                found = extra.setdefault((name, host.numbers[a], tag, role, subtree), [place, 0])
                found[0] = min(found[0], place)
                found[1] += 1
        rows = [(h, n, None, None, None, 0, *v) for (h, n), v in votes.items()]
        rows += [(*key, place, seen, 0, 0, 0) for key, (place, seen) in extra.items()]
        names = [x.split(":")[0].strip() for x in _ROUND.split(",")]
        yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _sum_words(node: Node) -> int:
    if node.tag:
        node.words = sum(map(_sum_words, node.children))
    return node.words


def _grow(batches):
    for batch in batches:
        out = [grown(wrapper, [(x["node"], x["place"], x["tree"]) for x in additions])
               for wrapper, additions in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield {"host": batch.column(0), "wrapper": out}


def wrappers(pages: DataFrame, min_pages: int) -> DataFrame:
    """``w_host, wrapper, votes``: per host the grown wrapper and (number, seen, same, words, words in links) of its text nodes."""
    distinct = trees(pages)
    typical = distinct.groupBy("host").agg(F.percentile_approx("n", 0.5, 1000).alias("typical"))
    # Choose by length and hash first, so that trees are not shuffled for it.
    chosen = distinct.select("host", "n", "key").join(typical, "host").groupBy("host").agg(
        F.min(F.struct(F.abs(F.col("n") - F.col("typical")), F.col("key"))).alias("best"))
    chosen = stage(chosen.select(F.col("host").alias("c_host"), F.col("best.key").alias("c_key")), "skeleton-keys")
    found = distinct.join(chosen, (F.col("host") == F.col("c_host")) & (F.col("key") == F.col("c_key")))
    growing = stage(found.select("host", F.col("tree").alias("wrapper")), "wrappers")
    done = None
    while True:
        # Only hosts whose wrapper has grown are aligned again. It ends, as no (element, name, role) is merged twice.
        rows = stage(map_batches(distinct.join(growing, "host").select("host", "tree", "wrapper"), _ROUND, _aligned), "aligned")
        place = ["host", "node", "tag", "role"]
        said_alike = rows.filter("tag IS NOT NULL").groupBy(*place, "tree").agg(F.sum("seen").alias("n"), F.min("place").alias("place"))
        merged = said_alike.groupBy(*place).agg(
            F.sum("n").alias("n"), F.max_by(F.struct("node", "place", "tree"), F.struct("n", "tree")).alias("subtree"),
        ).filter(F.col("n") >= min_pages)
        additions = merged.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("additions"))
        following = stage(map_batches(growing.join(additions, "host").select("host", "wrapper", "additions"),
                                      "host:string, wrapper:string", _grow), "wrappers")
        voted = rows.filter("tag IS NULL").join(following.select("host"), "host", "left_anti").groupBy("host", "node").agg(
            *[F.sum(c).alias(c) for c in ("seen", "same", "words", "linked")])
        vote = F.struct(F.col("node").cast("long").alias("node"), "seen", "same", "words", "linked")
        listed = F.sort_array(F.collect_list(vote))
        flat = F.flatten(F.transform(listed, lambda v: F.array(v["node"], v["seen"], v["same"], v["words"], v["linked"])))
        settled = growing.join(voted.groupBy("host").agg(flat.alias("votes")), "host").select(
            F.col("host").alias("w_host"), "wrapper", "votes")
        done = settled if done is None else done.unionByName(settled)
        if following.isEmpty():
            return stage(done, "wrappers")
        growing = following


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    pages = sheltered(pages, ("page_id", "url", "html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    hosted = rows.withColumn("host", host_of(F.col("url")))
    own = wrappers(hosted.select("host", "html"), min_pages)
    met = hosted.join(own, F.col("host") == F.col("w_host"), "left")

    def texts(batches):
        host_of_name = hosts_by_name(lambda wrapper, votes: Host(wrapper, votes, min_pages, share))
        for batch in batches:
            out = []
            for name, page, wrapper, votes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                root = parse(page)
                known: dict[int, Facts] = {}
                if votes:
                    host = host_of_name(name, wrapper, votes)
                    pairs, elements = matched(host.root, root)
                    for a, b in pairs:
                        # A matched node is template only where this page says the same as well.
                        b.template = host.numbers[id(a)] in host.template and a.hashed == said(b)
                    known = {id(b): host.facts[id(a)] for a, b in elements if id(a) in host.facts}
                out.append(main_text(root, known))
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(out, pa.string()),
                   "n_chars": [len(t) for t in out]}

    return map_batches(met.select("page_id", "url", "host", "html", "wrapper", "votes"),
                       "page_id:long, url:string, text:string, n_chars:long", texts)
