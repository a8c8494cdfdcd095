"""Main text of pages by a site style tree: branches of low entropy-based importance are removed."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh, in_slices, row_key, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SILENT = frozenset("script style noscript template head title svg iframe object canvas math".split())
RAW = frozenset("script style noscript template title iframe textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html br option button caption legend tbody td tfoot th thead tr".split())
#: An element that a start tag of the same kind ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where looking for such an element ends.
BOUNDARY = frozenset("table ul ol dl select article section body div".split())
#: Elements of noise by their tag; a header is one unless it holds an article's title, a form unless it holds the page.
NOISE_TAGS = frozenset("nav footer aside menu dialog button select textarea".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Last words of a class or id that name noise whatever stands before them, and wherever it stands.
SURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored cookie cookies consent gdpr "
    "comment comments disqus respond newsletter subscribe signup login breadcrumb breadcrumbs pagination pager".split()
)
#: Last words that name noise alone or after words of place; such a branch may still be what holds the page.
NOISE_NAMES = SURE_NAMES | frozenset(
    "promo promotion banner sidebar menu nav navbar navigation footer header masthead notice notices notification alert popup modal overlay "
    "share sharing social related recommended recommendations widget widgets toolbar form search".split()
)
#: They name noise after any word.
ALWAYS = SURE_NAMES | frozenset("sidebar menu nav navbar navigation footer masthead share sharing social".split())
#: First words that tell what a branch has, not what it is.
STATES = frozenset("has have with without no not is js hide show".split())
PLACES = frozenset("site page main top bottom left right primary secondary global the my blog sub mobile sticky fixed wp".split())
#: Words after the name of a part that only tell its place or form.
FORMS = PLACES | frozenset("wrapper wrap container box block area bar inner outer list links link items item buttons button slot unit section panel posts row col".split())
#: What a branch's entropy counts for: noise by its role, beside the content, perhaps noise, neutral, a labelled part of
#: the content. The content itself is never removed.
ROLE, BESIDE, MAYBE, NEUTRAL, INSIDE, CONTENT = range(6)
WEIGHTS = [0.2, 0.25, 0.5, 1.0, 1.0]


def role_of(name: str) -> int:
    """What one class or id says: ``ROLE``, ``MAYBE`` or, where it names no noise, ``NEUTRAL``."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or parts[0] in STATES:
        return NEUTRAL
    while len(parts) > 1 and parts[-1] in FORMS:
        parts.pop()
    if parts[-1] not in NOISE_NAMES:
        return NEUTRAL
    return ROLE if parts[-1] in ALWAYS or all(p in PLACES or p in NOISE_NAMES for p in parts[:-1]) else MAYBE


def is_sure(name: str) -> bool:
    parts = [p.lower() for p in _PART.findall(name)]
    while len(parts) > 1 and parts[-1] in FORMS:
        parts.pop()
    return role_of(name) == ROLE and bool(SURE_NAMES.intersection(parts))


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    return found[1].lower() if found else ""


class Page:
    """Elements in page order, each with parent, tag, label and kind, and the texts between the tags."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.names, self.label = [-1], ["#root"], [frozenset()], [""]
        self.texts: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self._parse(source)
        self._classify()

    def _parse(self, source: str) -> None:
        stack, at, end = [0], 0, len(source)
        while at < end:
            token = _TOKEN.match(source, at)
            at = token.end()
            name = token[2] or token[5]
            if not name:
                part = token[0]
                if len(part) < 2 or part[0] != "<":
                    self.texts.append((stack[-1], self.block, part))
                continue
            name, attributes = name.lower(), token[3] or token[6] or ""
            if name in BLOCKS:
                self.block += 1
            if token[1] or token[4]:
                if name == "p" and not any(self.tag[i] == "p" for i in stack):
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        del stack[depth:]
                        break
                continue
            if name in CLOSES_P:
                self._end(stack, {"p"}, frozenset({"table", "td", "th", "button", "article", "section", "body"}))
            if name in SIBLINGS:
                self._end(stack, SIBLINGS[name], BOUNDARY - {name})
            self.parent.append(stack[-1])
            self.tag.append(name)
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
            own = " ".join((found.get("class", ""), found.get("id", "")))
            names = set(own.split())
            if found.get("role", "").lower() in NOISE_ROLES:
                names.add("#noise")
            if found.get("role", "").lower() in ("main", "article") or "articlebody" in found.get("itemprop", "").lower():
                names.add("#content")
            self.names.append(frozenset(names))
            self.label.append(f"{name} {' '.join(sorted(own.lower().split()))}" if own.strip() else name)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                if name == "textarea" and close:
                    self.texts.append((len(self.tag) - 1, self.block, source[at : close.start()]))
                at = close.start() if close else end
            if name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append(len(self.tag) - 1)

    def _end(self, stack: list[int], tags: set[str], upto: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in tags:
                del stack[depth:]
                return
            if tag in upto:
                return

    def _is_header(self, i: int) -> bool:
        return self.tag[i] == "header" or any(role_of(x) != NEUTRAL and x.lower().endswith("header") for x in self.names[i])

    def _sure(self, i: int) -> bool:
        """Noise that holds no main text, however long: by tag, role attribute or a sure name."""
        tag, names = self.tag[i], self.names[i]
        if tag in ("html", "body", "main", "#root"):
            return False
        return tag in SILENT or tag in NOISE_TAGS or "#noise" in names or any(map(is_sure, names))

    def _role(self, i: int) -> int:
        """The strongest role that tag and names give."""
        tag, names = self.tag[i], self.names[i]
        if tag in ("html", "body", "main", "#root", "article"):
            return NEUTRAL
        if self._is_header(i):
            if self.inside[self.parent[i]] and i in self.titled:
                return NEUTRAL
            if tag == "header":
                return ROLE
        return ROLE if tag == "form" else min(map(role_of, names), default=NEUTRAL)

    def _classify(self) -> None:
        n = len(self.tag)
        self.titled = set()
        for i in range(n):
            if self.tag[i] in ("h1", "h2"):
                at = i
                while at > 0 and at not in self.titled:
                    self.titled.add(at)
                    at = self.parent[at]
        within, sure, link = [False] * n, [False] * n, [False] * n  # an article or main text, by its tag or role; noise; a link
        self.inside = within
        for i in range(1, n):
            above = self.parent[i]
            within[i] = within[above] or self.tag[i] in ("article", "main") or "#content" in self.names[i]
            sure[i] = sure[above] or self._sure(i)
            link[i] = link[above] or self.tag[i] == "a"
        mass = [0] * n  # characters outside of links and sure noise
        for i, _, text in self.texts:
            if not sure[i] and not link[i]:
                mass[i] += len(text.strip())
        own = mass[:]
        holds = [not sure[i] and (self.tag[i] == "article" or "#content" in self.names[i] or self.tag[i] == "main") for i in range(n)]
        for i in range(n - 1, 0, -1):  # children come after their parents
            mass[self.parent[i]] += mass[i]
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        noise, maybe = sure[:], [False] * n
        for i in range(1, n):
            role = NEUTRAL if noise[i] else self._role(i)
            if role < NEUTRAL and (2 * mass[i] > mass[0] if holds[i] else not holds[0] and 5 * mass[i] >= 4 * mass[0] > 0):
                role = NEUTRAL  # a wrapper of the page that is named after a part of it
            noise[i] = noise[i] or noise[self.parent[i]] or role == ROLE
            maybe[i] = role == MAYBE
        left = [0 if noise[i] else own[i] for i in range(n)]
        for i in range(n - 1, 0, -1):
            left[self.parent[i]] += left[i]
        roots: set[int] = set()
        for wanted in ("article", "main"):
            found = {i for i in range(n) if not noise[i] and (self.tag[i] == wanted or (wanted == "main" and "#content" in self.names[i]))}
            if found and 2 * self._together(left, found) >= left[0]:
                roots = found
                break
        above, content = set(), [False] * n
        for i in roots:
            at = self.parent[i]
            while at > 0 and at not in above:
                above.add(at)
                at = self.parent[at]
        body = self._together(left, roots)
        self.noise = noise
        self.kind = [NEUTRAL] * n
        for i in range(1, n):
            content[i] = content[self.parent[i]] or i in roots
            if self.tag[i] in ("html", "body") or self.parent[i] == -1:
                self.kind[i] = CONTENT
            elif noise[i]:
                self.kind[i] = ROLE
            elif i in above or i in roots:
                self.kind[i] = CONTENT
            elif roots and not content[i]:
                self.kind[i] = BESIDE
            elif maybe[i]:
                self.kind[i] = MAYBE
            elif content[i]:
                labelled = self.label[i] != self.tag[i] and self.tag[i] in BLOCKS and i not in self.titled
                self.kind[i] = INSIDE if labelled and 2 * left[i] < body else CONTENT
            elif 2 * left[i] > left[0]:
                self.kind[i] = CONTENT
        self.kind[0] = CONTENT
        path = [0] * n
        for i in range(1, n):
            path[i] = xxhash.xxh3_64_intdigest(f"{path[self.parent[i]]} {self.label[i]}")
        self.node = [(xxhash.xxh3_64_intdigest(f"{p} {k}") ^ 1 << 63) - (1 << 63) for p, k in zip(path, self.kind, strict=True)]

    def _together(self, sizes: list[int], chosen: set[int]) -> int:
        """Size of the chosen elements, those inside another one counted with it."""
        within, total = [False] * len(sizes), 0
        for i in range(1, len(sizes)):
            within[i] = within[self.parent[i]]
            if i in chosen and not within[i]:
                within[i] = True
                total += sizes[i]
        return total

    def identity(self) -> int:
        """Hash of the text outside noise: pages that differ in nothing else count as one."""
        return hash_of("".join(text for i, _, text in self.texts if not self.noise[i]))

    def branches(self) -> dict[int, list]:
        """Per node of the style tree: kind, and what its children and its whole text look like on this page."""
        n = len(self.tag)
        children, texts = [[] for _ in range(n)], [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parent[i]].append(self.label[i])
        for i, _, text in self.texts:
            texts[i].append(text)
        for i in range(n - 1, 0, -1):  # children come after their parents
            texts[self.parent[i]].append(str(hash_of("".join(texts[i]))) if any(t.strip() for t in texts[i]) else "")
        found: dict[int, list] = {}
        for i in range(1, n):
            if self.kind[i] != CONTENT and self.tag[i] not in SILENT:
                seen = found.setdefault(self.node[i], [self.kind[i], [], []])
                seen[1].append("|".join(children[i]))
                seen[2].append(" ".join(" ".join(texts[i]).split()))
        return found

    def text(self, gone: set[int]) -> str:
        """Text of what isn't removed: references decoded, white space of a block as one space."""
        out = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            out[i] = out[self.parent[i]] or self.tag[i] in SILENT or (self.kind[i] != CONTENT and self.node[i] in gone)
        blocks: dict[int, list[str]] = {}
        for i, block, text in self.texts:
            if not out[i]:
                blocks.setdefault(block, []).append(text)
        parts = (" ".join(entities.unescape("".join(pieces)).split()) for _, pieces in sorted(blocks.items()))
        return " ".join(p for p in parts if p)


def hash_of(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) ^ 1 << 63) - (1 << 63)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_slices(frames, "text", 2_000_000):
        rows = []
        for kid, kh, url, source in zip(frame.kid, frame.kh, frame.url, frame.text, strict=True):
            if isinstance(source, str) and source:
                read = Page(source)
                host, page = host_of(url), read.identity()
                for node, (kind, style, text) in read.branches().items():
                    rows.append((kid, kh, host, page, node, kind, hash_of("\n".join(style)), hash_of("\n".join(text))))
        if rows:
            yield pd.DataFrame(rows, columns=["kid", "kh", "host", "page", "node", "kind", "style", "content"])


def _extract(sources: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([Page(s).text(set(() if g is None else g)) if isinstance(s, str) and s else "" for s, g in zip(sources, gone, strict=True)], dtype=object)


def main_text(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    threshold: float = 0.3,
    content_share: float = 0.9,
    prior_pages: float = 8.0,
) -> DataFrame:
    """The pages with ``text``: what is left when branches of low importance are removed.

    A node of a host's style tree is a path of tags with their classes and ids; the pages of a
    host are merged by it. Its presentation on a page is the sequence of its children, its
    content the text below it. The entropy of a node is
    (1 - content_share) * H(presentation) + content_share * H(content), each an entropy over the
    host's different pages, in units of their number, so it is 1 where every page differs and
    0 where all agree. Its importance shrinks it: the same node over all hosts (the pooled tree)
    towards 1, and the host's own towards the pooled one, each with the weight of ``prior_pages``
    pages, so few pages decide little. It is weighted by what tag, class, id and role say of
    the branch, and below ``threshold`` the branch goes:

    - noise by its role (menu, header, footer, sidebar, notice, advert, form, comments) and what is
      beside an article or main text: weights so low that they always go;
    - perhaps noise, where a class ends in such a word after another one (``image-banner``): only
      entropy above 0.6 keeps it;
    - neutral branches of pages without an article, and labelled blocks inside an article that
      hold no title and less than half of its text: low entropy removes them;
    - the article or main text itself, what holds it, and a branch with more than half of a page's
      text are never removed.

    A class counts by its last word, not by any (``form-factor``), and not where it tells what a branch has
    (``has-header``). A branch named like noise that holds an article and most of the page's text is a wrapper. An
    article counts as main text if it has half of the text that isn't noise, text of links aside.

    Counting is by hashes, combined before the shuffle, so a host with a third of all pages is
    spread over its nodes and their values; pages equal outside of noise count once. Null and empty html
    give an empty text; null urls share one host. All columns and rows stay; ``text`` is replaced.
    """
    kid, kh, gone = fresh(pages, "kid", "kh", "gone")
    one, two = row_key(F.col(id_column).cast("long"), F.concat_ws("\n", url_column, html_column))
    keyed = pages.select(one.alias("kid"), two.alias("kh"), F.col(url_column).alias("url"), F.col(html_column).alias("text"))
    nodes = written(
        keyed.mapInPandas(_read, "kid long, kh long, host string, page long, node long, kind int, style long, content long"), "style-tree"
    )
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("style").alias("value")), F.struct(F.lit(1).alias("side"), F.col("content").alias("value"))))
    values = nodes.select("host", "node", "page", sides.alias("s")).select("host", "node", "page", "s.*").distinct()
    counts = values.groupBy("host", "node", "side", "value").agg(F.count("*").alias("n"))
    share = F.when(F.col("side") == 1, F.lit(content_share)).otherwise(F.lit(1 - content_share))

    def entropies(counted: DataFrame, *node: str) -> DataFrame:
        """Per node the number of pages, and entropy of presentation and content in units of its logarithm."""
        sums = counted.groupBy(*node, "side").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        bits = F.when(F.col("m") < 2, F.lit(1.0)).otherwise((F.log("m") - F.col("s") / F.col("m")) / F.log("m"))
        return sums.groupBy(*node).agg(F.max("m").alias("m"), F.sum(share * bits).alias("h"))

    own = entropies(counts, "host", "node")
    pool = entropies(counts.groupBy("node", "side", "value").agg(F.sum("n").alias("n")), "node")
    pool = pool.select("node", ((F.col("m") * F.col("h") + prior_pages) / (F.col("m") + prior_pages)).alias("pooled"))
    shrunk = (F.col("m") * F.col("h") + prior_pages * F.col("pooled")) / (F.col("m") + prior_pages)
    importance = written(own.join(pool, "node").select("host", "node", shrunk.alias("importance")), "importance")
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("kind") + 1)
    low = nodes.select("host", "node", "kid", "kh", weights.alias("weight")).join(importance, ["host", "node"])
    low = low.where(F.col("weight") * F.col("importance") < threshold)
    removed = low.groupBy(F.col("kid").alias(kid), F.col("kh").alias(kh)).agg(F.collect_set("node").alias(gone))
    joined = pages.drop("text").withColumns({kid: one, kh: two}).join(removed.hint("merge"), [kid, kh], "left")
    extract = F.pandas_udf(_extract, "string")
    return joined.withColumn("text", extract(F.col(html_column), F.col(gone))).drop(kid, kh, gone)
