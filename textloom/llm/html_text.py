"""Main text of raw web pages by a conditional random field over leaf blocks.

A page is read as tags and text. Block-level tags bound blocks, each a run of inline text with its
ancestors. A linear chain labels the blocks as article or not: features of the
ancestors' tags, classes and ids, of the text (length, share in links, punctuation, place), of the blocks before and
after, and of what the containers around it hold (words, share in links, share of the page's words), and
weights between neighbours. It is trained by gradient ascent on the likelihood (forward and
backward sums) over labelled pages that labelled_pages() makes, with telling tags and names and without, and
decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import pick

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style template noscript iframe object svg math textarea title canvas audio video button".split())
#: Tags that an opening tag ends, if they are open below the nearest of its scopes.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


#: Block-level tags that lay out a page rather than hold a text of their own.
HOLDERS = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption legend option tr th ul ol dl menu dir tbody thead tfoot summary hr head".split())


class Node:
    """An open tag; its parent is the tag around it. What is worked out of its ancestors is kept with it, so that depth costs nothing."""

    __slots__ = ("parent", "tag", "names", "marks", "leaf", "under", "holder", "words", "chars", "linked")

    def __init__(self, parent: Node | None, tag: str, names: str):
        self.parent, self.tag, self.names = parent, tag, names
        self.words = self.chars = self.linked = 0
        if parent is None:
            self.marks, self.leaf, self.under, self.holder = (), "-", "-", self
            return
        own = {f"named {w}" for w in _PART.findall(names)} if names else set()
        if tag not in ("html", "body"):
            own.add(f"in {tag}")
        self.marks = parent.marks if own.issubset(parent.marks) else tuple(sorted(own.union(parent.marks)))
        block = tag in BLOCK and tag not in ("html", "body")
        self.leaf, self.under = (tag, parent.leaf) if block else (parent.leaf, parent.under)
        self.holder = self if tag in HOLDERS else parent.holder

    def around(self) -> Node:
        """The holder around this one."""
        return self.parent.holder if self.parent else self


@dataclass
class Block:
    text: str
    node: Node  # the innermost tag
    linked: float  # share of characters in links


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks, in order. Malformed markup is read as far as it goes."""
    out: list[Block] = []
    top = root = Node(None, "", "")
    own = root
    opened: dict[str, int] = defaultdict(int)
    pieces: list[str] = []
    linked, link = 0, None  # the tag inside which a link was opened
    at, size = 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append(Block(text, own, min(1.0, linked / len(text))))
        linked = 0

    def leave(to: Node) -> None:
        """`to` and all inside it are closed."""
        nonlocal top, link
        stop = to.parent
        while top is not stop:
            opened[top.tag] -= 1
            if link is top:
                link = None
            top = top.parent

    def say(text: str) -> None:
        nonlocal own, linked
        if not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if not pieces and text.strip():
            own = top
        pieces.append(text)
        if link is not None:
            linked += len(text)

    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            say(page[at:])
            break
        say(page[at:cut])
        m = _TAG.match(page, cut) or _LOOSE.match(page, cut)
        if not m:
            more = page[cut + 1 : cut + 2]
            if more.isalpha() or more in ("/", "!", "?") and more:
                break  # a tag that the page's end cuts off
            say("<")
            at = cut + 1
            continue
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag, rest = tag.lower(), m.group(3)
        if m.group(1):
            if tag in BLOCK:
                close()
            if tag == "a":
                link = None
            n = top if opened[tag] else root
            while n is not root:
                if n.tag == tag:
                    leave(n)
                    break
                if tag not in BLOCK and n.tag in BLOCK:
                    break
                n = n.parent
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            pieces.append(" ")
            continue
        if tag in BLOCK:
            close()
            ends, scopes = ENDS.get(tag, (("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else ("p",), ("td", "th", "li", "div", "article", "section", "blockquote")))
            n = top if any(opened[t] for t in ends) else root
            while n is not root:
                over = n.parent
                if n.tag in ends:
                    leave(n)
                    if tag not in ENDS:
                        break
                elif n.tag in scopes:
                    break
                n = over
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            link = top
            continue
        names = " ".join((a or b or c).lower() for _, a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
        if tag in BLOCK or names:  # other inline tags say nothing of a block
            top = Node(top, tag, names)
            opened[tag] += 1
    close()
    return out


def _step(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


def features(page: list[Block]) -> list[list[str]]:
    """Of each block of a page."""
    words = [b.text.count(" ") + 1 for b in page]
    total = 0.0
    for b, w in zip(page, words):
        h = b.node.holder
        h.words = h.chars = h.linked = 0
        u = h.around()
        u.words = u.chars = u.linked = 0
    for b, w in zip(page, words):
        said, h = w * (1 - b.linked), b.node.holder
        total += said
        for n in {h, h.around()}:
            n.words, n.chars, n.linked = n.words + said, n.chars + len(b.text), n.linked + b.linked * len(b.text)
    size = [min(6, int(math.log2(w + 1))) for w in words]
    out = []
    for i, b in enumerate(page):
        n, h = b.node, b.node.holder
        u = h.around()
        own = [
            *n.marks,
            f"at {n.leaf}",
            f"under {n.under}",
            f"words {size[i]}",
            f"linked {_step(b.linked, 0.05, 0.5)}",
            "ends a sentence" if b.text[-1] in ".!?…:;\"'”»" else "ends open",
            f"commas {min(3, b.text.count(','))}",
            "sign" if "©" in b.text or "®" in b.text else "no sign",
            "first" if not i else "last" if i == len(page) - 1 else "inside",
            f"before {size[i - 1] // 2 if i else '-'}",
            f"after {size[i + 1] // 2 if i + 1 < len(page) else '-'}",
            "all",
        ]
        for k, x in (("held", h), ("around", u)):
            own += [f"{k} {_step(x.words, 8, 20, 50, 120, 300)}", f"{k} linked {_step(x.linked / (x.chars or 1), 0.1, 0.5)}", f"{k} share {_step(x.words / (total or 1), 0.05, 0.2, 0.5)}"]
        out.append(own)
    return out


@dataclass
class Model:
    """weights: of a feature, for article less for other; turn[a][b]: from label a to b."""

    weights: dict[str, float] = field(default_factory=dict)
    turn: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, page: list[Block]) -> list[float]:
        w = self.weights
        return [sum(w.get(f, 0.0) for f in own) for own in features(page)]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi's labels: whether each block is of the article."""
        (nn, ny), (yn, yy) = self.turn
        no = yes = 0.0
        back = []
        for i, s in enumerate(self.scores(page)):
            if i:
                from_no, from_yes = no + nn >= yes + yn, no + ny >= yes + yy
                no, yes = max(no + nn, yes + yn), max(no + ny, yes + yy) + s
                back.append((not from_no, not from_yes))
            else:
                yes = s
        out, now = [], yes > no
        for b in reversed(back):
            out.append(now)
            now = b[now]
        return [*out, now][::-1] if page else []


def _log_sum(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def train(pages: list[tuple[list[Block], list[bool]]], *, rounds: int = 5, rate: float = 0.3, shrink: float = 1e-4, seed: int = 3) -> Model:
    """Gradient ascent (steps by AdaGrad) on the log-likelihood less an L2 penalty."""
    model, rng = Model(), random.Random(seed)
    grown: dict = defaultdict(lambda: 1e-2)
    for _ in range(rounds):
        for blocks_, labels in rng.sample(pages, len(pages)):
            n = len(blocks_)
            if not n:
                continue
            each = features(blocks_)
            s, t = [(0.0, sum(model.weights.get(f, 0.0) for f in x)) for x in each], model.turn
            ahead, behind = [s[0]], [(0.0, 0.0)]
            for i in range(1, n):
                ahead.append(tuple(_log_sum(ahead[-1][0] + t[0][y], ahead[-1][1] + t[1][y]) + s[i][y] for y in (0, 1)))
            for i in range(n - 1, 0, -1):
                behind.append(tuple(_log_sum(behind[-1][0] + t[y][0] + s[i][0], behind[-1][1] + t[y][1] + s[i][1]) for y in (0, 1)))
            behind.reverse()
            z = _log_sum(*ahead[-1])
            grad: dict = defaultdict(float)
            for i in range(n):
                p = math.exp(min(0.0, ahead[i][1] + behind[i][1] - z))
                for f in each[i]:
                    grad[f] += labels[i] - p
                if i:
                    grad[int(labels[i - 1]), int(labels[i])] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            grad[a, b] -= math.exp(min(0.0, ahead[i - 1][a] + t[a][b] + s[i][b] + behind[i][b] - z))
            for f, g in grad.items():
                if isinstance(f, tuple):
                    g -= shrink * model.turn[f[0]][f[1]]
                    grown[f] += g * g
                    model.turn[f[0]][f[1]] += rate * g / math.sqrt(grown[f])
                else:
                    g -= shrink * model.weights.get(f, 0.0)
                    grown[f] += g * g
                    model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(grown[f])
    return model


#: Starts each text of an article on the labelled pages, and is taken off before features are.
_MARK = "\ue000"


def labelled_pages(count: int = 1000, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Pages of varied layout whose article blocks are known, since they are made here. Three in ten are bare: no tag or
    name of theirs tells what it holds; of three in ten more, the article alone is."""
    rng = random.Random(seed)
    bare = half = False

    def words(a: int, b: int) -> str:
        w = ["".join(rng.choice("aeiourstlnmdpkéü") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b))]
        return " ".join(x + "," if rng.random() < 0.08 else x for x in w)

    def sentence(a: int = 1, b: int = 30) -> str:
        return words(a, b).capitalize() + rng.choice("....!?:")

    def prose() -> str:
        return _MARK + " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def link() -> str:
        return f'<a href="/{rng.randint(0, 999)}">{words(1, 4)}</a>'

    def name(*options: str) -> str:
        if bare:
            return rng.choice(["", f' class="{words(1, 1).strip(",")}"', f' class="c{rng.randint(0, 99)} {words(1, 1).strip(",")}"', f' id="{words(1, 1).strip(",")}"'])
        pick_ = rng.choice(options)
        return rng.choice([f' class="{pick_}"', f' class="{pick_} {rng.choice(["wide", "left", "box", words(1, 1).strip(",")])}"', f' id="{pick_}"'])

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.1:
            return f"<h{(h := rng.choice('234'))}>{_MARK}{words(1, 8)}</h{h}>"
        if kind < 0.2:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{_MARK}{rng.choice([words(1, 6), sentence()])}{rng.choice(['</li>', ''])}" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.25:
            return f"<blockquote>{rng.choice(['', '<p>'])}{prose()}</blockquote>"
        if kind < 0.28:
            return f"<pre>{_MARK}{words(3, 20)}</pre>"
        if kind < 0.31:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{_MARK}{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.36:
            return f'<p>{prose()} <a href="#">{words(1, 5)}</a> {words(2, 9)}.</p>'
        if kind < 0.45:
            return f"<p><b>{prose()}<br><p>{prose()}</p>"
        return f"<p>{prose()}{rng.choice(['</p>', '</p>', ''])}"

    def article() -> str:
        nonlocal bare

        was, bare = bare, bare or half
        out = article_()
        bare = was
        return out

    def article_() -> str:
        h = rng.choice(["h1"] * 6 + ["h2", "h3", ""]) if not bare else rng.choice(["h1", "h2", "h3", "", "", "p"])
        title = f"<{h}>{_MARK}{rng.choice([words(1, 12), sentence()])}</{h}>" if h else ""
        body = "".join(paragraph() + (aside() if rng.random() < 0.04 else "") for _ in range(rng.choice([1, 2, 3, 5, 8, 14])))
        if bare:
            if not body or rng.random() < 0.1:
                body += f"<p>{prose()} {prose().removeprefix(_MARK)}</p>"
            inner = f"<div{name()}>{body}</div>" if rng.random() < 0.4 else body
            return rng.choice([f"<div{name()}>{title}{inner}</div>", f"<div{name()}>{title}{inner}</div>", f"<section>{title}{inner}</section>", title + body])
        shape = rng.random()
        if shape < 0.45:
            return f"<article>{title}{body}</article>"
        if shape < 0.55:
            return f"<article><header>{title}</header>{body}</article>"
        if shape < 0.7:
            return f"<main>{title}<section>{body}</section></main>"
        if shape < 0.8:
            return title + body
        return f"<div{name('content', 'post', 'entry', 'story', 'article-body', 'main-text')}>{title}{body}</div>"

    def menu() -> str:
        items = [link() for _ in range(rng.randint(2, 9))]
        if bare:
            return f"<div{name()}>" + rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "".join(f"<p>{x}</p>" for x in items)]) + "</div>"
        inner = rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])
        return rng.choice([f"<nav>{inner}</nav>", f"<nav{name('nav', 'menu')}>{inner}</nav>", f"<div{name('nav', 'menu', 'navbar', 'breadcrumb', 'pagination', 'share', 'social', 'related', 'tags')}>{inner}</div>"])

    def header() -> str:
        if bare:
            return f"<div{name()}>{rng.choice(['', f'<p>{words(1, 4)}</p>', f'<div>{words(1, 5)}</div>'])}{menu()}</div>"
        return f"<header{rng.choice(['', name('header', 'top', 'masthead')])}>{rng.choice(['', f'<h1>{words(1, 3)}</h1>', f'<p>{sentence()}</p>'])}{menu()}</header>"

    def footer() -> str:
        text = rng.choice([f"&copy; {rng.randint(1990, 2030)} {words(1, 4)}", f"&copy; {words(1, 2)} &middot; {sentence()}", sentence(), f"<p>{sentence()}</p><ul><li>{link()}</li></ul>"])
        if bare:
            return f"<div{name()}>{text}</div>"
        return rng.choice([f"<footer>{text}</footer>", f"<div{name('footer', 'copyright', 'legal')}>{text}</div>"])

    def aside() -> str:
        text = rng.choice([sentence(), f"<p>{sentence()}</p>", f"<h3>{words(1, 4)}</h3><p>{sentence()} {sentence()}</p>", f"<p>{sentence()} {link()}</p>"])
        if bare:
            return f"<div{name()}>{rng.choice([sentence(1, 8), f'<p>{words(1, 6)} {link()}</p>', link()])}</div>"
        return rng.choice([f"<aside>{text}</aside>", f"<aside{name('sidebar', 'related')}>{text}</aside>", f"<div{name('ad', 'ads', 'advert', 'sidebar', 'promo', 'banner', 'sponsored', 'widget', 'newsletter', 'subscribe')}>{text}</div>"])

    def notice() -> str:
        text = rng.choice([sentence(), f"<p>{sentence()} {sentence()}</p><button>{words(1, 2)}</button>"])
        return f"<div{name('cookie', 'cookies', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'modal', 'overlay')}>{text}</div>"

    def form() -> str:
        return f"<form{rng.choice(['', name('search', 'login', 'signup')])}><label>{words(1, 3)}</label><input name=q>{rng.choice(['', f'<p>{sentence()}</p>', f'<fieldset><legend>{words(1, 2)}</legend></fieldset>'])}</form>"

    def comments() -> str:
        each = "".join(rng.choice([f"<li>{sentence()}</li>", f"<p>{sentence()} {sentence()}</p>", f"<div class=comment><b>{words(1, 2)}</b><p>{sentence()}</p></div>"]) for _ in range(rng.randint(1, 6)))
        return rng.choice([f"<section{name('comments', 'responses', 'discussion')}><h2>{words(1, 2)}</h2>{each}</section>", f"<div{name('comments', 'comment-list', 'disqus')}>{each}</div>", f"<ol{name('comments', 'commentlist')}>{each}</ol>"])

    def page() -> str:
        nonlocal bare, half

        def some(make, p: float) -> str:
            return make() if rng.random() < p else ""

        kind = rng.random()
        bare, half = kind < 0.3, 0.3 <= kind < 0.6

        before = [some(header, 0.4), some(menu, 0.7), some(notice, 0.3), some(aside, 0.5), some(form, 0.2)]
        after = [some(aside, 0.3), some(menu, 0.2), some(comments, 0 if bare else 0.35), some(form, 0.15), some(notice, 0.1)]
        if rng.random() < 0.25:  # little else is there
            before, after = [], [some(aside, 0.2)]
        rng.shuffle(before), rng.shuffle(after)
        inside = f'{"".join(before)}{article() if rng.random() < 0.95 else ""}{"".join(after)}{some(footer, 0.8)}'
        if rng.random() < 0.3:
            inside = f"<div{name('page', 'wrapper', 'container')}>{inside}</div>"
        if bare and rng.random() < 0.15:  # a table lays the page out
            inside = f"<table><tr><td>{menu()}</td><td>{article()}</td></tr></table>{some(footer, 0.8)}"
        return f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title><script>var t='</p>';</script></head><body>{inside}{rng.choice(['</body></html>', ''])}"

    out = []
    for _ in range(count):
        found = blocks(page())
        labels = [_MARK in b.text for b in found]
        for b in found:
            b.text = " ".join(b.text.replace(_MARK, "").split()) or "-"
        out.append((found, labels))
    return out


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(model: Model, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, model.decode(found)) if keep)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row.

    A page that is null, empty, or has no article gives the empty text. Long pages are read whole. Nulls in page_id or url
    stay; repeated rows give the same each; no rows give none; other columns play no part.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some thousand features
    pages = pick(pages, page_id="page_id", url="url", html="html").selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(sent.value, h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(work, "page_id long, url string, text string, n_chars long")
