"""Labelled training pages: layouts of many kinds, filled with the words of a given page.

Marks: ``data-main="1"`` on what begins main text, ``data-main="0"`` on what begins something else (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments). Names of classes are drawn from usual ones, or are meaningless, so a model must
also go by names of elements, lengths and links.
"""

from __future__ import annotations

import random
import re
import zlib
from html import escape

PER_PAGE = 4
# Class names in wide use on web pages.
USUAL = {
    "main": "content post-content entry-content article-body article story post main-content body-text entry text page-content article__body".split(),
    "header": "header site-header masthead top-bar branding page-header".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu topnav toc".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot adbox sponsor".split(),
    "notice": "cookie-notice cookie-banner notice alert consent gdpr popup newsletter-signup subscribe warning-bar".split(),
    "side": "sidebar side aside related related-posts widget recommended more-stories popular rail".split(),
    "comments": "comments comment-list reader-comments discussion responses comment-section".split(),
    "footer": "footer site-footer page-footer copyright bottom legal".split(),
    "share": "share social share-buttons tags meta byline author-box".split(),
}
INLINE = ("b", "em", "i", "strong", "span", "code", "u")


class Writer:
    def __init__(self, words: list[str], seed: int):
        self.words, self.rng = words, random.Random(seed)
        self.closed = self.rng.random() < 0.75  # paragraphs and items have end tags
        self.named = self.rng.random() < 0.8

    def some(self, low: int, high: int) -> str:
        return escape(" ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))), quote=self.rng.random() < 0.5)

    def sentence(self, low: int = 1, high: int = 22) -> str:
        said = self.some(low, high)
        return said[:1].upper() + said[1:] + self.rng.choice("....!?")

    def prose(self, low: int = 1, high: int = 7, inline: float = 0.2) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            s = self.sentence()
            if self.rng.random() < inline:
                name = self.rng.choice(INLINE)
                s = self.rng.choice([f"<{name}>{s}</{name}>", f'<a href="/{self.rng.randrange(99)}">{s}</a>', f"{s}<br>", f"<{name}>{s}"])
            out.append(s)
        return self.rng.choice([" ", "\n"]).join(out)

    def attribute(self, kind: str | None) -> str:
        if kind is None or not self.named or self.rng.random() < 0.15:
            return f' class="{self.rng.choice("abcxyz")}{self.rng.randrange(99)}"' if self.rng.random() < 0.3 else ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(USUAL[kind])}"'

    def box(self, names: str, kind: str | None, main: int | None, inside: str) -> str:
        name = self.rng.choice(names.split())
        mark = "" if main is None else f' data-main="{main}"'
        return f"<{name}{self.attribute(kind)}{mark}>{inside}</{name}>"

    def p(self, inside: str, name: str = "p") -> str:
        return f"<{name}>{inside}" + (f"</{name}>" if self.closed or name not in ("p", "li") else "")

    def links(self, low: int = 2, high: int = 8) -> str:
        items = [f'<a href="/{self.rng.randrange(99)}">{self.some(1, 4)}</a>' for _ in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(self.p(x, "li") for x in items) + "</ul>" if self.rng.random() < 0.7 else self.rng.choice([" | ", " ", " &middot; "]).join(items)

    # what is not main text
    def nav(self) -> str:
        return self.box("nav nav div ul", "nav", 0, self.links())

    def header(self) -> str:
        return self.box("header div", "header", 0, self.rng.choice(["", f"<h1>{self.some(1, 4)}</h1>", f"<h2>{self.some(1, 3)}</h2>", f"<p>{self.some(1, 6)}</p>"]) + (self.links() if self.rng.random() < 0.5 else self.some(1, 6)))

    def ad(self) -> str:
        body = self.prose(1, 3, 0.1)
        return self.box("div div div aside section p" if "<p" not in body else "div aside", "ad", 0, self.rng.choice([body, body, f"<p>{body}</p>", f"<a href=/x>{body}</a>", f"<h3>{self.some(1, 4)}</h3>{body}"]))

    def notice(self) -> str:
        return self.box("div div aside section", "notice", 0, self.rng.choice(["", "<p>"]) + self.prose(1, 3, 0.1) + f' <button>{self.some(1, 2)}</button>')

    def side(self) -> str:
        return self.box("aside aside div section", "side", 0, f"<h3>{self.some(1, 4)}</h3>" + self.rng.choice([self.links(), self.links(), f"<p>{self.prose(1, 3)}</p>"]))

    def comments(self) -> str:
        one = lambda: self.box("div li article section", "comments", None, f"<b>{self.some(1, 2)}</b> <p>{self.prose(1, 4)}</p>")
        body = f"<h3>{self.some(1, 3)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 5)))
        return f'<{(n := self.rng.choice(["section", "div", "div"]))} {self.rng.choice(["class", "id"])}="{self.rng.choice(USUAL["comments"])}" data-main="0">{body}</{n}>'

    def footer(self) -> str:
        return self.box("footer footer div", "footer", 0, self.rng.choice([f"<p>&copy; {self.some(1, 6)}</p>", f"&copy; {self.some(1, 8)} &middot; {self.some(1, 6)}", self.prose(1, 3), self.links()]))

    def share(self) -> str:
        return self.box("div ul p", "share", 0, self.links(1, 4) if self.rng.random() < 0.7 else self.some(1, 5)) if self.named else ""

    def form(self) -> str:
        return f'<form data-main="0"><label>{self.some(1, 3)}</label><input name=q><button>{self.some(1, 2)}</button></form>'

    # main text
    def article(self) -> list[str]:
        r, out = self.rng, []
        for _ in range(r.choice([1, 2, 4, 8, 16])):
            kind = r.random()
            if kind < 0.8:
                out.append(self.p(self.prose(1, r.choice([1, 2, 8]))))
            elif kind < 0.86:
                out.append(f"<h{(h := r.randint(2, 4))}>{self.some(1, 7)}</h{h}>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(self.p(self.sentence(), "li") for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote>{self.prose(1, 3)}</blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{self.some(3, 20)}</pre>")
            elif kind < 0.98:
                out.append("<table>" + "".join(f"<tr><td>{self.some(1, 4)}</td><td>{self.some(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{self.some(2, 10)}</figcaption></figure>")
        if r.random() < 0.85:
            title = f"<h1>{self.some(1, 10)}</h1>"
            out.insert(0, title if r.random() < 0.85 else f"<header>{title}</header>")
        return out

    def page(self) -> str:
        r = self.rng
        maybe = lambda share, *parts: [x() for x in parts if r.random() < share]
        inner = self.article()
        for extra in maybe(0.12, self.ad, self.share, self.side, self.form, self.notice, self.nav):
            inner.insert(r.randint(0, len(inner)), extra)
        text = "".join(inner)
        how = r.random()
        if how < 0.45:
            main = f'<article{self.attribute("main") if r.random() < 0.4 else ""} data-main="1">{text}</article>'
        elif how < 0.6:
            main = f'<main{self.attribute("main") if r.random() < 0.4 else ""} data-main="1">{text}</main>'
        elif how < 0.85:
            main = self.box("div div section", "main", 1, text)
        elif how < 0.9:
            main = f'<table><tr><td data-main="0">{self.links()}</td><td data-main="1">{text}</td></tr></table>'
        else:  # no wrapper: each element is marked
            main = "".join(re.sub(r"^<(\w+)", r'<\1 data-main="1"', x) if "data-main" not in x[:90] else x for x in inner)
        before = maybe(0.5, self.header, self.nav, self.ad, self.notice)
        after = maybe(0.4, self.side, self.ad, self.comments, self.share, self.form, self.notice) + maybe(0.8, self.footer)
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        if r.random() < 0.25:
            before, after = before + [x for x in after if "<aside" in x], [x for x in after if "<aside" not in x]
        middle = main
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            middle = f"<{(n := r.choice(['div', 'div', 'main', 'section']))}>{middle}</{n}>"
            if r.random() < 0.5 and after:
                middle = middle.removesuffix(f"</{n}>") + after.pop(0) + f"</{n}>"
        head = f"<head><title>{self.some(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        end = "" if r.random() < 0.15 else "</body></html>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {self.some(1, 3)} -->{middle}{''.join(after)}{end}"


def layouts(html: str, count: int = PER_PAGE) -> list[str]:
    """count labelled pages of the words of a page; none if it has none."""
    plain = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[#\w]*;?", " ", html, flags=re.S)
    words = plain.split()
    seed = zlib.crc32(html.encode("utf-8", "surrogatepass"))
    return [Writer(words, seed + k).page() for k in range(count)] if words else []
