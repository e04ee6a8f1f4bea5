"""Labelled pages for the extraction model: layouts with their blocks marked as main text or not.

Pages come from a seeded generator of site layouts.  The words are syllables
without meaning, so the model learns structure and shape of text.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_SYLLABLES = "an be co da er fi go ha in ka lo me no or pa qui re sa to un ve wa é ü ñ ch".split()
# Words that furniture of pages carries.
FURNITURE = {
    "nav": ["Home", "About", "Contact", "News", "Archive", "Log in", "Products", "Blog"],
    "footer": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Powered by"],
    "notice": ["We use cookies", "Accept all", "Subscribe to our newsletter", "Your browser is out of date"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Limited offer"],
    "share": ["Share on", "Tweet", "Print", "E-mail this", "Like"],
    "comment": ["says:", "Reply", "Leave a comment", "Comments", "Report"],
    "form": ["Search", "Your name", "Send", "Subscribe", "E-mail"],
}


class Generator:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(lo, hi)))

    def sentence(self, lo: int = 4, hi: int = 24) -> str:
        w = self.words(lo, hi)
        return w[0].upper() + w[1:] + self.r.choice([".", ".", ".", "!", "?", ""])

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))
        if self.r.random() < 0.2:
            out = out.replace(" ", f" <{(t := self.r.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>", 1) + f"</{t}>"
        if self.r.random() < 0.15:
            out += f' <a href="/{self.r.random()}">{self.words(1, 3)}</a>.'
        if self.r.random() < 0.1:
            out = "<b>" + self.sentence() + "<br>" + out
        return out

    def short(self, kind: str) -> str:
        return self.r.choice(FURNITURE[kind]) if self.r.random() < 0.5 else self.words(1, 4)

    def links(self, kind: str, n: int, tag: str = "ul") -> str:
        item = lambda: f'<a href="/{self.words(1, 1)}">{self.short(kind) if self.r.random() < 0.6 else self.words(1, 9)}</a>'
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(item() for _ in range(n)) if tag == "bar" else "".join(f"<{tag}>{item()}</{tag}>" for _ in range(n))

    def named(self, tag: str, names: list[str]) -> tuple[str, str]:
        """An open and a close tag whose class or id is one of the names, or none."""
        roll = self.r.random()
        name = self.r.choice(names)
        return (f'<{tag} class="{name}">' if roll < 0.6 else f'<{tag} id="{name}">' if roll < 0.9 else f"<{tag}>"), f"</{tag}>"

    def wrapped(self, inside: str, tags: list[str], names: list[str]) -> str:
        a, b = self.named(self.r.choice(tags), names)
        return a + inside + b

    # Furniture: none of it is main text.
    def header(self) -> str:
        return self.wrapped(self.r.choice(["", f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.sentence(3, 9)}</p>"]) + self.links("nav", self.r.randint(2, 5), self.r.choice(["ul", "bar", "div"])), ["header", "header", "div"], ["header", "masthead", "top", "site-header", "banner"])

    def menu(self) -> str:
        return self.wrapped(self.links("nav", self.r.randint(3, 9), self.r.choice(["ul", "ul", "bar", "div"])), ["nav", "nav", "nav", "div"], ["menu", "nav", "navigation", "navbar", "breadcrumbs"])

    def advert(self) -> str:
        text = self.r.choice([self.short("ad"), self.sentence(), self.prose(1, 2)])
        return f"<!-- ad {self.r.randint(0, 99)} -->" * (self.r.random() < 0.3) + self.wrapped(self.r.choice(["{}", "<p>{}</p>", '<a href="/x">{}</a>']).format(text), ["div", "div", "aside", "section"], ["ad", "ad", "ads", "advert", "sponsor", "promo", "banner-ad"])

    def sidebar(self) -> str:
        return self.wrapped(f"<h3>{self.words(1, 3)}</h3>" + self.links("nav", self.r.randint(2, 7)) + self.r.choice(["", f"<p>{self.prose(1, 2)}</p>"]), ["aside", "aside", "div"], ["sidebar", "related", "widget", "side", "trending"])

    def notice(self) -> str:
        return self.wrapped(f"<p>{self.short('notice')} {self.sentence()}</p>" + self.r.choice(["", f"<button>{self.short('notice')}</button>"]), ["div", "section", "aside"], ["cookie", "notice", "cookie-banner", "alert", "popup", "newsletter", "gdpr"])

    def share(self) -> str:
        return self.wrapped(self.links("share", self.r.randint(2, 5), self.r.choice(["ul", "bar", "span"])), ["div"], ["share", "social", "sharing", "tools"])

    def form(self) -> str:
        return f'<form action="/s"><label>{self.short("form")}</label><input name="q"><p>{self.r.choice([self.words(1, 4), self.sentence()])}</p><select><option>{self.words(1, 2)}</option></select><button>{self.short("form")}</button></form>'

    def comments(self) -> str:
        one = lambda: self.wrapped(f"<b>{self.words(1, 2)}</b> <span>{self.short('comment')}</span><p>{self.prose(1, 3)}</p>", ["div", "li", "article"], ["comment", "comment-body", "reply", "response"])
        return self.r.choice(['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<section id="discussion" class="comments">']) + f"<h3>{self.r.randint(2, 40)} {self.short('comment')}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))) + "\0"

    def footer(self) -> str:
        return self.wrapped(self.r.choice([self.short("footer"), "&copy; " + self.words(1, 3), self.prose(1, 2), f"<p>{self.short('footer')}</p>" + self.links("footer", 3, "bar"), f"<p>&copy; {self.sentence()}</p>"]), ["footer", "footer", "footer", "div"], ["footer", "site-footer", "bottom", "legal", "copyright"])

    def section_end(self, s: str) -> str:
        return s.replace("\0", "</section>" if s.startswith("<section") else "</div>")

    def main_block(self) -> str:
        return self.r.choice([lambda: f"<p>{self.prose()}</p>"] * 10 + [lambda: f"<p>{self.prose()}"] * 2 + [lambda: f"<p>{self.sentence(1, 4)}</p>"] * 2 + [lambda: f"<p>{self.words(1, 4)}</p>", lambda: f"<h2>{self.words(1, 7)}</h2>", lambda: "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 4))) + "</ul>", lambda: f"<blockquote><p>{self.prose(1, 2)}</p></blockquote>", lambda: f"<pre>{self.words(4, 20)}</pre>", lambda: f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 5)}</td></tr></table>", lambda: f"<figure><figcaption>{self.sentence()}</figcaption></figure>", lambda: f"<div>{self.prose()}</div>"])()

    def article(self) -> list[tuple[str, bool]]:
        """Pieces of the article: markup, and whether its text is main."""
        title = f"<h1>{self.words(2, 9)}</h1>"
        title = self.r.choice([title, title, f"<header>{title}</header>", f'<div class="title">{title}</div>', ""])
        out = [(title, True)]
        for _ in range(self.r.choice([1, 2, 4, 8, 14])):
            out.append((self.main_block(), True))
            if self.r.random() < 0.1:
                out.append((self.r.choice([self.advert, self.share, self.notice, self.form, self.sidebar])(), False))
        if self.r.random() < 0.3:
            out.append((f"<p>{self.sentence(1, 4)}</p>", True))
        if self.r.random() < 0.25:
            out.append((self.section_end(self.comments()), False))
        return out

    def page(self) -> list[tuple[str, bool]]:
        kind = self.r.random()
        wraps = [("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post entry-content">', "</div>"), ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div itemprop="articleBody">', "</div>"), ("<div><div>", "</div></div>"), ("<td>", "</td>")]
        a, b = self.r.choice(wraps)
        lead = [f for f, p in ((self.header, 0.4), (self.menu, 0.8), (self.notice, 0.25), (self.advert, 0.45), (self.form, 0.2), (self.sidebar, 0.15)) if self.r.random() < p]
        tail = [f for f, p in ((self.share, 0.2), (lambda: self.section_end(self.comments()), 0.3), (self.sidebar, 0.35), (self.advert, 0.2), (self.notice, 0.15), (self.menu, 0.1), (self.footer, 0.9)) if self.r.random() < p]
        pieces: list[tuple[str, bool]] = [(f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>' + '<div class="page">' * (kind < 0.3), False)]
        pieces += [(f(), False) for f in lead]
        pieces += [(a, False), *self.article(), (b, False)]
        pieces += [(f(), False) for f in tail]
        pieces.append(("</body></html>", False))
        return pieces


def labelled_pages(n: int, seed: int = 5) -> list[list[tuple[str, bool]]]:
    """n pages, each a list of pieces of markup and whether their text is main."""
    g: Callable[[], list[tuple[str, bool]]] = Generator(seed).page
    return [g() for _ in range(n)]
