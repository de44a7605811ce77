"""Invented web pages with known main text, which the page model is trained on."""

from __future__ import annotations

import random

import numpy as np

from .html import BoostedTrees, Page

_PARTS = "ka lo mi ren tos vel dar shi on en qua bri st er al po nu fi gra".split()
#: Marks the runs of the main text while a page is made; no page has it.
_IN = ""


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_PARTS) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 22).capitalize() + self.r.choice([".", ".", "!", "?", ""]) for _ in range(self.r.randint(low, high)))

    def attr(self, *names: str) -> str:
        if self.r.random() < 0.12 or not names:
            return ""
        name = self.r.choice(names)
        if self.r.random() < 0.4:
            name = f"{self.word()}-{name}" if self.r.random() < 0.5 else f"{name}-{self.word()}"
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        form = self.r.randrange(4)
        if form < 2:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(items) if form == 2 else "".join(f"<div>{i}</div>" for i in items)

    def hide(self, element: str, chance: float) -> str:
        """The element, by chance hidden as scripts hide what they show later."""
        if self.r.random() >= chance or not element.startswith("<"):
            return element
        end = next(k for k, c in enumerate(element) if c in " >")
        return f"{element[:end]} {self.r.choice(['hidden', 'aria-hidden=true', 'style=display:none'])}{element[end:]}"

    def clutter(self, kind: str) -> str:
        return self.hide(self.shown(kind), 0.15 if kind == "notice" else 0.03)

    def shown(self, kind: str) -> str:
        r = self.r
        short = lambda: self.sentences(1, 3)
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            body = self.links(3, 10)
            return f"<{tag}{self.attr('nav', 'menu', 'navbar', 'breadcrumb', 'main-nav', 'pagination')}>{body}</{tag}>"
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            return f"<{tag}{self.attr('header', 'site-header', 'masthead', 'branding', 'logo')}>{r.choice(['', f'<h1>{self.words(1, 4)}</h1>', f'<p>{self.words(2, 8)}</p>'])}{self.words(1, 6)}{self.links(0, 5)}</{tag}>"
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            return f"<{tag}{self.attr('footer', 'copyright', 'site-footer', 'legal')}>{r.choice(['&copy; ', '© ', ''])}{short()} {self.links(0, 4)}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div"])
            box = lambda: f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(2, 7), f"<p>{short()}</p>", f"<p>{self.sentences(2, 5)}</p>"])
            return f"<{tag}{self.attr('sidebar', 'widget', 'side', 'widget-area', 'rail')}>{''.join(box() for _ in range(r.randint(1, 3)))}</{tag}>"
        if kind == "advert":
            tag = r.choice(["div", "div", "aside", "section", "p"])
            name = r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"])
            return f'<{tag} class="{name}">{short()}{r.choice(["", self.links(1, 2)])}</{tag}>'
        if kind == "notice":
            tag = r.choice(["div", "div", "section", "aside", "dialog", "p"])
            name = r.choice(["cookie", "cookie-banner", "notice", "consent", "alert", "popup", "newsletter", "gdpr-notice", "subscribe"])
            return f'<{tag} {r.choice(["class", "id"])}="{name}">{r.choice([short(), f"<p>{short()}</p>"])}{r.choice(["", "<button>ok</button>"])}</{tag}>'
        if kind == "form":
            return f"<form{self.attr('form', 'search', 'login', 'contact')}><label>{self.words(1, 4)}</label><input type=text><p>{self.words(2, 12)}</p>{r.choice(['', '<textarea>x</textarea>'])}<button>{self.word()}</button></form>"
        if kind == "comments":
            tag = r.choice(["section", "div", "div", "ol", "ul", "aside"])
            name = r.choice(["comments", "comment-list", "comment", "responses", "discussion", "reader-comments", "disqus_thread", "reviews"])
            one = lambda: r.choice([f'<div class="comment"><b>{self.word()}</b><p>{self.sentences(1, 4)}</p></div>', f"<p>{self.sentences(1, 5)}</p>", f"<article><p>{self.sentences(1, 4)}</p></article>", f"<div>{self.sentences(1, 4)}</div>"])
            items = [f"<li>{one()}</li>" if tag in ("ol", "ul") else one() for _ in range(r.randint(1, 6))]
            head = "" if tag in ("ol", "ul") else r.choice(["", f"<h2>{self.words(1, 3)}</h2>"])
            return f'<{tag} {r.choice(["class", "id"])}="{name}">{head}{"".join(items)}</{tag}>'
        tag = r.choice(["div", "section", "ul"])
        name = r.choice(["related", "share", "social", "recommended", "tags", "more-stories", "share-buttons"])
        body = self.links(2, 6) if tag != "ul" else "".join(f'<li><a href="#">{self.words(1, 5)}</a></li>' for _ in range(4))
        return f'<{tag} class="{name}">{r.choice(["", f"<h4>{self.words(1, 3)}</h4>"]) if tag != "ul" else ""}{body}</{tag}>'

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{_IN}{self.words(2, 12)}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.12 else title)
        plain = r.random() < 0.1
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            roll = r.random()
            long = self.sentences(1, 2) if r.random() < 0.3 else self.sentences(2, 9)
            if r.random() < 0.15:
                w = long.split()
                w[len(w) // 2] = f'<a href="#">{w[len(w) // 2]}</a>'
                long = " ".join(w)
            if plain or roll < 0.04:
                out.append(f"<div>{_IN}{long}</div>")
            elif roll < 0.72:
                out.append(r.choice([f"<p>{_IN}{long}</p>", f"<p>{_IN}{long}</p>", f"<p>{_IN}{long}", f"<p><b>{_IN}{self.words(2, 9)}.<br>"]))
            elif roll < 0.8:
                level = r.choice([2, 3, 4])
                out.append(f"<h{level}>{_IN}{self.words(1, 8)}</h{level}>")
            elif roll < 0.87:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{_IN}{self.sentences(1, 2) if r.random() < 0.6 else self.words(1, 6)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif roll < 0.91:
                out.append(f"<blockquote>{r.choice([f'<p>{_IN}{long}</p>', _IN + long])}</blockquote>")
            elif roll < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_IN}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif roll < 0.97:
                out.append(f"<figure><img src=x><figcaption>{_IN}{self.words(3, 12)}</figcaption></figure>")
            else:
                out.append(f"<pre>{_IN}{self.words(4, 20)}</pre>")
            if r.random() < 0.06:
                out.append(self.clutter(r.choice(["advert", "advert", "related", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.content()
        if r.random() < 0.15:
            body += self.clutter(r.choice(["related", "comments", "advert"]))
        wrap = r.randrange(7)
        if wrap < 3:
            body = f"<article{self.attr('post', 'entry', 'article', 'story') if r.random() < 0.5 else ''}>{body}</article>"
        elif wrap == 3:
            body = f"<main>{r.choice([body, f'<article>{body}</article>', f'<section>{body}</section>'])}</main>"
        elif wrap < 6:
            body = f"<div{self.attr('content', 'post', 'entry-content', 'article-body', 'story', 'text', 'main', 'page-content')}>{body}</div>"
        body = self.hide(body, 0.02) if wrap < 6 else body
        kinds = ["nav", "header", "advert", "notice", "form", "side", "related"]
        before = [self.clutter(r.choice(kinds)) for _ in range(r.randint(0, 4))]
        after = [self.clutter(r.choice(["comments", "comments", "side", "related", "advert", "form", "notice", "nav"])) for _ in range(r.randint(0, 4))]
        if r.random() < 0.85:
            after.append(self.clutter("footer"))
        inner = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            inner = f"<div{self.attr('container', 'wrapper', 'page')}>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{inner}</body></html>"


def labelled_nodes(html: str) -> tuple[Page, np.ndarray]:
    """A made page without its marks, and for each node whether main text lies in it."""
    page = Page(html)
    y = np.zeros(len(page.tags), dtype=bool)
    runs = []
    for node, run, links in page.runs:
        if _IN in run:
            y[node] = True
        runs.append((node, run.replace(_IN, ""), links))
    page.runs = runs
    for k in range(len(y) - 1, 0, -1):
        y[page.parents[k]] |= y[k]
    return page, y


def train(pages: int = 600, seed: int = 1, **options) -> BoostedTrees:
    """The page model, from ``pages`` invented pages: the same at every call."""
    maker = Maker(seed)
    made = [labelled_nodes(maker.page()) for _ in range(pages)]
    return BoostedTrees(**options).fit(np.vstack([p.features() for p, _ in made]), np.concatenate([y for _, y in made]))
