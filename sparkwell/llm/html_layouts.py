"""Labelled pages to learn from: texts of sampled pages in invented layouts.

The corpus has no labels for blocks. A layout is drawn (which elements, which
names, which order, how damaged), texts are set into it, and each text carries a
mark that tells whether it was set as the article; the mark goes once the page has
been cut into blocks.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from html import escape

from .html_blocks import Block, blocks

#: A private character before each text of an article.
MARK = "\ue000"

# What authors of pages call the parts of a page.
ARTICLE_NAMES = "article post entry content story body text main single prose copy hentry".split()
NEUTRAL_NAMES = "container wrapper row col inner layout grid page site wrap outer box".split()
ROLES = {
    "menu": ("nav div ul section", "nav menu navbar navigation breadcrumb breadcrumbs topnav links tabs skip"),
    "header": ("header div section", "header masthead top topbar branding logo banner tagline head"),
    "footer": ("footer div section", "footer bottom colophon copyright legal credits foot"),
    "sidebar": ("aside div section", "sidebar aside related widget recent popular rail secondary more trending tags share social author"),
    "notice": ("div section dialog aside p", "cookie consent notice gdpr alert popup modal privacy message overlay disclaimer paywall"),
    "advert": ("div aside section p", "ad ads advert advertisement sponsor sponsored promo promotion banner adsense outbrain"),
    "form": ("form div section", "form newsletter subscribe signup login search contact register poll"),
    "comments": ("section div ol ul", "comments comment commentlist replies reply discussion respond disqus thread responses"),
}
TOLD = [names for _, names in ROLES.values()]
CUES = {
    "menu": "Home|About|Contact|News|Menu|Skip to content|Archive",
    "header": "Welcome|Daily news|The official site",
    "footer": "© 2024|All rights reserved.|Terms of use|Imprint|Privacy policy",
    "sidebar": "Related|Read more|Popular|Recent posts|Share this|Tags|You may also like",
    "notice": "We use cookies.|This site uses cookies to improve your visit.|Accept|Please enable scripts.|You have free articles left.",
    "advert": "Advertisement|Sponsored|Ad|Buy now|Special offer",
    "form": "Subscribe|Your email|Search|Log in|Sign up for our newsletter|Submit",
    "comments": "Comments|Leave a reply|3 comments|Reply|says:|Posted by|Log in to comment",
}


class Texts:
    """Texts to set: prose and short ones of the sampled pages, mixed with invented ones."""

    def __init__(self, rng: random.Random, sampled: Sequence[Block]) -> None:
        self.rng = rng
        self.prose = [b.text for b in sampled if not b.linked and b.text.count(" ") >= 4]
        self.short = [b.text for b in sampled if b.linked or b.text.count(" ") < 4]

    def invented(self, words: int) -> str:
        made = ["".join(self.rng.choice("bcdfglmnprstv") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 3))) for _ in range(words)]
        return (" ".join(made) + self.rng.choice([".", ".", "?", ""])).capitalize()

    def long(self) -> str:
        if self.prose and self.rng.random() < 0.8:
            words = self.rng.choice(self.prose).split()
            return " ".join(words[: self.rng.choice([8, 15, 30, 60, 400])])
        return self.invented(self.rng.randint(4, 60))

    def brief(self) -> str:
        if self.short and self.rng.random() < 0.5:
            return " ".join(self.rng.choice(self.short).split()[:6])
        if self.prose and self.rng.random() < 0.6:
            return " ".join(self.rng.choice(self.prose).split()[: self.rng.randint(1, 5)])
        return self.invented(self.rng.randint(1, 4))


class Layout:
    """One page: ``names`` says whether elements are told by their tags, their classes, both, or by neither."""

    def __init__(self, rng: random.Random, texts: Texts) -> None:
        self.rng, self.texts = rng, texts
        self.names = rng.choice(["tags"] * 3 + ["classes"] * 3 + ["both"] * 4 + ["neither"])
        self.closes = rng.random() < 0.85

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def attribute(self, names: str | list[str], told: bool = False) -> str:
        """``told``: no tag says what the element is, so that its class must, unless nothing does."""
        names = names.split() if isinstance(names, str) else names
        if self.names == "neither":
            return f' class="{self.texts.invented(1)[:5]}{self.rng.randint(0, 99)}"' if self.chance(0.6) else ""
        if self.names == "tags" and not told:
            return ""
        value = self.rng.choice(names)
        if self.chance(0.4):
            other = self.rng.choice(NEUTRAL_NAMES + ["js", "c", "u", "block", "area", "list", "wrap"])
            joint = self.rng.choice(["-", "_", "__", " "])
            value = self.rng.choice([f"{value}{joint}{other}", f"{other}{joint}{value}", f"{other}{value.capitalize()}"])
        if self.chance(0.2):
            value = f"{value} {self.texts.invented(1)[:4].strip('.?')}"
        return f' {self.rng.choice(["class", "class", "id"])}="{value}"'

    def element(self, tags: str, names: str | list[str], inner: str) -> str:
        tag = "div" if self.names in ("classes", "neither") else self.rng.choice(tags.split()[:1] * 2 + tags.split()) if self.names == "both" else tags.split()[0]
        return f"<{tag}{self.attribute(names, tag in ('div', 'section') and names in TOLD)}>{inner}</{tag}>"

    def inline(self, text: str, mark: str = "") -> str:
        words = [escape(w, quote=self.chance(0.5)) for w in text.split()] or ["x"]
        if self.chance(0.25):
            i = self.rng.randrange(len(words))
            tag = self.rng.choice(["b", "em", "i", "span", "strong", "code", "a href='/x'"])
            words[i] = f"<{tag}>{words[i]}" + (f"</{tag.split()[0]}>" if self.closes else "")
        joint = "<br>" if self.chance(0.05) else " "
        return mark + words[0] + "".join((joint if i == 3 else " ") + w for i, w in enumerate(words[1:], 1))

    def paragraph(self, text: str, mark: str = "", tag: str = "p") -> str:
        return f"<{tag}>{self.inline(text, mark)}" + (f"</{tag}>" if self.closes or tag != "p" else "")

    def links(self, n: int) -> str:
        one = lambda: f'<a href="/{self.rng.randint(0, 999)}">{escape(self.texts.brief())}</a>'
        kind = self.rng.choice(["ul", "ul", "div", "p", "inline"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<{kind}>{one()}</{kind}>" for _ in range(n)) if kind != "inline" else " | ".join(one() for _ in range(n))

    def cue(self, role: str) -> str:
        return escape(self.rng.choice(CUES[role].split("|"))) if self.chance(0.5) else escape(self.texts.brief())

    def role(self, role: str) -> str:
        """A part of the page that is no article."""
        t, few = self.texts, self.rng.randint(1, 4)
        plain = self.names == "neither"  # then only its shape tells what a part is
        if role == "menu":
            inner = self.links(self.rng.randint(3, 9))
        elif role == "header":
            inner = f"<{(h := self.rng.choice(['h1', 'div', 'p', 'span']))}>{self.cue(role)}</{h}>" + (self.paragraph(t.brief()) if self.chance(0.4) else "") + (self.role("menu") if self.chance(0.3) else "")
        elif role == "footer":
            said = f"&copy; {escape(t.brief())} &middot; {escape(t.long() if self.chance(0.4) and not plain else t.brief())}"
            inner = (said if self.chance(0.5) else self.paragraph(self.texts.brief()) + f"<p>{said}</p>") + (self.links(few) if self.chance(0.4) else "")
        elif role == "sidebar":
            inner = f"<h3>{self.cue(role)}</h3>" + (self.links(few + 2) if plain or self.chance(0.5) else "".join(self.paragraph(t.long()) for _ in range(few)))
        elif role == "notice":
            inner = self.rng.choice([self.cue(role), self.paragraph(t.long() if not plain else t.brief()), f"<p>{self.cue(role)} {escape(t.brief() if plain else t.long())}</p>"]) + (f"<button>{self.cue(role)}</button>" if self.chance(0.5) else "")
        elif role == "advert":
            inner = self.rng.choice([escape(t.brief() if plain else t.long()), f'<a href="/ad">{escape(t.brief())}</a>', self.paragraph(t.brief() if plain else t.long()), f"<span>{self.cue(role)}</span>"])
        elif role == "form":
            inner = f"<label>{self.cue(role)}</label><input name=q>" + (self.paragraph(t.brief() if plain else t.long()) if self.chance(0.5) else "") + f"<button>{self.cue(role)}</button>"
            inner = inner if self.names == "tags" or self.chance(0.3) else f"<form>{inner}</form>"
        else:
            said = lambda: self.paragraph(t.long()) + (self.paragraph(t.long()) if self.chance(0.2) else "")
            one = lambda: self.element("div article li", ROLES["comments"][1], (f"<span>{escape(t.brief())}</span> " if self.chance(0.4) else f"<div>{escape(t.brief())} {self.cue(role)}</div>") + said())
            inner = (f"<h3>{self.cue(role)}</h3>" if self.chance(0.7) else "") + "".join(one() if self.names != "tags" else said() for _ in range(few))
            if self.names in ("tags", "neither"):  # nothing but such a heading tells them
                inner = f"<h3>{escape(self.rng.choice(CUES['comments'].split('|')))}</h3>" + inner
        tags, names = ROLES[role]
        return self.element(tags, names, inner)

    def article(self) -> str:
        t, out = self.texts, []
        if self.chance(0.85):
            out.append(self.paragraph(t.long() if self.chance(0.2) else t.brief(), MARK, "h1"))
        for _ in range(self.rng.choice([1, 2, 4, 8, 16])):
            kind = self.rng.random()
            if kind < 0.75:
                out.append(self.paragraph(t.long() if self.chance(0.85) else t.brief(), MARK))
            elif kind < 0.83:
                out.append(self.paragraph(t.brief(), MARK, self.rng.choice(["h2", "h3"])))
            elif kind < 0.89:
                out.append("<ul>" + "".join(self.paragraph(t.brief() if self.chance(0.5) else t.long(), MARK, "li") for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                tag = self.rng.choice(["blockquote", "pre", "div", "figcaption"])
                out.append(self.paragraph(t.long(), MARK, tag))
            elif kind < 0.97:
                out.append("<table><tr>" + "".join(self.paragraph(t.brief(), MARK, "td") for _ in range(4)) + "</tr></table>")
            elif self.names != "neither":
                out.append(self.role(self.rng.choice(["advert", "sidebar", "form", "notice"])))
        if not any(MARK in x for x in out):
            out.append(self.paragraph(t.long(), MARK))
        inner = "\n".join(out) if self.chance(0.5) else "".join(out)
        for _ in range(self.rng.choice([0, 1, 1, 1, 2])):
            inner = self.element("article main section", ARTICLE_NAMES, inner)
        return inner

    def page(self) -> str:
        head = [r for r in ("notice", "header", "menu", "advert", "sidebar", "form") if self.chance({"header": 0.6, "menu": 0.7}.get(r, 0.25))]
        tail = [r for r in ("comments", "sidebar", "advert", "form", "menu", "notice", "footer") if self.chance({"footer": 0.8, "comments": 0.45, "menu": 0.1}.get(r, 0.25))]
        if self.chance(0.3):
            self.rng.shuffle(head)
        parts = [self.role(r) for r in head]
        main = self.article()
        rest = [self.role(r) for r in tail]
        if tail[:1] == ["comments"] and self.chance(0.2):
            main += rest.pop(0)
        middle = [main]
        if self.chance(0.3):
            middle = [f"<div{self.attribute(NEUTRAL_NAMES)}>", *middle, *rest[:1], "</div>"]
            rest = rest[1:]
        inner = "".join([*parts, *middle, *rest])
        if self.chance(0.3):
            inner = f"<div{self.attribute(NEUTRAL_NAMES)}>{inner}</div>"
        html = f"<!DOCTYPE html><html><head><title>{escape(self.texts.brief())}</title><style>p{{margin:0}}</style></head><body>{inner}"
        return html if self.chance(0.1) else html + "</body></html>"


def labelled_pages(sampled: Sequence[Block], n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: article) of ``n`` pages in layouts of their own."""
    rng = random.Random(seed)
    texts, out = Texts(rng, [b for b in sampled if MARK not in b.text]), []
    for i in range(n):
        html = Layout(rng, texts).page() if i % 50 else "".join(f"{MARK}{escape(texts.long())}<p>" for _ in range(rng.randint(1, 4)))
        found = blocks(html)
        out.append(([b._replace(text=b.text.replace(MARK, "")) for b in found], [int(MARK in b.text) for b in found]))
    return out
