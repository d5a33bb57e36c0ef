"""Labelled pages for the extractor's training: invented text in varied page layouts.

Each page is written by a small generator that knows which blocks belong to
the article; those carry a private-use character in front, which is taken off
after reading, so labels come through the same reader as real pages.
"""

from __future__ import annotations

import random

from riskgrid.llm.html_blocks import Block, blocks

MARK = ""

_SYLLABLES = "an be co da en fi ga hi in jo ka le mi no on pa que ra se ti un ve wa ier sch ment ción er th ing ö é ñ ß".split()
_ENDS = [".", ".", ".", ".", "!", "?", "", ".***", "###", "%%%", "|", "!!"]
#: Words that menus, notices and the like use.
_SERVICE = {
    "nav": "home about contact news sports archive menu search login products blog".split(),
    "footer": "copyright &copy; all rights reserved privacy policy terms imprint &middot;".split(),
    "notice": "we use cookies accept consent settings notice this site uses privacy".split(),
    "advert": "advertisement sponsored buy now sale offer promo".split(),
    "form": "name email subscribe send submit password search newsletter".split(),
    "comments": "reply comments posted says comment likes ago user".split(),
    "aside": "related popular recent posts tags more trending share follow".split(),
}
_MAIN_CLASSES = ["content", "post", "entry-content", "article-body", "story", "mainContent", "post-body", "text", "page-content", ""]
_OTHER = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "navigation", "topnav"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "foot"],
    "notice": ["cookie-notice", "notice", "alert", "banner", "consent", "gdpr", "warning"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot"],
    "form": ["form", "newsletter", "signup", "search-form", "subscribe", "login"],
    "comments": ["comments", "comment-list", "commentArea", "discussion", "replies", "comment"],
    "aside": ["sidebar", "related", "widget", "side-column", "share", "social", "popular", "tags"],
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "notice": ["div", "section", "aside", "p"], "advert": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "aside": ["aside", "div", "section"]}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        w = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w.capitalize() if self.r.random() < 0.1 else w

    def sentence(self, low: int = 1, high: int = 60) -> str:
        n = min(self.r.randint(low, high), self.r.randint(low, high))
        return " ".join(self.word() for _ in range(n)) + self.r.choice(_ENDS)

    def service(self, kind: str) -> str:
        own = _SERVICE.get(kind, _SERVICE["nav"])
        if self.r.random() < 0.45:
            return self.sentence(1, 14)
        return " ".join(self.r.choice(own) if self.r.random() < 0.6 else self.word() for _ in range(self.r.randint(1, 9)))

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h{r.choice('112')}>{MARK}{self.sentence(1, 14)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            text = self.sentence(1, 90)
            if r.random() < 0.3:
                text = text.replace(" ", " <b>", 1) + ("</b>" if r.random() < 0.7 else "")
            if r.random() < 0.2:
                text = f'{text} <a href="/{self.word()}">{self.word()}</a> {self.sentence(1, 20)}'
            if r.random() < 0.15:
                text = text.replace(" ", "<br>", 1)
            if kind < 0.68:
                close = "</p>" if r.random() < 0.85 else ""
                out.append(f"<p>{MARK}{text}{close}")
            elif kind < 0.76:
                out.append(f"<h{r.choice('23')}>{MARK}{self.sentence(1, 8)}</h2>".replace("</h2>", "</h2>"))
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(1, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{MARK}{text}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.sentence(1, 6)}</td><td>{MARK}{self.sentence(1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{MARK}{text}</pre>")
            else:
                out.append(self.other(r.choice(["advert", "aside", "notice", "form"])))
        return "".join(out)

    def other(self, kind: str) -> str:
        r = self.r
        tag = r.choice(_TAGS[kind])
        named = tag == "div" or tag in ("ul", "ol", "section", "p") or r.random() < 0.4
        attribute = f' {r.choice(["class", "class", "id"])}="{r.choice(_OTHER[kind])}"' if named else ""
        say = lambda: self.service(kind)
        if kind == "nav":
            items = "".join(f'<li><a href="/{self.word()}">{say()}</a></li>' for _ in range(r.randint(2, 8)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.7 else items.replace("<li>", "").replace("</li>", " ")
        elif kind == "comments":
            each = "".join(f'<{"li" if tag == "ol" else "div"} class="comment"><span>{self.word()}</span><p>{self.sentence(2, 60)}</p></{"li" if tag == "ol" else "div"}>' for _ in range(r.randint(1, 5)))
            inner = (f"<h3>{say()}</h3>" if tag != "ol" and r.random() < 0.6 else "") + each
        elif kind == "form":
            inner = f"<label>{say()}</label><input type=text><button>{say()}</button>" + (f"<p>{say()}</p>" if r.random() < 0.5 else "")
        elif kind == "aside":
            inner = f"<h3>{say()}</h3>" + "".join(f'<li><a href="/{self.word()}">{self.sentence(1, 12)}</a></li>' if r.random() < 0.6 else f"<p>{self.sentence(1, 25)}</p>" for _ in range(r.randint(1, 5)))
        elif kind == "header":
            inner = f'<a href="/">{self.word()}</a><p>{say()}</p>' + (self.other("nav") if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"&copy; {self.word()}.example.com &middot; {self.sentence(1, 14)}" if r.random() < 0.6 else f"<p>{say()}</p><p>{self.sentence(1, 14)}</p>"
        else:
            inner = say() if r.random() < 0.4 else self.sentence(1, 25) if r.random() < 0.7 else f"<p>{self.sentence(1, 20)}</p>"
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "advert", "aside", "form") if r.random() < {"nav": 0.75, "header": 0.4, "advert": 0.45}.get(k, 0.2)]
        after = [k for k in ("aside", "advert", "comments", "form", "nav", "notice", "footer") if r.random() < {"footer": 0.75, "comments": 0.35}.get(k, 0.2)]
        r.shuffle(before)
        shape = r.random()
        main = self.main()
        name = r.choice(_MAIN_CLASSES)
        own = f' class="{name}"' if name else ""
        inside = self.other("comments") if r.random() < 0.08 else ""
        if shape < 0.5:
            main = f"<article{own if r.random() < 0.4 else ''}>{main}{inside}</article>"
            if r.random() < 0.3:
                main = f"<main>{main}</main>"
        elif shape < 0.65:
            main = f"<main{own if r.random() < 0.4 else ''}>{main}{inside}</main>"
        elif shape < 0.92:
            main = f'<div {r.choice(["class", "id"])}="{name or "content"}">{main}{inside}</div>'
        elif shape < 0.97:
            main = f"<section{own}>{main}</section>"
        body = "".join(map(self.other, before)) + "<!-- x -->" + main + "".join(map(self.other, after))
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{body}</div>'
        tail = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 8)}</title><style>p{{}}</style></head><body>{body}{tail}"


def labelled_pages(n: int, seed: int = 7) -> list[list[tuple[Block, int]]]:
    """Blocks of n pages, each with 1 if it belongs to the article."""
    out = []
    for k in range(n):
        page = [(b._replace(text=b.text.replace(MARK, "").strip()), int(MARK in b.text)) for b in blocks(Writer(seed * 1_000_003 + k).page())]
        page = [x for x in page if x[0].text]
        if page:
            out.append(page)
    return out
