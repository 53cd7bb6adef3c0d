"""Labelled training pages, made by rule: layouts of articles among menus, notices,
adverts, forms, comments and footers, with invented words. A page is a list of
(html, label) pieces in order; label 1 is main text, 0 is not, None is markup
without text of its own. The number of pages is a parameter with a fixed default."""

from __future__ import annotations

import random

PAGES = 360

MENU_WORDS = "Home News About Contact Sports Login Search Sitemap Archive Help Shop Blog Topics Accueil Kontakt Inicio Impressum".split()
NOTICES = ["We use cookies to improve your experience", "Accept all cookies", "This site uses cookies. Read our privacy policy", "Subscribe to our newsletter", "Sign up for free", "Your browser is not supported"]
ADVERTS = ["Advertisement", "Sponsored content", "Buy now and save 50%", "Click here", "Special offer today only"]
FOOTERS = ["© 2024 {s}. All rights reserved.", "© {s} · {t}", "Copyright {s}", "Privacy policy | Terms of use", "Powered by {s}", "Imprint", "Contact us at {s}"]
SHARES = ["Share on social media", "Share this", "Tweet", "Print this page", "Tags: {s}, {t}", "Read more", "Next page", "Previous article", "Posted in {s}"]
FORMS = ["Your e-mail address", "Send", "Leave a reply", "Name (required)", "Search this site"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("bcdfglmnprstvz", k=1)) + self.r.choice(["a", "e", "i", "o", "u", "é", "ü", "en", "er", "ion", "st"]) for _ in range(40)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice([1, 1, 2, 2, 3, 4])))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        w = self.words(self.r.randint(1, 22)).capitalize()
        return w.replace(" ", ", ", 1) + "." if self.r.random() < 0.3 else w + "."

    def prose(self, most: int = 6) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        junk = self.r.random()
        if junk < 0.06:
            out = " ".join(w + self.r.choice(["###", "$$$", "%%%", "***"]) for w in out.split())
        elif junk < 0.09:
            out = out.upper().replace(" ", "!! ")
        elif junk < 0.12:
            out = out.replace(" ", " | ")
        elif junk < 0.15:
            out = f"{self.word()}{self.r.randint(1, 99)}@{self.word()}.example.com " + out
        elif junk < 0.2:
            out = (self.word() + " ") * self.r.randint(3, 40)
        elif junk < 0.22:
            out = "Licensed under the terms of the " + self.word() + " License, Version 2.0."
        return out

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.choice([0, 0, 1, 2])):
            i = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "span", "a href='/x'"])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def fill(self, text: str) -> str:
        return text.replace("{s}", self.word()).replace("{t}", self.sentence())

    def pick(self, *ways: str) -> str:
        return self.r.choice(ways)

    def menu(self) -> list:
        tag = self.pick("nav", "div class='menu'", "div id='nav'", "ul class='navbar'", "div class='navigation main-menu'", "header", "div class='breadcrumb'", "div role='navigation'")
        names = [self.r.choice([self.r.choice(MENU_WORDS), self.word(), self.words(2)]) for _ in range(self.r.randint(2, 9))]
        items = [(f"<li><a href='/{n}'>{n}</a></li>", 0) if self.r.random() < 0.8 else (f"<li>{n}</li>", 0) for n in names]
        return [(f"<{tag}><ul>", None), *items, (f"</ul></{tag.split()[0]}>", None)]

    def box(self) -> list:
        kind = self.r.randrange(6)
        if kind == 0:
            tag, text = self.pick("div class='cookie-notice'", "div id='cookie-banner'", "div class='notice'", "div class='alert banner'", "section class='consent popup'"), [self.pick(*NOTICES), self.prose(2)]
        elif kind == 1:
            tag, text = self.pick("div class='ad'", "div class='advert'", "div id='ads'", "div class='sponsored promo'", "aside class='ad-slot'", "ins class='adsbygoogle'"), [self.pick(*ADVERTS), self.prose(2), self.sentence()]
        elif kind == 2:
            tag, text = self.pick("aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related'", "section class='recommended'"), [self.sentence(), self.prose(3), f"<a href='/'>{self.words(5)}</a>"]
        elif kind == 3:
            tag, text = self.pick("form", "form class='newsletter'", "div class='subscribe'", "div class='search-form'", "div class='login'"), [self.pick(*FORMS), self.sentence()]
        elif kind == 4:
            tag, text = self.pick("div class='share'", "div class='social-links'", "div class='tags'", "ul class='meta'", "div class='pagination'"), [self.fill(self.pick(*SHARES)), f"<a href='/'>{self.word()}</a>"]
        else:
            tag, text = self.pick("header", "div class='header'", "div id='masthead'", "div class='topbar'", "div class='site-title'"), [f"<a href='/'>{self.words(2)}</a>", self.sentence(), f"<h1>{self.words(2)}</h1>"]
        text = self.r.sample(text, self.r.randint(1, len(text)))
        wrap = self.pick("", "p", "div", "span")
        parts = [(f"<{wrap}>{x}</{wrap}>" if wrap and not x.startswith("<h1") else f"<p>{x}</p>" if len(text) > 1 and not x.startswith("<h1") else x, 0) for x in text]
        return [(f"<{tag}>", None), *parts, (f"</{tag.split()[0]}>", None)]

    def comments(self) -> list:
        outer = self.pick("section id='comments'", "div class='comments'", "div id='disqus_thread'", "ol class='commentlist'", "div class='reader-comments'", "div class='responses'")
        out = [(f"<{outer}>", None), (f"<h3>{self.pick('Comments', str(self.r.randint(1, 90)) + ' comments', 'Leave a reply', 'Discussion')}</h3>", 0)]
        for _ in range(self.r.randint(1, 5)):
            who = f"<span class='author'>{self.word()}</span> {self.r.randint(1, 28)} May"
            tag = self.pick("div class='comment'", "li class='comment'", "div class='comment-body'", "article class='comment'")
            out += [(f"<{tag}><p>{who}</p>", 0), (f"<p>{self.prose(3)}</p></{tag.split()[0]}>", 0)]
        return [*out, (f"</{outer.split()[0]}>", None)]

    def footer(self) -> list:
        tag = self.pick("footer", "div id='footer'", "div class='footer'", "div class='copyright'", "footer class='site-footer'", "div class='legal'")
        texts = [self.fill(self.pick(*FOOTERS)) for _ in range(self.r.randint(1, 3))]
        wrap = self.pick("p", "div", "") if len(texts) > 1 else self.pick("p", "div", "", "")
        wrap = wrap or ("div" if len(texts) > 1 else "")
        return [(f"<{tag}>", None), *((f"<{wrap}>{t}</{wrap}>" if wrap else t, 0) for t in texts), (f"</{tag.split()[0]}>", None)]

    def article(self) -> list:
        tag = self.pick("article", "article", "article class='post'", "main", "div id='content'", "div class='article-body'", "div class='entry-content'", "div class='post'", "section class='story'", "div id='main'", "div role='main'", "td", "div")
        out = [(f"<{tag}>", None)]
        if self.r.random() < 0.8:
            out.append((f"<{(h := self.pick('h1', 'h1', 'h2'))}>{self.pick(self.words(self.r.randint(1, 9)), self.sentence(), self.prose(1))}</{h}>", 1))
        loose = self.r.random() < 0.35
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.72:
                text = self.inline(self.prose(self.r.choice([1, 3, 9])))
                out.append((self.r.choice([f"<p>{text}", f"<p><b>{text}<br>"]) if loose else f"<p>{text}</p>", 1))
            elif kind < 0.8:
                out.append((f"<h2>{self.words(self.r.randint(1, 6))}</h2>", 1))
            elif kind < 0.86:
                out.append(("<ul>", None))
                out += [(f"<li>{self.inline(self.sentence())}</li>", 1) for _ in range(self.r.randint(1, 5))]
                out.append(("</ul>", None))
            elif kind < 0.9:
                out += [("<blockquote>", None), (f"<p>{self.prose(2)}</p>", 1), ("</blockquote>", None)]
            elif kind < 0.93:
                out += [("<table><tr>", None), *((f"<td>{self.words(2)}</td>", 1) for _ in range(3)), ("</tr></table>", None)]
            elif not loose:
                out += self.box() if self.r.random() < 0.7 else [(f"<div>{self.prose(3)}</div>", 1)]
        if self.r.random() < 0.1:
            out += self.comments()
        return [*out, (f"</{tag.split()[0]}>", None)]

    def page(self) -> list:
        out = [(f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><script>var x='<p>';</script></head><body>", None)]
        for make, chance in ((self.box, 0.4), (self.menu, 0.8), (self.box, 0.5), (self.article, 1.0), (self.box, 0.4), (self.comments, 0.3), (self.menu, 0.15), (self.footer, 0.8)):
            if self.r.random() < chance:
                wrap = self.r.random() < 0.25
                out += [("<div class='wrapper'>", None)] * wrap + make() + [("</div>", None)] * wrap
        return [*out, ("</body></html>", None)]


def labelled_pages(pages: int = PAGES) -> list[list[tuple[str, int | None]]]:
    return [Maker(seed).page() for seed in range(pages)]
