"""Invented pages with known main text, on which the extractor is trained."""

from __future__ import annotations

import html
import random

SYLLABLES = "ka lo mi ten sar vi do re un pel gra is on tha bre qui zo ner fal ush".split()


#: Kinds of parts that are not main text.
NOISE = ("nav", "ad", "notice", "sidebar", "share", "form", "script", "comments", "crumbs", "related", "tags", "hidden")


class Writer:
    """One page: markup, and for each piece of markup whether it is main text."""

    def __init__(self, seed: int, noise: tuple[str, ...] = NOISE):
        self.r, self.kinds = random.Random(seed), noise

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(1, 14) + ("," if self.r.random() < 0.1 else "")
        return (s.capitalize() + self.r.choice([".", ".", ".", "!", "?"])) if self.r.random() < 0.9 else s

    def prose(self, low: int, high: int) -> str:
        return html.escape(" ".join(self.sentence() for _ in range(self.r.randint(low, high))))

    def inline(self, text: str) -> str:
        out = []
        for w in text.split(" "):
            x = self.r.random()
            out.append(f"<{t}>{w}</{t}>" if x < 0.02 and (t := self.r.choice(["b", "em", "strong", "i", "span", "code"])) else f'<a href="/{w}">{w}</a>' if x < 0.03 else w)
        return " ".join(out)

    def attr(self, *names: str) -> str:
        if self.r.random() < 0.15:
            return f' {self.r.choice(["class", "id"])}="{self.word()}"' if self.r.random() < 0.5 else ""
        name = self.r.choice(names)
        name = self.r.choice([name, name + "-" + self.word(), self.word() + "-" + name, name + "_" + str(self.r.randint(1, 9)), name.capitalize(), "site-" + name])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, low: int = 3, high: int = 9) -> str:
        kind = self.r.random()
        each = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(each)

    def noise(self) -> str:
        """A part that is not main text."""
        r = self.r
        kind = r.choice(self.kinds)
        div = r.choice(["div", "div", "section", "aside"])
        if kind == "nav":
            t = r.choice(["nav", "nav", "div", "ul"])
            return f"<{t}{self.attr('nav', 'menu', 'navbar', 'navigation')}>{self.links()}</{t}>"
        if kind == "ad":
            return f"<{div}{self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad')}>{r.choice(['', '<p>'])}{self.prose(1, 3)}</{div}>"
        if kind == "notice":
            return f"<div{self.attr('cookie', 'notice', 'consent', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'paywall', 'banner')}><p>{self.prose(1, 3)}</p><button>{self.words(1, 2)}</button></div>"
        if kind == "sidebar":
            t = r.choice(["aside", "aside", "div"])
            inner = r.choice([self.links(), f"<h3>{self.words(1, 3)}</h3><p>{self.prose(1, 4)}</p>", f"<p>{self.prose(1, 5)}</p>"])
            return f"<{t}{self.attr('sidebar', 'widget', 'side', 'complementary', 'trending')}>{inner}</{t}>"
        if kind == "share":
            return f"<div{self.attr('share', 'social', 'toolbar', 'buttons', 'sharing')}>{self.links(2, 4)}</div>"
        if kind == "form":
            return f"<form{self.attr('search', 'login', 'signup', 'subscribe-form')}><label>{self.words(1, 3)}</label><input type=text><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button></form>"
        if kind == "script":
            return r.choice([f'<script>var x="<p>{self.words(2, 9)}</p>";</script>', f"<style>.{self.word()}{{margin:0}}</style>", f"<noscript><p>{self.prose(1, 1)}</p></noscript>", f"<!-- <p>{self.words(2, 9)}</p> -->"])
        if kind == "comments":
            each = "".join(f"<{t}{self.attr('comment', 'reply')}>{r.choice(['<p>', '<b>' + self.word() + '</b> '])}{self.prose(1, 4)}</{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
            return f"<{r.choice(['section', 'div', 'ol'])}{self.attr('comments', 'discussion', 'responses', 'disqus')}><h3>{self.words(1, 2)}</h3>{each}</section>"
        if kind == "crumbs":
            return f"<div{self.attr('breadcrumb', 'breadcrumbs', 'crumbs', 'pager', 'pagination')}>{self.links(2, 4)}</div>"
        if kind == "related":
            return f"<{div}{self.attr('related', 'recommended', 'more-stories', 'popular')}><h3>{self.words(1, 3)}</h3>{self.links()}{r.choice(['', '<p>' + self.prose(1, 2) + '</p>'])}</{div}>"
        if kind == "tags":
            return f"<div{self.attr('tags', 'categories', 'labels')}>{self.links(2, 5)}</div>"
        return f'<div {r.choice(["hidden", "style=display:none", "aria-hidden=true"])}><p>{self.prose(1, 2)}</p></div>'

    def main(self) -> list[tuple[str, bool]]:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append((f"<h1>{self.inline(self.words(1, 9))}</h1>", True))
        for _ in range(r.randint(1, 9)):
            k = r.random()
            if k < 0.72:
                close = r.random() < 0.85
                text = self.inline(self.prose(1, 9)) if r.random() > 0.12 else self.words(1, 3).capitalize() + "."
                lead = "<b>" if r.random() < 0.12 else ""
                out.append((f"<p>{lead}{text}" + ("<br>" + self.prose(1, 2) if r.random() < 0.1 else "") + ("</p>" if close and not lead else ""), True))
            elif k < 0.79:
                out.append((f"<h2>{self.words(1, 6)}</h2>", True))
            elif k < 0.85:
                t = r.choice(["ul", "ol"])
                out.append((f"<{t}>" + "".join(f"<li>{self.inline(self.prose(1, 2))}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>", True))
            elif k < 0.88:
                out.append((f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>", True))
            elif k < 0.9:
                out.append((f"<pre>{self.words(3, 20)}</pre>", True))
            elif k < 0.92:
                out.append(("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>", True))
            elif k < 0.94:
                out.append((f"<div>{self.prose(1, 5)}</div>", True))
            elif k < 0.96:
                out.append((f"<figure><img src=x><figcaption>{self.prose(1, 1)}</figcaption></figure>", True))
            else:
                out.append((self.noise(), False))
        return out

    def page(self) -> list[tuple[str, bool]]:
        r = self.r
        out: list[tuple[str, bool]] = [(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title>{'<style>p{margin:0}</style>' if r.random() < 0.5 else ''}</head><body>", False)]
        wrap = r.random() < 0.4
        if wrap:
            out.append((f"<div{self.attr('wrapper', 'page', 'container', 'site')}>", False))
        if r.random() < 0.5:
            t = r.choice(["header", "header", "div"])
            out.append((f"<{t}{self.attr('header', 'masthead', 'top', 'site-header')}>{r.choice(['<h1>', '<p>', '<div>', ''])}{self.words(1, 4)}{r.choice(['', self.links()])}</{t}>", False))
        out += [(self.noise(), False) for _ in range(r.randint(0, 4))]
        t = r.choice(["article", "article", "article", "main", "div", "section"])
        names = self.attr("content", "article", "post", "entry", "story", "main", "article-body", "post-content") if t in ("div", "section") or r.random() < 0.3 else ""
        outer = r.random() < 0.3
        body = self.main()
        out += [("<main>", False)] * outer + [(f"<{t}{names}>", False), *body, (f"</{t}>", False)] + [("</main>", False)] * outer
        out += [(self.noise(), False) for _ in range(r.randint(0, 4))]
        if r.random() < 0.75:
            t = r.choice(["footer", "footer", "div"])
            out.append((f"<{t}{self.attr('footer', 'copyright', 'legal', 'bottom')}>{r.choice(['', '<p>'])}&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}{r.choice(['', self.links()])}</{t}>", False))
        if wrap:
            out.append(("</div>", False))
        if r.random() < 0.8:
            out.append(("</body></html>", False))
        return out
