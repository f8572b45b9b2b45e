"""A generator of page layouts, to train the block labeller.

``page`` returns HTML and the set of its main-text blocks.  Words are random, so the
labeller learns from tags, names, shapes and order.  Layouts vary in their tags, class
names, nesting, order, and in unclosed or misplaced tags.
"""

from __future__ import annotations

import html

import numpy as np

#: Names that pages give to their parts.
PARTS = {
    "nav": "nav menu navbar navigation main-menu site-nav top-nav links topbar navlinks mainNav global-nav",
    "header": "header site-header masthead branding top page-header topHeader banner-top logo",
    "crumbs": "breadcrumb breadcrumbs crumbs path trail",
    "notice": "cookie cookie-notice consent gdpr notice alert message cookie-banner site-notice warning announcement "
              "privacy popup modal overlay disclaimer",
    "ad": "ad ads advert advertisement sponsored promo ad-banner sponsor ad-slot adbox advertising promotion "
          "sponsored-content dfp",
    "side": "sidebar side widget rail secondary related popular trending recommended aside right-column sidebar-left",
    "share": "share social follow sharing social-links buttons",
    "comments": "comments comment-list responses discussion replies thread reader-comments disqus feedback "
                "user-comments commentSection",
    "form": "newsletter subscribe signup search login contact subscription form search-box register poll",
    "footer": "footer site-footer bottom colophon copyright foot page-footer legal",
    "more": "related more read-next recommended see-also related-posts more-stories tags pagination pager",
    "main": "content article post entry story main body text article-body post-content entry-content main-content "
            "story-body articleText page-content",
    "wrap": "container wrapper row col inner page site grid block section layout outer clearfix columns",
}
PARTS = {k: v.split() for k, v in PARTS.items()}
#: Words common on pages beside their main text.
PHRASES = {
    "nav": "Home|About|Contact|News|Blog|Products|Services|Login|Sign in|Sitemap|Startseite|Inicio|Accueil|Kontakt|"
           "Archive|FAQ|Help|Shop|Search|Impressum|Sports|World|Politics",
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Accept all cookies|"
              "Wir verwenden Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies.|Please disable your ad "
              "blocker.|Your browser is out of date.|JavaScript is required.|I agree|Dismiss",
    "ad": "Advertisement|Sponsored|Buy now|Anzeige|Publicité|Publicidad|Shop now and save 50%!|Limited offer|"
          "Click here to win|Learn more|Free shipping on all orders.",
    "share": "Share|Tweet|Share on Facebook|Follow us|Print|Email this|Like|Pin it|Teilen|Partager|Compartir",
    "comments": "Comments|3 comments|Reply|Report|Leave a comment|Kommentare|Commentaires|Comentarios|Log in to reply|"
                "Great article!|Thanks for sharing.|First!|Like (4)",
    "form": "Subscribe to our newsletter|Your email|Sign up|Send|Submit|Password|Remember me|Search|Name|Message|"
            "Newsletter abonnieren|S'abonner|Suscribirse",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Copyright 2023|Contact us|Powered by|"
              "Alle Rechte vorbehalten|Tous droits réservés|Todos los derechos reservados|Imprint|Back to top",
    "side": "Related articles|Most read|Popular posts|You may also like|Trending now|Latest news|Tags|Archives|"
            "Meistgelesen|À lire aussi|Lo más leído",
    "more": "Read more|Next|Previous|Older posts|More stories|See also|1|2|3|Weiterlesen|Suite",
}
PHRASES = {k: v.split("|") for k, v in PHRASES.items()}
_SOUNDS = [s.split() for s in (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve",
    "en er ch ei ie te un ge st ic he ne se be ng re au ße ü ä ö sch ver zu heit keit",
    "es de le en re nt on er ou ai é è ê ç eau eux tion que elle ment vi",
    "de os ar ue la ra as ón ió el ci ñ á í ll rr mente ado que para")]


class _Maker:
    def __init__(self, random: np.random.Generator):
        self.random = random
        sounds = _SOUNDS[random.integers(len(_SOUNDS))]
        self.words = ["".join(random.choice(sounds, random.integers(1, 5))) for _ in range(150)]
        self.weights = 1 / np.arange(1, 151) ** 0.8
        self.weights /= self.weights.sum()
        self.main: set[str] = set()
        self.named = random.random() < 0.85  # parts have telling names
        self.loose = random.random() < 0.3   # end tags are left out
        self.noise = random.choice(["", "marks", "bars", "shouts", "again"], p=[0.7, 0.1, 0.08, 0.06, 0.06])

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def pick(self, items):
        return items[self.random.integers(len(items))]

    def some(self, low: int, high: int) -> int:
        return int(self.random.integers(low, high + 1))

    def phrase(self, low: int, high: int) -> str:
        """Words; pages of poor quality have marks, bars, shouting or one word again and again."""
        words = list(self.random.choice(self.words, self.some(low, high), p=self.weights))
        if self.noise == "again":
            words = words[:1] * len(words)
        if self.noise == "shouts":
            words = [w.upper() + "!!" for w in words]
        if self.noise == "marks":
            words = [w + self.pick(["###", "***", "&&&", "%%%"]) for w in words]
        return (" | " if self.noise == "bars" else " ").join(words)

    def sentences(self, low: int, high: int) -> str:
        left, out = self.some(low, high), []
        while left > 0:
            n = min(left, self.some(1, 16))
            text = self.phrase(n, n)
            if n > 6 and self.chance(0.5):
                text = text.replace(" ", ", ", 1)
            out.append(text[:1].upper() + text[1:] + self.pick([".", ".", ".", "?", "!"]))
            left -= n
        return " ".join(out)

    def inline(self, text: str) -> str:
        """Escape, and put some words into inline tags."""
        words = html.escape(text, quote=False).split(" ")
        if self.chance(0.25):
            k = self.some(0, len(words) - 1)
            tag = self.pick(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words).replace("©", self.pick(["©", "&copy;", "&#169;"]))

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return self.inline(text)

    def name(self, part: str) -> str:
        if not self.named or self.chance(0.1):
            return ""
        name = self.pick(PARTS[part])
        if self.chance(0.2):
            name = self.pick(["js-", "td-", "m_", "c-", "the"]) + name
        if self.chance(0.15):
            name += self.pick(["-1", "__inner", " clearfix", "-area", "-wrap", " widget-2"])
        return f' {self.pick(["class", "class", "class", "id"])}="{name}"'

    def box(self, tags: str, part: str, body: str) -> str:
        tag = self.pick(tags.split())
        return f"<{tag}{self.name(part)}>{body}</{tag}>"

    def end(self, tag: str) -> str:
        return "" if self.loose and self.chance(0.5) else f"</{tag}>"

    def said(self, part: str, low: int, high: int) -> str:
        if part in PHRASES and self.chance(0.35):
            return self.inline(self.pick(PHRASES[part]))
        if high >= 8:
            return self.inline(self.sentences(low, high))
        return self.inline(self.phrase(low, high) + self.pick(["", "", "", ".", ",", "!", ":"]))

    def links(self, part: str, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.said(part, 1, 3)}</a>' for k in range(self.some(low, high))]
        if self.chance(0.75):
            return "<ul>" + "".join(f"<li>{i}{self.end('li')}" for i in items) + "</ul>"
        return self.pick([" ", " | ", "<br>"]).join(items) if self.chance(0.5) else "".join(
            f"<div>{i}</div>" for i in items)

    def nav(self) -> str:
        return self.box("nav nav nav div ul" if self.named else "nav", "nav", self.links("nav", 2, 9))

    def header(self) -> str:
        body = f"<{(t := self.pick(['h1', 'h2', 'div', 'p']))}>{self.said('nav', 1, 4)}</{t}>"
        if self.chance(0.4):
            body += f"<p>{self.inline(self.sentences(3, 12))}</p>"
        if self.chance(0.4):
            body += self.links("nav", 2, 6)
        if self.chance(0.3):
            body += self.form()
        return self.box("header header div" if self.named else "header", "header", body)

    def notice(self) -> str:
        text = f"<p>{self.said('notice', 5, 30)}</p>" if self.chance(0.7) else self.said("notice", 5, 30)
        if self.chance(0.5):
            text += f"<button>{self.said('notice', 1, 2)}</button>"
        return f"<{(t := self.pick(['div', 'div', 'section', 'aside', 'dialog']))} class=\"{self.pick(PARTS['notice'])}\">" \
               f"{text}</{t}>"

    def ad(self) -> str:
        text = self.said("ad", 3, 25)
        if self.chance(0.4):
            text = f"<p>{text}</p>"
        if self.chance(0.3):
            text += f'<a href="/ad">{self.said("ad", 1, 4)}</a>'
        return f"<{(t := self.pick(['div', 'div', 'div', 'aside', 'section', 'p']))} " \
               f"{self.pick(['class', 'class', 'id'])}=\"{self.pick(PARTS['ad'])}\">{text}</{t}>"

    def side(self) -> str:
        body = ""
        for _ in range(self.some(1, 3)):
            body += f"<{(t := self.pick(['h3', 'h4', 'h2', 'p']))}>{self.said('side', 1, 4)}</{t}>"
            body += self.links("side", 2, 7) if self.chance(0.6) else f"<p>{self.inline(self.sentences(4, 40))}</p>"
        return self.box("aside aside div section" if self.named else "aside", "side", body)

    def share(self) -> str:
        return self.box("div ul", "share", self.links("share", 2, 5))

    def comments(self) -> str:
        names = PARTS["comments"]
        body = f"<h3>{self.said('comments', 1, 3)}</h3>"
        for _ in range(self.some(1, 6)):
            text = self.said("comments", 4, 60)
            one = f"<{(t := self.pick(['p', 'div', 'span', 'h4']))}>{self.inline(self.phrase(1, 2))}</{t}>" \
                if self.chance(0.6) else ""
            body += f'<{(t := self.pick(["div", "li", "article", "p"]))} class="{self.pick(["comment", "reply", "user"])}">' \
                    f"{one}" + (f"<p>{text}</p>" if self.chance(0.7) and t != "p" else text) + f"</{t}>"
        if self.chance(0.4):
            body += self.form()
        return f"<{(t := self.pick(['section', 'div', 'div', 'ul']))} " \
               f"{self.pick(['class', 'id'])}=\"{self.pick(names)}\">{body}</{t}>"

    def form(self) -> str:
        body = ""
        for _ in range(self.some(1, 4)):
            body += self.pick([f"<label>{self.said('form', 1, 3)}</label><input name='q'>",
                               f"<p>{self.said('form', 2, 18)}</p>", f"<button>{self.said('form', 1, 2)}</button>",
                               f"<select><option>{self.phrase(1, 2)}<option>{self.phrase(1, 2)}</select>",
                               f"<h3>{self.said('form', 2, 5)}</h3>"])
        return f"<form{self.name('form')} action='/s'>{body}</form>"

    def footer(self) -> str:
        body = "".join(self.pick([f"<p>{self.said('footer', 3, 25)}</p>", self.links("footer", 2, 6),
                                  self.said("footer", 2, 14), self.inline("© " + self.sentences(3, 12))])
                       for _ in range(self.some(1, 4)))
        return self.box("footer footer footer div" if self.named else "footer", "footer", body)

    def more(self) -> str:
        return self.box("div section nav aside", "more", f"<h3>{self.said('more', 1, 4)}</h3>"
                        + self.links("more", 2, 6)) if self.named else self.nav()

    def paragraph(self) -> str:
        low, high = self.pick([(1, 3), (4, 20), (20, 60), (40, 120), (60, 200)])
        text = self.keep(self.sentences(low, high))
        if self.chance(0.15):  # an unclosed inline tag and a stray line break
            return f"<p><b>{text}<br>"
        if self.chance(0.04):
            return f"<div>{text}</div>"
        return f"<p>{text}{self.end('p')}"

    def article(self) -> str:
        parts = [f"<h1>{self.keep(self.sentences(1, 14))}</h1>"] if self.chance(0.85) else []
        if parts and self.chance(0.15):
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(self.some(*self.pick([(0, 2), (1, 14), (1, 14), (1, 14), (14, 50)]))):
            parts.append(self.paragraph())
            if self.chance(0.12):
                parts.append(f"<{(t := self.pick(['h2', 'h3']))}>{self.keep(self.phrase(1, 8))}</{t}>")
            if self.chance(0.06):
                parts.append(self.pick(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(
                    f"<li>{self.keep(self.sentences(1, 20))}{self.end('li')}" for _ in range(self.some(2, 6)))))
            if self.chance(0.04):
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            if self.chance(0.03):
                parts.append(f"<pre>{self.keep(self.phrase(3, 20))}</pre>")
            if self.chance(0.03):
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.phrase(1, 3))}</td>" for _ in
                                                                   range(3)) + "</tr>" for _ in range(self.some(2, 4)))
                             + "</table>")
            if self.chance(0.03):
                parts.append(f'<figure><img src="x.png"><figcaption>{self.keep(self.sentences(3, 15))}</figcaption></figure>')
            if self.chance(0.05):
                parts.append(self.pick([self.ad, self.side, self.share, self.form, self.notice, self.more])())
        if self.chance(0.06):  # one short line, again and again
            parts += [f"<p>{self.keep(self.sentences(1, 4))}</p>"] * self.some(2, 12)
        if self.chance(0.08):
            parts.append(self.comments())
        return self.wrapped("".join(parts))

    def wrapped(self, body: str) -> str:
        if self.chance(0.1):
            return body
        body = self.box("article article article div div main section", "main", body)
        for _ in range(self.some(0, 2)):
            body = self.box("div div main section", self.pick(["main", "wrap"]), body)
        return body


def page(random: np.random.Generator) -> tuple[str, set[str]]:
    """A page, and the texts of its main blocks."""
    m = _Maker(random)
    before = [f for f, p in ((m.notice, 0.2), (m.header, 0.5), (m.nav, 0.75), (m.more, 0.1), (m.ad, 0.45),
                             (m.notice, 0.1), (m.side, 0.15), (m.form, 0.1)) if m.chance(p)]
    if m.chance(0.3):
        random.shuffle(before)
    after = [f for f, p in ((m.share, 0.2), (m.ad, 0.2), (m.comments, 0.4), (m.more, 0.25), (m.side, 0.3),
                            (m.form, 0.25), (m.notice, 0.1), (m.footer, 0.85), (m.notice, 0.08)) if m.chance(p)]
    body = "".join(f() for f in before)
    if m.chance(0.3):
        body += "<!-- ad 7 <p>no</p> -->"
    body += m.article() if m.chance(0.97) else ""
    body += "".join(f() for f in after)
    if m.chance(0.3):
        body = f"<div{m.name('wrap')}>{body}</div>"
    end = "</body></html>" if m.chance(0.85) else ""
    title = html.escape(m.phrase(2, 8))
    return (f"<!DOCTYPE html><html lang='x'><head><title>{title}</title><style>p{{}}</style>"
            f"<script>var t='</p>';</script></head><body>{body}{end}"), m.main
