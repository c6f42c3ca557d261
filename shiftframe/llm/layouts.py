"""Labelled pages in many layouts, drawn at random, for training and testing the extraction of main text."""

from __future__ import annotations

import html
import random

#: Elements that hold what is not the article, by kind: (tag, attributes).
AROUND = {
    "menu": """nav|nav class="main-nav"|nav role="navigation"|div class="nav"|div id="navigation"|ul class="menu"|div class="menu"|div class="navbar"|
        div class="breadcrumbs"|ol class="breadcrumb"|div class="pagination"|div role="navigation"|div class="tabs"|menu""",
    "header": """header|header class="site-header"|div id="header"|div class="header"|div class="masthead"|div class="topbar"|div class="branding"|
        div role="banner"|div class="site-title"|header id="top\"""",
    "footer": """footer|footer class="site-footer"|div id="footer"|div class="footer"|div class="copyright"|div class="legal"|div class="colophon"|
        div role="contentinfo"|div class="page-foot\"""",
    "sidebar": """aside|aside class="sidebar"|div class="sidebar"|div id="sidebar"|div class="widget"|div class="related"|div class="related-posts"|
        div class="recommended"|div class="trending"|div class="popular-posts"|div id="secondary"|div role="complementary"|section class="more-stories"|
        div class="author-box"|div class="tags"|div class="see-also\"""",
    "notice": """div class="cookie-banner"|div id="cookie-notice"|div class="consent"|div class="gdpr"|div class="notice"|div class="alert"|dialog|noscript|
        div class="popup"|div class="modal"|div class="overlay"|div class="privacy-notice"|div role="alert"|div role="dialog"|section class="cookies"|
        div class="paywall"|p class="disclaimer\"""",
    "advert": """div class="ad"|div class="ads"|div class="advert"|div class="advertisement"|div class="sponsored"|div class="promo"|div id="ad-top"|
        div class="ad-slot"|div class="banner"|section class="sponsor"|aside class="ad"|div class="adBox"|p class="ad\"""",
    "form": """form|form class="search"|form id="login"|form class="newsletter"|div class="subscribe"|div class="newsletter-signup"|div class="search-box"|
        div class="login"|div class="signup"|fieldset|div class="contact-form"|div role="search\"""",
    "comments": """div class="comments"|section class="comments"|div id="comments"|ol class="comment-list"|ul class="commentlist"|div class="discussion"|
        div class="replies"|section id="responses"|div id="disqus_thread"|div class="reader-comments"|section class="feedback"|div class="reviews\"""",
    "share": """div class="share"|div class="social"|ul class="social-links"|div class="follow-us"|div class="sharing-buttons"|div class="toolbar\"""",
}
AROUND = {kind: [x.strip() for x in text.split("|")] for kind, text in AROUND.items()}
MAIN = [x.strip() for x in """article|article|article|article class="post"|main|main id="content"|div class="content"|div id="content"|div class="article"|
    div class="article-body"|div class="post"|div class="entry-content"|div class="story"|div class="text"|div id="main"|div role="main"|
    section class="article"|div class="page-content"|td class="content"|div itemprop="articleBody"|section|div|""".split("|")]
PLAIN = ["div", "div", 'div class="wrapper"', 'div class="container"', 'div id="page"', 'div class="row"', 'div class="inner"', "section", 'div class="layout"']
PHRASES = {
    "menu": "Home|About us|Contact|News|Products|Archive|Menu|Blog|Help|Start|Next|Previous",
    "header": "The Daily Page|Menu|Sign in|Search|My site|Since 1999",
    "footer": "© {y} All rights reserved.|Copyright {y}|Privacy policy|Terms of use|Imprint|Contact us",
    "sidebar": "Related articles|Most read|You may also like|About the author|Read more|Recent posts|See also",
    "notice": "We use cookies to improve this site.|Please enable JavaScript.|Accept all|By using this site you agree to our privacy policy.|Manage consent",
    "advert": "Advertisement|Sponsored|Buy now|Special offer|Ad",
    "form": "Subscribe to our newsletter|Email address|Password|Log in|Search|Send|Your name|Register",
    "comments": "Comments|3 comments|Reply|Leave a reply|Posted by|Be the first to comment|Report",
    "share": "Share|Tweet|Follow us|Print|Share this article|Email",
}
PHRASES = {kind: text.split("|") for kind, text in PHRASES.items()}
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvwz"


def made_word(draw: random.Random) -> str:
    return "".join(draw.choice(CONSONANTS) + draw.choice(VOWELS) for _ in range(draw.randint(1, 4)))


def made_sentence(draw: random.Random) -> str:
    words = [made_word(draw) + ("," if draw.random() < 0.1 else "") for _ in range(draw.randint(3, 22))]
    return " ".join(words).capitalize() + draw.choice("...?!")


def sentence(draw: random.Random, texts: list[str]) -> str:
    """A text of the table or a made-up one; of long texts some words in a row."""
    if not texts or draw.random() < 0.4:
        return made_sentence(draw)
    words = draw.choice(texts).split(" ")
    at = draw.randrange(len(words))
    return " ".join(words[at : at + draw.randint(3, 25)])


def paragraph(draw: random.Random, texts: list[str]) -> str:
    if texts and draw.random() < 0.5:
        return html.escape(draw.choice(texts), quote=False)
    return html.escape(" ".join(sentence(draw, texts) for _ in range(draw.randint(1, 6))), quote=False)


def wrapped(element: str, inner: str, truth: int | None = None, unclosed: bool = False) -> str:
    if not element:
        return inner
    tag = element.split(" ")[0]
    mark = "" if truth is None else f' data-main="{truth}"'
    return f"<{element}{mark}>{inner}" + ("" if unclosed else f"</{tag}>")


def link(text: str) -> str:
    return f'<a href="/{text[:5]}">{text}</a>'


def around(draw: random.Random, kind: str, inside: list[str], outside: list[str]) -> str:
    """An element that is not main text, with what such elements hold."""
    element = draw.choice(AROUND[kind])
    tag = element.split(" ")[0]
    say = lambda: html.escape(draw.choice(PHRASES[kind]).replace("{y}", str(draw.randint(1998, 2030))), quote=False)
    other = lambda: html.escape(sentence(draw, outside if draw.random() < 0.6 else inside), quote=False)
    words = lambda: " ".join(made_word(draw) for _ in range(draw.randint(1, 3)))
    parts = []
    for _ in range(draw.randint(1, 6)):
        drawn = draw.random()
        if kind == "menu" or kind == "share":
            text = link(say() if drawn < 0.4 else words())
        elif kind == "comments":
            text = say() if drawn < 0.2 else paragraph(draw, inside) if drawn < 0.8 else other()
        elif kind == "form":
            text = wrapped(draw.choice(["label", "button", "span", "p"]), say() if drawn < 0.6 else words())
        else:
            text = say() if drawn < 0.35 else link(words()) if drawn < 0.5 else other()
        parts.append(text)
    if tag in ("ul", "ol", "menu") or kind == "menu" and draw.random() < 0.6:
        inner = "".join(f"<li>{p}</li>" for p in parts)
        inner = inner if tag in ("ul", "ol", "menu") else f"<ul>{inner}</ul>"
    elif tag == "p":
        inner = " ".join(parts)
    else:
        item = draw.choice(["p", "div", "", 'div class="item"', 'div class="comment"' if kind == "comments" else "p"])
        if not item:
            parts = parts[:1]
        inner = "".join(wrapped(item, p) for p in parts)
        if draw.random() < 0.3:
            inner = wrapped(draw.choice(["h2", "h3", "h4"]), say()) + inner
    return wrapped(element, inner, 0)


def article(draw: random.Random, inside: list[str], outside: list[str]) -> str:
    """The inner markup of an article, sometimes with foreign elements between its parts and damaged inline markup."""
    parts = []
    if draw.random() < 0.85:
        title = wrapped("h1", html.escape(sentence(draw, inside), quote=False))
        parts.append(wrapped("header", title, 1) if draw.random() < 0.1 else title)
    for _ in range(draw.choice([1, 2, 3, 5, 8, 12])):
        drawn = draw.random()
        if drawn < 0.66:
            text = paragraph(draw, inside)
            parts.append(wrapped("p", text if draw.random() < 0.8 else f"<b>{text}<br>", unclosed=draw.random() < 0.1))
        elif drawn < 0.72:
            parts.append(wrapped(draw.choice(["h2", "h3"]), html.escape(sentence(draw, inside), quote=False)))
        elif drawn < 0.77:
            items = "".join(wrapped("li", html.escape(sentence(draw, inside), quote=False)) for _ in range(draw.randint(2, 5)))
            parts.append(wrapped(draw.choice(["ul", "ol"]), items))
        elif drawn < 0.81:
            parts.append(wrapped("blockquote", paragraph(draw, inside)))
        elif drawn < 0.84:
            parts.append(wrapped("figure", "<img src=x>" + wrapped("figcaption", html.escape(sentence(draw, inside), quote=False))))
        elif drawn < 0.86:
            cells = "".join(wrapped("tr", wrapped("td", made_word(draw)) + wrapped("td", made_sentence(draw))) for _ in range(draw.randint(1, 4)))
            parts.append(wrapped("table", cells))
        elif drawn < 0.88:
            parts.append(wrapped("pre", html.escape(made_sentence(draw))))
        else:
            parts.append(around(draw, draw.choice(["advert", "sidebar", "share", "form", "notice"]), inside, outside))
    if draw.random() < 0.25:
        parts.append(around(draw, draw.choice(["comments", "comments", "share", "sidebar"]), inside, outside))
    return "".join(parts)


def page_of(draw: random.Random, inside: list[str], outside: list[str]) -> str:
    """One page in a layout of its own. ``data-main`` says of every element whether its text is main text."""
    some = lambda p, *kinds: [around(draw, k, inside, outside) for k in kinds if draw.random() < p]
    main = wrapped(draw.choice(MAIN), article(draw, inside, outside), 1) if draw.random() < 0.95 else ""
    before = some(0.5, "notice", "header", "menu", "advert", "menu", "form")
    beside = some(0.35, "sidebar", "advert", "form", "menu")
    after = some(0.45, "comments", "share", "sidebar", "notice", "advert", "footer", "footer")
    draw.shuffle(beside)
    if draw.random() < 0.5:
        draw.shuffle(before)
    middle = [*beside, main] if draw.random() < 0.3 else [main, *beside]
    if draw.random() < 0.5:
        middle = [wrapped(draw.choice(PLAIN), "".join(middle))]
    whole = "".join([*before, *middle, *after])
    for _ in range(draw.choice([0, 0, 1, 2])):
        whole = wrapped(draw.choice(PLAIN), whole)
    # main text that stands in no element of its own is marked by the body
    return f'<!DOCTYPE html><html><head><title>x</title></head><body data-main="1">{whole}</body></html>'
