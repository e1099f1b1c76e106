"""Labelled pages for the HTML model: composed from a fixed seed, with content marked by ``data-y="1"``.

Pages differ in their containers, class names, order and markup errors; texts are random words, so the model can
learn from structure and shape only. The attribute never reaches the features."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ter an den sul ro va pe qui nor est ul ama iso tra lin ge ber".split()
CONTENT_BOXES = [
    "<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="post-content">{}</div>', '<div id="content">{}</div>',
    '<div class="wrapper"><div class="entry-content">{}</div></div>', '<section class="article-body">{}</section>', '<div class="story"><div>{}</div></div>', '<div id="main"><div class="text">{}</div></div>', '<div class="container"><article>{}</article></div>',
    "<div><div>{}</div></div>", '<article class="article"><header><h1 data-y="1">{t}</h1></header>{}</article>',
]
BEFORE = [
    "<nav><ul>{links}</ul></nav>", '<header><div class="logo">{short}</div><nav>{links}</nav></header>', '<div class="menu"><ul>{links}</ul></div>', '<div id="header"><h2>{short}</h2><ul class="nav">{links}</ul></div>', '<div class="ad">{sentence}</div>',
    '<div class="cookie-notice"><p>{sentence}</p></div>', '<div class="banner">{sentence}</div>', '<div class="breadcrumb">{links}</div>', '<form action="/s" class="search"><label>{short}</label></form>', '<p class="notice">{sentence}</p>', '<div role="navigation">{links}</div>',
    '<div class="topbar"><span>{short}</span></div>', '<header class="site-header"><p>{sentence}</p></header>', '<div class="advert"><p>{sentence}</p></div>', '<div id="consent-popup"><p>{sentence}</p><a href="#">{short}</a></div>', '<ul>{links}</ul>',
]
AFTER = [
    "<footer>&copy; {short} {sentence}</footer>", '<aside><h3>{short}</h3><ul>{links}</ul></aside>', '<div class="sidebar"><p>{sentence}</p><ul>{links}</ul></div>', '<div id="footer"><p>{sentence}</p></div>', '<div class="related"><h4>{short}</h4><ul>{links}</ul></div>',
    '<section id="comments"><h3>{short}</h3><div class="comment"><p>{paragraph}</p></div><div class="comment"><p>{sentence}</p></div></section>', '<div class="comments"><article class="comment"><p>{paragraph}</p></article><ol><li>{sentence}</li></ol></div>', '<form><label>{short}</label><p>{sentence}</p></form>',
    '<div class="newsletter"><p>{sentence}</p></div>', '<div class="share">{links}</div>', '<div class="sponsored">{paragraph}</div>', '<div class="copyright">{sentence}</div>', '<aside class="widget"><p>{paragraph}</p></aside>', '<ul class="comment-list"><li><p>{paragraph}</p></li></ul>', '<div class="pagination">{links}</div>',
    '<footer><p>{paragraph}</p><ul>{links}</ul></footer>', '<section class="user-comments"><p>{paragraph}</p><p>{sentence}</p></section>', '<div class="tags">{links}</div>', '<div class="disclaimer"><p>{sentence}</p></div>',
]
#: Names that sites of other languages and tools give to the same parts: kind -> names.
NAMES = {
    "menu": "menu navigation navbar menü navegacion navigazione hauptmenu nav-menu site-nav brotkrumen menu-principal topnav",
    "foot": "footer fusszeile pie-de-pagina pied-de-page site-footer impressum colophon pie fuss bottom",
    "side": "sidebar seitenleiste barra-lateral barre-laterale rail side-column related verwandt relacionados mehr-lesen a-lire-aussi trending",
    "advert": "advert ad-slot werbung anzeige publicidad publicite sponsored promo-box anuncio reklame partner-box",
    "notice": "cookie-banner notice hinweis aviso avis-cookies consent-box newsletter-box datenschutz popup meldung alert-bar",
    "comment": "comments kommentare comentarios commentaires comment-list user-reviews leserbriefe respond discussion opiniones avis kommentar reader-comments",
    "content": "content inhalt contenido contenu article-text artikel articulo beitrag entry story-body texto corps haupttext post-text",
}
KINDS = {
    "menu": ["<ul>{links}</ul>", "{links}"], "foot": ["<p>{sentence}</p>", "<p>{short}</p><ul>{links}</ul>"], "side": ["<h3>{short}</h3><ul>{links}</ul>", "<p>{sentence}</p>", "<h4>{short}</h4><p>{paragraph}</p>"],
    "advert": ["<p>{sentence}</p>", "{sentence}", "<p>{paragraph}</p>"], "notice": ["<p>{sentence}</p><button>{short}</button>", "<p>{sentence}</p>"], "comment": ["<div><p>{paragraph}</p></div><div><p>{sentence}</p></div>", "<ol><li>{sentence}</li><li>{paragraph}</li></ol>", "<h3>{short}</h3><p>{paragraph}</p>"],
}
#: Parts of the page that are not shown, and dialogs.
UNSEEN = ['<div hidden><p>{paragraph}</p></div>', '<div style="display: none"><p>{sentence}</p></div>', '<p aria-hidden="true">{sentence}</p>', "<dialog><p>{sentence}</p></dialog>", "<dialog open><h3>{short}</h3><p>{sentence}</p></dialog>"]
INSIDE = ['<div class="ad">{sentence}</div>', '<aside class="promo"><p>{sentence}</p></aside>', '<div class="social-share">{links}</div>', '<div class="related-links"><ul>{links}</ul></div>', '<div class="advertisement"><p>{sentence}</p></div>', '<nav class="toc"><ul>{links}</ul></nav>', '<form class="subscribe"><p>{sentence}</p></form>']


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(lo, hi)))


def _sentence(r: random.Random) -> str:
    return _words(r, 1, 14).capitalize() + "."


def _paragraph(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, 7)))


def _fill(r: random.Random, template: str) -> str:
    links = "".join((f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' if "<ul" in template or "<ol" in template else f'<a href="/{i}">{_words(r, 1, 3)}</a> ') for i in range(r.randint(2, 8)))
    return template.format(links=links, short=_words(r, 1, 3), sentence=_sentence(r), paragraph=_paragraph(r))


def _opaque(r: random.Random) -> str:
    """A name that says nothing."""
    return r.choice(["c-{}", "css-{}", "x{}", "b_{}", "sc-{}"]).format(r.randint(1, 99_999))


def _named(r: random.Random, kind: str) -> str:
    """A part of the page under one of the names of its kind, or now and then under one that says nothing."""
    said = r.random() < 0.85
    tag = {"menu": "nav", "foot": "footer", "side": "aside"}.get(kind, "div") if not said or r.random() < 0.2 else r.choice(["div", "section", "div"])
    attribute = r.choice(["class", "class", "id"])
    return f'<{tag} {attribute}="{r.choice(NAMES[kind].split()) if said else _opaque(r)}">{_fill(r, r.choice(KINDS[kind]))}</{tag}>'


def _content(r: random.Random) -> str:
    out = [f'<h1 data-y="1">{_words(r, 1, 10)}</h1>'] if r.random() < 0.7 else []
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        text = _paragraph(r)
        if kind < 0.55:
            out.append(f'<p data-y="1">{text}</p>')
        elif kind < 0.65:  # markup that is never closed
            out.append(f'<p data-y="1"><b>{_sentence(r)}<br><p data-y="1">{text}</p>')
        elif kind < 0.72:
            out.append(f'<h2 data-y="1">{_words(r, 1, 6)}</h2>')
        elif kind < 0.78:
            out.append("<ul>" + "".join(f'<li data-y="1">{_sentence(r)}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.83:
            out.append(f'<blockquote><p data-y="1">{text}</p></blockquote>')
        elif kind < 0.87:
            out.append("<table>" + "".join(f'<tr><td data-y="1">{_words(r, 1, 4)}</td><td data-y="1">{_words(r, 1, 3)}</td></tr>' for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.91:
            out.append(f'<pre data-y="1">{_words(r, 3, 12)}</pre>')
        elif kind < 0.95:
            out.append(f'<p data-y="1">{text} <a href="/x">{_words(r, 1, 4)}</a> {_sentence(r)}</p>')
        else:
            out.append(f'<div data-y="1">{text}</div>')
        if r.random() < 0.12:
            out.append(_fill(r, r.choice(INSIDE)))
    return "".join(out)


def compose(n: int, seed: int = 5) -> list[str]:
    """``n`` labelled pages."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        box = r.choice(CONTENT_BOXES)
        inner = box.replace("{t}", _words(r, 1, 8)).replace("{}", _content(r))
        before = [_fill(r, t) for t in r.sample(BEFORE, r.randint(0, 4))] + [_named(r, k) for k in r.sample(["menu", "notice", "advert", "side"], r.randint(0, 2))]
        after = [_fill(r, t) for t in r.sample(AFTER, r.randint(0, 4))] + [_named(r, k) for k in r.sample(["foot", "side", "advert", "comment", "notice"], r.randint(0, 2))]
        if r.random() < 0.3:
            r.choice([before, after]).append(_fill(r, r.choice(UNSEEN)))
        if r.random() < 0.35:
            inner = f'<div class="{r.choice(NAMES["content"].split()) if r.random() < 0.6 else _opaque(r)}">{inner}</div>'
        r.shuffle(before)
        r.shuffle(after)
        before, after = "".join(before), "".join(after)
        page = before + inner + after
        if r.random() < 0.25:
            page = f'<div class="{r.choice(["page", "container", "wrapper", "site", "layout"])}">{page}</div>'
        pages.append(f"<html><head><title>{_words(r, 1, 5)}</title></head><body>{page}</body></html>")
    return pages
