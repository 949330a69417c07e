"""Labelled pages from which html_text learns its weights: article text stands between content marks.

The pages are put together by rule from layouts, kinds of article and parts around them, with a fixed seed; only their
structure is learned from, so the words are made up."""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def links(k: int) -> str:
        return "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(k))

    def prose(low: int, high: int) -> str:
        return f"<p>{words(low, high)}.</p>"

    def block() -> str:
        kind = rng.randrange(13)
        return (
            prose(10, 60) if kind < 3 else f"<h2>{words(2, 6)}</h2>{prose(10, 40)}" if kind == 3 else f"<ul><li>{words(4, 15)}</li><li>{words(4, 15)}</li></ul>" if kind == 4
            else f"<blockquote>{words(8, 30)}</blockquote>" if kind == 5 else f"<table><tr><td>{words(2, 8)}</td><td>{words(2, 8)}</td></tr></table>" if kind == 6
            else f"<p>{words(5, 20)} <a href='/x'>{words(2, 5)}</a> {words(5, 20)}.</p>" if kind == 7 else named() if kind == 8
            else f"<p>{words(1, 5)}</p>" if kind < 11 else f"<p><b>{words(1, 4)}</b><br>{words(1, 4)}</p>" if kind == 11 else f"{words(10, 40)}.<br>{words(10, 40)}."
        )

    def named() -> str:
        # names of article parts that hold a word which marks other parts
        name = rng.choice(["popular-music", "share-prices", "follow-up", "alert-systems", "promotion-history", "legal-text", "dialog", "related-work", "header-note", "like", "hero", "form-factor", "menu-of-the-day"])
        return f"<{(tag := rng.choice(['div', 'section', 'div']))} class='{name}'>{rng.choice([prose(5, 30), words(4, 20) + '.', f'<p>{words(1, 5)}</p>' + prose(6, 20)])}</{tag}>"

    def advert() -> str:
        name = rng.choice(["ad", "advert", "sponsored", "promo banner", "ad-slot", "newsletter-box", "share-bar", "notice"])
        return rng.choice([f"<div class='{name}'>{words(3, 12)}</div>", f"<div class='{name}'>{prose(5, 25)}<a href='/b'>{words(1, 3)}</a></div>", f"<aside>{prose(4, 15)}</aside>"])

    def before() -> str:
        parts = [f"<nav><ul>{links(5)}</ul></nav>", f"<div class='menu'><ul>{links(4)}</ul></div>", f"<header><a href='/'>{words(1, 2)}</a><p>{words(3, 8)}</p></header>", f"<div id='header'><p>{words(2, 6)}</p></div>",
                 f"<div class='cookie-notice'>{prose(8, 30)}</div>", f"<form><label>{words(1, 2)}</label><button>{words(1, 2)}</button></form>", f"<form>{words(1, 4)} <input><button>{words(1, 2)}</button></form>", f"<form><p>{words(1, 4)}:</p><input></form>", f"<div hidden>{prose(4, 10)}</div>", f"<div class='breadcrumb'><a href='/'>{words(1, 2)}</a> {words(1, 2)}</div>",
                 f"<div><a href='/a'>{words(1, 2)}</a> <a href='/b'>{words(1, 2)}</a> <a href='/c'>{words(1, 2)}</a></div>", f"<div role='navigation'><p>{words(1, 3)}</p></div>", advert()]
        return "".join(rng.sample(parts, rng.randint(1, 4)))

    def comments() -> str:
        said = "".join(f"<div class='comment'>{prose(5, 40)}</div>" for _ in range(rng.randint(1, 4)))
        plain = "".join(f"<li>{words(5, 30)}</li>" for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<section id='comments'><h3>{words(1, 2)}</h3>{said}</section>", f"<ol class='commentlist'>{plain}</ol>", f"<div class='comments'><article class='comment'>{prose(5, 30)}</article></div>"])

    def after() -> str:
        parts = [f"<footer><p>{words(3, 15)}</p></footer>", f"<div id='footer'>{prose(4, 15)}<a href='/t'>{words(1, 2)}</a></div>", f"<aside><h3>{words(1, 3)}</h3><ul>{links(4)}</ul></aside>", f"<div class='sidebar'>{prose(5, 15)}<ul>{links(3)}</ul></div>",
                 f"<div class='related'><h4>{words(1, 3)}</h4>{prose(5, 15)}</div>", f"<div class='share'>{words(2, 6)}</div>", f"<div class='newsletter'>{prose(4, 12)}</div>", f"<div class='login-form'>{prose(4, 12)}</div>", comments(), comments(), advert(),
                 f"<div class='legal'>{prose(5, 20)}</div>", f"<div class='popup'>{prose(5, 15)}</div>"]
        soft = rng.choice(["", "", f"<div class='{rng.choice(['popular', 'trending-now', 'follow-us', 'promotion', 'tabs'])}'><ul>{links(3)}</ul></div>"])
        return "".join(rng.sample(parts, rng.randint(1, 5))) + soft

    def article() -> str:
        blocks = [block() for _ in range(rng.choice([1, 2, 3, 4, 5, 6]))]
        if rng.random() < 0.6:
            blocks.insert(rng.randint(1, len(blocks)), f"<!--/content-->{advert()}<!--content-->")
        body = f"<h1>{words(2, 8)}</h1>" * (rng.random() < 0.7) + "".join(blocks)
        inner = f"<!--content-->{body}<!--/content-->"
        tail = rng.choice(["", "", comments(), f"<footer>{words(3, 8)}</footer>", f"<div class='share'>{words(2, 5)}</div>"])
        kind = rng.randrange(7)
        return (
            f"<article>{inner}{tail}</article>" if kind < 2 else f"<main>{inner}{tail}</main>" if kind == 2 else f"<div id='content'>{inner}{tail}</div>" if kind == 3
            else f"<div class='post'>{inner}{tail}</div>" if kind == 4 else f"<div><div>{inner}</div>{tail}</div>" if kind == 5 else inner + tail
        )

    def page() -> str:
        body = article()
        if rng.random() < 0.25:
            body = f"<div class='{rng.choice(['has-ads', 'with-sidebar', 'no-comments', 'layout menu-left', 'legal-page', 'popular'])}'>{body}</div>"
        whole = before() + rng.choice(["", prose(4, 12)]) * ("<article" in body or "<main" in body) + body + after()
        if rng.random() < 0.2:
            whole = f"<form id='page'>{whole}</form>"
        return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{whole}</body></html>"

    return [page() for _ in range(n)]
