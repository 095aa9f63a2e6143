"""Trains the block labeller on generated pages: python -m loomwork.llm.html_train [pages] [epochs].

Pages are drawn from many layouts: wrappers, names of classes, what surrounds an article and what stands within
it (adverts, notices, share bars, related links, comments). Words are invented, and the same for main text and
the rest, so the labeller has to learn layout, names and shape.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from loomwork.llm.html import HIDDEN, INPUT, PATH_SIZE, WORD_SIZE, blocks, forward, lstm, reversed_pages, vectors

MARK = "⁠"  # stands before each piece of main text in a generated page, and is taken out again

# Names that sites give to parts of a page. Fixed values.
NAMES = {
    "main": ["content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "article", "text", "body-text", "entry", "blog-post", "page-content"],
    "menu": ["menu", "nav", "navbar", "main-menu", "navigation", "topnav", "site-nav", "breadcrumb", "breadcrumbs", "tabs", "pager", "pagination", "skip-link", "toc"],
    "header": ["header", "site-header", "masthead", "top", "banner", "branding", "topbar", "site-title", "logo"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal", "footer-links", "credits"],
    "side": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "most-read", "popular", "trending", "rail", "more-stories", "tags", "archive", "read-more"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "banner-notice", "popup", "modal", "overlay", "paywall", "message", "privacy"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "adsbox", "partner", "outbrain", "sponsor"],
    "form": ["newsletter", "signup", "search", "login", "subscribe", "contact-form", "search-form", "subscription"],
    "comment": ["comments", "comment", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments", "comment-body", "user-comments"],
    "share": ["share", "social", "social-links", "share-bar", "sharing", "follow"],
}
PARTS = ["the", "er", "ti", "on", "an", "sch", "ver", "de", "que", "ción", "eau", "os", "ä", "ing", "ly", "re", "ment", "lo", "ka", "mi", "zu", "st", "ra", "bel"]
SIGNS = ["%%%", "***", "###", "!!", "&amp;&amp;", "$$$", "|"]


class Page:
    def __init__(self, r: random.Random):
        self.r = r

    def words(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        out = ["".join(self.r.choice(PARTS) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        if self.noise:
            out = [w + self.r.choice(SIGNS) for w in out]
        if self.shout:
            out = [w.upper() for w in out]
        return " ".join(out)

    def sentences(self, n: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(".....?!,") for _ in range(n))

    def named(self, kind: str, tag: str | None = None) -> tuple[str, str]:
        tag = tag or self.r.choice(["div", "div", "div", "section", "ul", "span"] if kind != "main" else ["div", "section", "div"])
        tag = "div" if tag == "span" else tag
        name = self.r.choice(NAMES[kind])
        how = self.r.random()
        other = self.r.choice(["", " clearfix", " col-8", " row", " container", " box", " inner"])
        attribute = f'id="{name}"' if how < 0.25 else f'class="{name}{other}"'
        if kind == "menu" and how > 0.9:
            attribute = 'role="navigation"'
        return f"<{tag} {attribute}>", f"</{tag}>"

    def inline(self, text: str) -> str:
        if self.r.random() < 0.35:
            w = text.split(" ")
            i = self.r.randrange(len(w))
            w[i] = self.r.choice(['<b>%s</b>', '<i>%s</i>', '<a href="/x">%s</a>', "<em>%s</em>", "<span>%s</span>", "<b>%s", "%s<br>"]) % w[i]
            text = " ".join(w)
        return text

    def main(self, tag: str, text: str) -> str:
        return f"<{tag}>{MARK}{text}" + ("" if tag in ("p", "li") and self.r.random() < 0.08 else f"</{tag}>")

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 6)}</a></li>' for i in range(n)) + "</ul>"

    def junk(self, kind: str) -> str:
        r = self.r
        tags = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
        plain = kind in tags and r.random() < 0.5
        a, b = (f"<{tags[kind]}>", f"</{tags[kind]}>") if plain else self.named(kind, tags.get(kind) if r.random() < 0.4 else None)
        if kind == "menu":
            body = self.links(r.randint(2, 10)) if r.random() < 0.8 else " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 8)))
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 5)}</h1>", f"<div>{self.words(1, 5)}</div>", f"<a href='/'>{self.words(1, 3)}</a><p>{self.words(2, 8)}</p>"])
            if r.random() < 0.3:
                body += self.links(r.randint(2, 6))
        elif kind == "footer":
            body = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1)}", f"<p>&copy; 2024 {self.words(1, 4)}</p>", self.links(r.randint(2, 8)), f"<p>{self.sentences(r.randint(1, 3))}</p>"])
        elif kind == "side":
            body = r.choice([self.links(r.randint(2, 8)), f"<h3>{self.words(1, 4)}</h3>" + self.links(r.randint(2, 6)), f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(r.randint(1, 3))}</p>", f"<p>{self.sentences(r.randint(1, 4))}</p>"])
        elif kind == "form":
            body = f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 2)}</button>"
            body = (f"<p>{self.sentences(1)}</p>" if r.random() < 0.6 else "") + body + ("<select><option>" + "<option>".join(self.words(1, 2) for _ in range(3)) + "</select>" if r.random() < 0.3 else "")
            if not plain and "<form" not in a and r.random() < 0.7:
                body = f"<form>{body}</form>"
        elif kind == "comment":
            each = r.choice(["<div class='comment'>%s</div>", "<li>%s</li>", "<p>%s</p>", "<article>%s</article>"])
            body = "".join(each % (r.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>"]) + r.choice(["%s", "<p>%s</p>"]) % self.sentences(r.randint(1, 5))) for _ in range(r.randint(1, 6)))
            body = r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>"]) + body
        elif kind == "share":
            body = " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 5)))
        else:
            body = r.choice([self.sentences(r.randint(1, 3)), f"<p>{self.sentences(r.randint(1, 3))}</p>", self.words(1, 12), f'<a href="/x">{self.words(2, 8)}</a>'])
            if kind == "notice" and r.random() < 0.4:
                body += f"<button>{self.words(1, 2)}</button>"
        return (f"<!-- {kind} -->" if r.random() < 0.2 else "") + a + body + b

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.75:
            title = self.main(r.choice(["h1", "h1", "h1", "h2"]), self.words(2, 12))
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        if r.random() < 0.15:
            out.append(self.junk("share"))
        n = r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20])
        for i in range(n):
            kind = r.random()
            if kind < 0.8 or i == 0:
                long = r.choice([0, 1, 1, 2, 4, 6, 8])
                out.append(self.main("p" if r.random() < 0.93 else "div", self.inline(self.sentences(long) if long else self.words(1, 6))))
            elif kind < 0.86:
                out.append(self.main(r.choice(["h2", "h3", "h4"]), self.words(1, 8)))
            elif kind < 0.91:
                out.append("<ul>" + "".join(self.main("li", self.inline(self.words(1, 20))) for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.94:
                out.append("<blockquote>" + self.main("p", self.sentences(r.randint(1, 3))) + "</blockquote>")
            elif kind < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(self.main("td", self.words(1, 4)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.97:
                out.append(self.main("pre", self.words(4, 30)))
            else:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.words(3, 12)}</figcaption></figure>")
            if r.random() < 0.07:
                out.append(self.junk(r.choice(["advert", "advert", "notice", "side", "share", "form"])))
        if r.random() < 0.2:
            out.append(self.junk(r.choice(["share", "side", "comment", "form"])))
        return "".join(out)

    def build(self) -> str:
        r = self.r
        self.noise, self.shout = r.random() < 0.08, r.random() < 0.06
        before = [self.junk(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.75), ("form", 0.15), ("advert", 0.45), ("menu", 0.15), ("side", 0.15)) if r.random() < p]
        if r.random() < 0.4:
            r.shuffle(before)
        after = [self.junk(k) for k, p in (("share", 0.15), ("comment", 0.3), ("side", 0.35), ("advert", 0.3), ("form", 0.15), ("notice", 0.12), ("footer", 0.75)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(after)
        wrap = r.random()
        if r.random() < 0.02:
            body = ""
        elif wrap < 0.5:
            body = f"<article>{self.article()}</article>"
        elif wrap < 0.65:
            body = f"<main>{self.article()}</main>"
        elif wrap < 0.92:
            a, b = self.named("main")
            body = a + self.article() + b
        else:
            body = self.article()
        if r.random() < 0.15:
            body = f"<main>{body}</main>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div class="{r.choice(["container", "wrapper", "row", "page", "inner", "layout", "col"])}">{body}</div>'
        title = f"<title>{self.words(2, 8)}</title>"
        page = f"<!DOCTYPE html><html><head>{title}<style>p{{}}</style><script>var t='</p>';</script></head><body>" + "".join([*before, body, *after])
        page += "</body></html>" if r.random() < 0.9 else ""
        if r.random() < 0.05:
            page = page[: int(len(page) * r.uniform(0.5, 1))]
        return page


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        found = blocks(Page(r).build())
        y = np.array([MARK in text for _, text, _ in found], dtype=np.float32)
        x = vectors([[(path, text.replace(MARK, "").strip() or "-", link) for path, text, link in found]])[0]
        if len(x):
            out.append((x, y))
    return out


def _back(d: np.ndarray, kept: list, out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of an LSTM's weights from those of its hidden states d (steps, pages, hidden)."""
    gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros_like(d[0]), np.zeros_like(d[0])
    for t in range(len(d) - 1, -1, -1):
        h0, c0, i, f, o, g = kept[t]
        dh = dh + d[t]
        tc = np.tanh(f * c0 + i * g)
        dc = dc + dh * o * (1 - tc**2)
        z = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        gw += x[t].T @ z
        gu += h0.T @ z
        gb += z.sum(axis=0)
        dh, dc = z @ u.T, dc * f
    return gw, gu, gb


def train(n: int = 6000, epochs: int = 6, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = sorted(examples(n, seed), key=lambda e: len(e[0]))
    m = {}
    for k in "fb":
        m["w" + k] = rng.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(40)
        m["u" + k] = rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        m["b" + k] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    m["v"], m["c"] = rng.normal(size=2 * HIDDEN) / 5, np.zeros(1)
    mean, square, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    for epoch in range(epochs):
        loss = wrong = total = 0
        for b in rng.permutation(len(batches)):
            sizes = np.array([len(x) for x, _ in batches[b]])
            x, y = np.zeros((sizes.max(), len(sizes), INPUT)), np.zeros((sizes.max(), len(sizes)))
            for k, (own, label) in enumerate(batches[b]):
                x[: len(own), k], y[: len(own), k] = own, label
            mask = np.arange(len(x))[:, None] < sizes
            # names of classes are dropped at times, so layout has to do
            x = x * (rng.random((1, len(sizes), INPUT)) > 0.05)
            # nor may the words of these pages count for much: other pages have others
            w = slice(PATH_SIZE, PATH_SIZE + WORD_SIZE)
            x[:, :, w] = np.clip(x[:, :, w] + rng.normal(size=(1, len(sizes), WORD_SIZE)) * 0.5 + rng.normal(size=x[:, :, w].shape) * 0.5, -1, 1)
            kf, kb = [], []
            xb = reversed_pages(x, sizes)
            hf, hb = lstm(x, m["wf"], m["uf"], m["bf"], kf), lstm(xb, m["wb"], m["ub"], m["bb"], kb)
            h = np.concatenate([hf, reversed_pages(hb, sizes)], axis=2)
            p = 1 / (1 + np.exp(-np.clip(h @ m["v"] + m["c"], -30, 30)))
            d = (p - y) * mask / mask.sum()
            loss += -(np.log(np.where(y > 0, p, 1 - p) + 1e-12) * mask).sum()
            wrong += ((p >= 0.5) != (y > 0))[mask].sum()
            total += mask.sum()
            dh = d[:, :, None] * m["v"]
            grad = {"v": (h * d[:, :, None]).sum(axis=(0, 1)), "c": np.array([d.sum()])}
            grad["wf"], grad["uf"], grad["bf"] = _back(dh[:, :, :HIDDEN], kf, hf, x, m["wf"], m["uf"])
            grad["wb"], grad["ub"], grad["bb"] = _back(reversed_pages(dh[:, :, HIDDEN:], sizes), kb, hb, xb, m["wb"], m["ub"])
            step += 1
            rate = 0.004 * min(1, step / 100) * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g**2
                m[k] = m[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / total:.4f}, wrong blocks {wrong / total:.4%}", flush=True)
    return {k: v.astype(np.float32) for k, v in m.items()}


def accuracy(model: dict[str, np.ndarray], n: int = 500, seed: int = 99) -> float:
    """Share of right blocks on pages of another seed."""
    right = total = 0
    for x, y in examples(n, seed):
        p = forward(x[:, None], np.array([len(x)]), model)[:, 0]
        right += ((p >= 0.5) == (y > 0)).sum()
        total += len(y)
    return right / total


if __name__ == "__main__":
    found = train(*map(int, sys.argv[1:3]))
    print(f"held-out pages: {accuracy(found):.4%} of blocks right")
    np.savez_compressed(Path(__file__).with_name("html_model.npz"), **{k: v.astype(np.float16) for k, v in found.items()})
