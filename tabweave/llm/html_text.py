"""Main text of HTML pages by a maximum-scoring contiguous token region.

A page is read as a sequence of text runs and tags.  Each word of a run scores the
log-odds, under a logistic model, of lying in main content; each tag scores a small
negative amount.  One linear scan finds the contiguous region with the largest total;
inside it, runs whose own words score negative (an advert between two paragraphs) are left
out.  Such a run costs the region at most INTERRUPT, however long it is.

Features of a run are the elements around it, the names in their class, id and role
attributes that the labelled pages hold, and of its block the share of linked words, the
length and whether it has sentences.  All weights are learned from labelled pages.  No
labelled pages exist here, so ``labelled_pages`` composes them: a fixed, bounded set of varied
layouts whose fragments are marked as content or not.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabweave.llm.batches import Rows

# Element names of HTML.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title")
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of their own name.
SIBLINGS = frozenset("li dt dd option tr td th".split())
#: Parts of compound names ("site-footer", "sidebar-left") that say nothing about the kind of content.
NEUTRAL = frozenset("site main top bottom left right box bar wrapper wrap container area section block list inner outer holder panel item col column primary secondary global page module the".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(svg)\b[^<>]*+(?<=/)>"
    rf"|<({'|'.join(RAW)})\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\2\b[^>]*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:[^<>\"'=]|=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|=(?!\s*+[\"']))*+)>|([^>]*+)(?:>|\Z))"
    r"|[^<]++|<",
    re.S | re.I,
)
NAMED = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
PART = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[^\W\d_]{2}[.!?…](?:\s|\Z)")
#: Bounds of a word's score, and the most that one run may cost a region.
LOW, HIGH, INTERRUPT = -2.0, 3.0, 1.0
#: Composed pages that the weights are learned from, and the kinds of run that a feature must occur in.
PAGES, LEAST = 240, 4


def name_of(token: str) -> str:
    """A class or id without its neutral parts and numbers: "site-footer-2" is "footer", "notice-board" stays."""
    parts = PART.findall(token.lower())
    return "-".join([p for p in parts if p not in NEUTRAL] or parts[:1])


def cues(name: str, attributes: str, inside: frozenset) -> frozenset:
    """Features that an element adds for everything inside it."""
    found = set()
    if name not in ("html", "body"):
        if name in BLOCKS:
            found.add("<header> in content" if name == "header" and ("<article>" in inside or "<main>" in inside) else f"<{name}>")
        if attributes and "=" in attributes:
            for m in NAMED.finditer(attributes):
                found.update(f".{n}" for token in (m[1] or m[2] or m[3] or "").split() if (n := name_of(token)))
    return frozenset(found)


def tokens(page: str) -> Iterator[tuple[str, str, frozenset, bool]]:
    """("text", run, features of the elements around it, whether linked) or ("tag", element name, ...), in linear time."""
    stack: list[tuple[str, frozenset, bool]] = [("", frozenset(), False)]
    count: Counter = Counter()

    def close(name: str) -> None:
        while True:
            gone = stack.pop()[0]
            count[gone] -= 1
            if gone == name:
                return

    for m in TOKEN.finditer(page):
        name = m[4]
        if name is None:
            run = m[0]
            if m[1] is None and m[2] is None and (run[0] != "<" or run == "<"):
                yield "text", run, stack[-1][1], stack[-1][2]
            continue
        name, attributes = name.lower(), m[5] if m[5] is not None else m[6]
        if m[3]:
            if count[name]:
                close(name)
        else:
            block = name in BLOCKS
            if block and count["p"] and name not in VOID:
                close("p")
            if name in SIBLINGS and stack[-1][0] == name or name == "a" and count["a"]:
                close(name)
            _, inside, linked = stack[-1]
            named = "=" in attributes
            if name not in VOID and not attributes.endswith("/") and (block or name == "a" or named):
                new = cues(name, attributes, inside)
                stack.append((name, inside | new if new else inside, linked or name == "a"))
                count[name] += 1
        yield "tag", name, stack[-1][1], stack[-1][2]


def runs(page: str) -> tuple[list[tuple[str, str]], list[tuple[int, frozenset, tuple[str, ...], int]]]:
    """The page's tokens as (kind, value), and for each text run with words its place among them, the features
    of its elements, those of its block, and its number of words."""
    out: list[tuple[str, str]] = []
    texts: list[tuple[int, frozenset, tuple[str, ...], int]] = []
    held: list[tuple[int, frozenset, int, bool, str]] = []

    def told() -> None:
        if held:
            n, linked = sum(h[2] for h in held), sum(h[2] for h in held if h[3])
            block = (f"links {linked * 3 // n}", f"words {min(n.bit_length(), 6)}", "sentences" if any(SENTENCE.search(h[4]) for h in held) else "no sentence")
            texts.extend((at, path, block, k) for at, path, k, _, _ in held)
            held.clear()

    for kind, value, path, linked in tokens(page):
        if kind == "tag" and value in BLOCKS:
            told()
        elif kind == "text" and (k := len(value.split())):
            held.append((len(out), path, k, linked, value))
        out.append((kind, value))
    told()
    return out, texts


# The names below are those of the composed pages' elements; their weights are learned like all others.
FRAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs nav-links menu-items subnav",
    "header": "header masthead topbar branding banner-header",
    "footer": "footer copyright colophon legal footer-links credits",
    "aside": "sidebar widget related related-posts related-articles recommended trending popular popular-posts most-read rail more-stories",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion ad-slot banner",
    "notice": "notice cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr alert popup modal overlay newsletter newsletter-signup subscribe paywall",
    "comments": "comment comments reply replies discussion disqus-thread respond commentlist comment-body user-comments reader-comments",
    "form": "form search login signup search-form contact-form",
    "share": "share social sharing share-buttons social-links toolbar tags meta post-meta",
}
CONTENT = "content article post entry story entry-content post-content article-body article-content story-body text body-text post-body articlebody"


def labelled_pages(pages: int = PAGES, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (fragment, is it main content), composed from site frames of many layouts; every call gives the same."""
    rng = random.Random(seed)
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()

    def prose(low: int, high: int) -> str:
        out = rng.choices(words, k=rng.randint(low, high))
        for i in range(8, len(out), 9):
            out[i] += "."
        return " ".join(out).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def other() -> str:  # a name that says nothing
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{rng.randrange(99)}">{" ".join(rng.choices(words, k=rng.randint(1, 5)))}</a></li>' for _ in range(n))

    def named(kind: str, element: str = "div") -> str:
        name = rng.choice(FRAMES[kind].split())
        return f'<{element} {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "x ", "site-"])}{name}">'

    def paragraph(low: int = 2, high: int = 60) -> str:
        text = prose(low, high)
        if rng.random() < 0.25:
            text = re.sub(r"\b(dolor|magna)\b", r'<a href="/q">\1</a>', text, count=2)
        return f"<p{rng.choice(['', '', f' class={other()}'])}>{text}</p>"

    def framed(kind: str) -> str:
        low, high = {"ad": (1, 14), "notice": (3, 30), "comments": (2, 45), "share": (1, 5), "footer": (2, 20), "header": (1, 8), "form": (1, 6)}.get(kind, (1, 12))
        inner = {"nav": f"<ul>{links(rng.randint(3, 9))}</ul>", "aside": f"<h3>{prose(1, 3)}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", paragraph(3, 25)]), "form": f"<label>{prose(1, 4)}</label><input name=q><button>{prose(1, 2)}</button>", "share": f'<a href="/s">{prose(1, 2)}</a> <a href="/t">{prose(1, 2)}</a>'}.get(kind) or "".join(rng.choice([paragraph(low, high), f"<div>{prose(low, high)}</div>"]) for _ in range(rng.randint(1, 4 if kind == "comments" else 2)))
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "notice": "dialog"}.get(kind)
        if own and rng.random() < 0.5:
            opening = f"<{own}>" if own not in ("section", "dialog") else named(kind, own)
            return f"{opening}{inner}</{own}>"
        return f"{named(kind)}{inner}</div>"

    def body() -> str:
        return rng.choice([
            lambda: paragraph(), lambda: paragraph(), lambda: paragraph(), lambda: f"<h2>{prose(2, 7)}</h2>{paragraph()}", lambda: f"<ul><li>{prose(3, 12)}</li><li>{prose(3, 12)}</li></ul>",
            lambda: f"<table><tr><th>{prose(1, 3)}</th><td>{prose(1, 3)}</td></tr></table>", lambda: f"<blockquote><p>{prose(5, 30)}</p></blockquote>", lambda: f"<div>{prose(10, 50)}</div>",
            lambda: f"<pre>{prose(3, 20)}</pre>", lambda: f"<figure><img src=x><figcaption>{prose(3, 12)}</figcaption></figure>", lambda: f'<div class="{other()} {rng.choice(words)}-{other()}">{paragraph()}</div>',
        ])()

    out = []
    for _ in range(pages):
        name = rng.choice(CONTENT.split())
        a, z = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), (f'<article class="{name}">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), ("<div>", "</div>"), ("<div>", "</div>"), ("", ""), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")])
        title = f"<h1>{prose(3, 9)}</h1>"
        if "article" in a or "main" in a:
            title = rng.choice([title, f"<header>{title}</header>"])
        page = [("<html><head><meta charset=utf-8></head><body>", False)]
        page += [(framed(k), False) for k in rng.sample(["header", "nav", "ad", "notice", "form", "aside"], rng.randint(1, 5))]
        page.append((a + title, True))
        for _ in range(rng.randint(2, 8)):
            page.append((body(), True))
            if rng.random() < 0.2:
                page.append((framed(rng.choice(["ad", "aside", "share", "form", "notice", "nav"])), False))
        page.append((z, True))
        page += [(framed(k), False) for k in rng.sample(["comments", "aside", "share", "ad", "footer", "nav"], rng.randint(1, 5))]
        out.append([*page, (f"<footer><p>&copy; {prose(1, 8)}</p></footer></body></html>", False)])
    return out


@lru_cache(maxsize=1)
def train(pages: int = PAGES, ridge: float = 2e-5, steps: int = 30) -> dict:
    """Weights from labelled pages: a penalised logistic model of words by Newton steps, and for each tag minus its
    smoothed share of uses outside content.  A few hundred features; runs once a driver."""
    rows: Counter = Counter()
    uses: dict[str, list[int]] = {}
    for page in labelled_pages(pages):
        ends = np.cumsum([len(f) for f, _ in page])
        whole = "".join(f for f, _ in page)
        parts, texts = runs(whole)
        places, at = [], 0
        for kind, value in parts:
            at = whole.index(value, at) if kind == "text" else whole.lower().index(value, at)
            places.append(page[int(np.searchsorted(ends, at, side="right"))][1])
            at += len(value)
            if kind == "tag":
                uses.setdefault(value, [0, 0])[int(places[-1])] += 1
        for i, path, block, n in texts:
            rows[path, block, places[i]] += n**0.5  # long runs count more, but not by every word
    seen = Counter(f for path, block, _ in rows for f in (*path, *block))
    names = sorted(f for f, k in seen.items() if k >= LEAST)
    column = {f: i + 1 for i, f in enumerate(names)}
    X = np.zeros((len(rows), len(names) + 1))
    X[:, 0] = 1.0
    for i, (path, block, _) in enumerate(rows):
        X[i, [column[f] for f in (*path, *block) if f in column]] = 1.0
    y, n = np.array([float(g) for *_, g in rows]), np.array(list(rows.values()))
    n /= n.sum()
    w, penalty = np.zeros(X.shape[1]), ridge * np.eye(X.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        w -= np.linalg.solve((X.T * (n * p * (1 - p))) @ X + penalty, X.T @ (n * (p - y)) + penalty @ w)
    return {"start": float(w[0]), "words": dict(zip(names, map(float, w[1:]))), "tags": {t: -0.02 - 0.08 * (out + 1) / (out + inside + 2) for t, (out, inside) in uses.items()}, "other": -0.1}


class Extractor:
    """Applies trained weights to pages; scores of feature sets are memoised up to REMEMBER of them."""

    REMEMBER = 100_000

    def __init__(self, model: dict):
        self.model, self.memo = model, {}

    def word(self, path: frozenset, block: tuple[str, ...]) -> float:
        key = path, block
        if key not in self.memo:
            if len(self.memo) >= self.REMEMBER:
                self.memo.clear()
            known = self.model["words"]
            total = self.model["start"] + sum(known.get(f, 0.0) for f in sorted(path)) + sum(known.get(f, 0.0) for f in block)
            self.memo[key] = min(max(total, LOW), HIGH)
        return self.memo[key]

    def scored(self, page: str) -> tuple[list[tuple[str, str]], dict[int, float], np.ndarray]:
        """Tokens, the word score of each text run by its place, and the score of each token."""
        parts, texts = runs(page)
        tags, other = self.model["tags"], self.model["other"]
        score = np.array([tags.get(value, other) if kind == "tag" else 0.0 for kind, value in parts])
        words = {}
        for i, path, block, n in texts:
            words[i] = self.word(path, block)
            score[i] = max(n * words[i], -INTERRUPT)
        return parts, words, score

    def text(self, page: str | None) -> str:
        """Main text: blocks in page order, joined by one space.  A null, empty or
        tag-only page gives the empty string; text without any markup is content."""
        if not page:
            return ""
        if "<" not in page:
            return " ".join(html.unescape(page).split())
        parts, words, score = self.scored(page)
        begin, end = best_region(score)
        out = []
        for i in range(begin, end):
            kind, value = parts[i]
            if kind == "tag":
                out.append(" " if value in BLOCKS else "")
            elif words.get(i, 1.0) > 0:  # runs of white space alone separate inline elements
                out.append(html.unescape(value) if "&" in value else value)
        return " ".join("".join(out).split())


def best_region(score) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest positive total, the first of equal ones; (0, 0) if there is none."""
    best, total, begin, end, start = 0.0, 0.0, 0, 0, 0
    for i, s in enumerate(score):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    Only those three input columns are read, so further columns cannot clash.
    Null or empty html gives text "" and n_chars 0; null ids and urls stay null;
    repeated rows each give a row; an empty table gives an empty table.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, out = Extractor(model), Rows(SCHEMA)
        for b in batches:
            for page_id, url, page in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist()):
                text = extract.text(page)
                yield from out.add((page_id, url, text, len(text)), len(text))
        yield from out.flush()

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
