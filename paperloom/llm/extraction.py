"""Main text of web pages by a recurrent labeller of blocks.

A page is the sequence of its leaf blocks (:mod:`.markup`).  A bidirectional LSTM in numpy reads for each block the sum of
vectors of its tag path (elements and the words of their classes, ids and roles, hashed), the mean of hashed word vectors, and a
few measures of form; from both directions' states it decides whether the block is main text, so every decision sees the whole page.

No page comes with labels.  The labels of a bounded sample of pages (``SAMPLE`` pages of ``PAGE`` code points at most, those with the
smallest hashed ids) are read from its elements: what lies in an article or main element is main text.  Each page is also
dressed anew at random: its blocks are set among menus, notices, adverts, forms, comments and sidebars, in containers that need not
be article or main, so that the labeller learns from names, form and neighbours and not from one layout.

Defined results: null and empty pages, and pages without main text, have an empty text; repeated rows and null ids are kept; extra
columns are not returned; an empty table has no rows; if no page of the sample has an article or main element, its paragraphs outside
of menus and the like are taken for main text.  A page of any length is labelled whole: its states are computed in steps of ``STEPS``
blocks, which carry over.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .markup import Leaf, leaves

#: Pages to learn from and the length of one; blocks of one in training; blocks of a page that are computed at once.
SAMPLE, PAGE, WINDOW, STEPS = 300, 20_000, 48, 4096
BUCKETS, PATHS, WORDS, FORM, HIDDEN = 2048, 16, 8, 14, 20
WIDTH = PATHS + WORDS + FORM

# Names of containers and phrases that pages use, by what they hold.
NAMES = {
    "header": "header masthead topbar branding logo site top",
    "nav": "nav navbar menu navigation breadcrumb tab link",
    "notice": "cookie consent notice gdpr alert popup modal banner overlay announcement warning privacy",
    "advert": "ad advert advertisement sponsor sponsored promo promotion banner adsense partner commercial",
    "sidebar": "sidebar side widget related recommended trending popular rail secondary recent archive tag",
    "share": "share social toolbar action follow",
    "form": "form newsletter subscribe signup search login contact field",
    "comments": "comment response reply discussion disqus feedback thread respond reader",
    "footer": "footer bottom copyright legal credit colophon foot",
}
MAIN = "article content post entry main body story text page primary single blog prose news".split()
PHRASES = {
    "header": "Skip to content|Search|Welcome|Daily News|My Site|Menu|Menü|Bienvenue|Inicio",
    "nav": "Home|About|About us|Contact|Products|Services|Blog|News|Login|Sign up|Sports|Culture|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Contacto",
    "notice": "We use cookies to improve your experience.|Accept all|Accept cookies|This site uses cookies. By continuing you agree to our privacy policy.|Wir verwenden Cookies.|Ce site utilise des cookies.|Utilizamos cookies.|Got it|Your browser is out of date.",
    "advert": "Advertisement|Sponsored|Buy now|Limited offer: 50% off!|Anzeige|Publicité|Publicidad|Click here|Special offer for subscribers|Ad",
    "sidebar": "Related articles|Most popular|Recent posts|Trending|You may also like|Archives|Tags|Read more|More stories|Categories|Ähnliche Artikel|Articles liés",
    "share": "Share|Tweet|Share on Facebook|Email|Print|Follow us|Teilen|Partager|Compartir|Copy link",
    "form": "Your email|Subscribe|Subscribe to our newsletter|Search|Name|Send|Password|Log in|Sign up for free|E-Mail|Abonnieren|S'abonner|Submit",
    "comments": "Comments|3 Comments|Leave a comment|Reply|Log in to reply|Leave a reply|Kommentare|Commentaires|Comentarios|Anonymous says:|Posted by user1|Great article!|Thanks for sharing.|I disagree with this.|First!",
    "footer": "© 2024 Example Inc.|All rights reserved.|Privacy policy|Terms of use|Imprint|Contact|Impressum|Mentions légales|Powered by Example|Back to top|© example.com",
}
PHRASES = {kind: text.split("|") for kind, text in PHRASES.items()}
SHELLS = {
    "header": ["header", "div", "div"], "nav": ["nav", "nav", "ul", "div"], "notice": ["div", "div", "section", "dialog"], "advert": ["div", "div", "aside", "section"], "sidebar": ["aside", "div", "section"],
    "share": ["div", "ul"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul"], "footer": ["footer", "footer", "div"],
}
SEMANTIC = {"header", "nav", "aside", "form", "footer", "dialog"}
SIDE = frozenset("nav header footer aside form dialog button select textarea title menu".split()) | {f".{w}" for kind in NAMES for w in NAMES[kind].split()} - {".text", ".top", ".page", ".site"}


def from_elements(page: list[Leaf]) -> list[int] | None:
    """1 for blocks within an article or main element and 0 for all others; None without such an element."""

    def main(path: tuple[str, ...]) -> int:
        at = max((k for k, x in enumerate(path) if x in ("article", "main", ".article", ".main")), default=None)
        return int(at is not None and not any(x in SIDE and x != "header" for x in path[at + 1 :]))

    found = [main(x.path) for x in page]
    return found if any(found) else None


class Dresser:
    """Sets main blocks of pages into layouts drawn at random."""

    def __init__(self, seed: int, prose: list[str], plain: list[str]):
        self.pick, self.prose, self.plain = random.Random(seed), prose or ["Text."], plain or ["Text"]

    def classes(self, words: list[str]) -> tuple[str, ...]:
        return tuple("." + w for w in self.pick.sample(words, min(len(words), self.pick.choice((1, 1, 1, 2)))))

    def aside(self, kind: str, above: tuple[str, ...]) -> list[tuple[Leaf, int]]:
        """A container of blocks that aren't main text."""
        pick, shell = self.pick, self.pick.choice(SHELLS[kind])
        bare = pick.random() < (0.4 if shell in SEMANTIC else 0.1 if kind in ("nav", "footer", "share") else 0)
        path = (*above, shell, *(() if bare else self.classes(NAMES[kind].split())))
        out = []
        if pick.random() < (0.7 if kind == "comments" else 0.3):
            out.append((Leaf((*path, pick.choice(("h2", "h3", "h4", "p"))), pick.choice(PHRASES[kind]), 0), 0))
        inner = {"nav": ("ul", "li"), "share": ("li",), "comments": ("li",)}.get(kind, ()) if pick.random() < 0.7 else ()
        for _ in range(pick.choice((1, 1, 2, 3, 4)) if kind not in ("nav", "comments") else pick.randrange(1, 9)):
            if kind in ("comments", "advert", "sidebar", "notice") and pick.random() < 0.75:
                whole = pick.choice(self.prose).split(". ")
                text = ". ".join(whole[: pick.choice((1, 1, 2, 3))])[: pick.choice((80, 200, 500))]
            else:
                text = pick.choice(PHRASES[kind]) if pick.random() < 0.7 else pick.choice(self.plain)
            tag = () if inner and pick.random() < 0.6 else (pick.choice(("p", "div", "p", "span")),) if kind != "form" else (pick.choice(("label", "button", "p", "option")),)
            tag = tuple(x for x in tag if x != "span")
            linked = len(text) if kind in ("nav", "share") or kind in ("sidebar", "footer", "advert") and pick.random() < 0.5 else 0
            within = self.classes(NAMES["comments"].split()) if kind == "comments" and pick.random() < 0.5 else ()
            out.append((Leaf((*path, *inner, *within, *tag), text, linked), 0))
        return out

    def odd(self, text: str) -> str:
        """The text, or now and then a phrase that is at home elsewhere: by itself it decides nothing."""
        return self.pick.choice(PHRASES[self.pick.choice(list(PHRASES))]) if self.pick.random() < 0.06 else text

    def page(self, main: list[str]) -> list[tuple[Leaf, int]]:
        """A page around the given main texts."""
        pick = self.pick
        out = [(Leaf(("html", "head", "title"), main[0][:60] if main else "Page", 0), 0)]
        body = ("html", "body", *(x for _ in range(pick.randrange(3)) for x in ("div", *pick.choice(((), (".wrapper",), (".container",), (".site",), (".root",), (".app",), (".row",))))))
        before = [k for k in ("notice", "header", "nav", "nav", "advert", "form", "sidebar") if pick.random() < 0.4]
        after = [k for k in ("share", "advert", "sidebar", "comments", "form", "nav", "footer", "notice") if pick.random() < 0.45]
        for kind in before:
            out += self.aside(kind, body)
        shell = pick.choice(("article", "main", "div", "div", "div", "section", "td"))
        bare = pick.random() < (0.4 if shell in ("article", "main") else 0.25)
        at = (*body, *(("main",) if pick.random() < 0.2 else ()), shell, *(() if bare else self.classes(MAIN)))
        if pick.random() < 0.3:
            at = (*at, "div", *(self.classes(MAIN) if pick.random() < 0.7 else ()))
        tag = ""
        for k, text in enumerate(main):
            tag = "li" if tag == "li" and pick.random() < 0.6 else pick.choice(("p", "p", "p", "p", "p", "p", "p", "div", "li", "li", "blockquote", "h2", "h3", "td", "pre", ""))
            if k == 0:
                tag = pick.choice(("h1", "h1", "h2", "p"))
            text = self.odd(text)
            if tag in ("h2", "h3") or pick.random() < (0.5 if tag == "li" else 0.1):
                text = text[: pick.choice((15, 40, 80))]
            above = (*at, "header") if k == 0 and pick.random() < 0.15 else (*at, "ul") if tag == "li" else at
            out.append((Leaf((*above, tag) if tag else above, text, pick.choice((0, 0, 0, len(text) // 4))), 1))
            if pick.random() < 0.07:
                out += self.aside(pick.choice(("advert", "share", "form", "sidebar", "notice")), at)
        for kind in after:
            out += self.aside(kind, at if kind in ("share", "comments") and pick.random() < 0.5 else body)
        return out


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Reader:
    """Turns blocks into hashed places and measures; remembers words of a worker."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.paths: dict[tuple[str, ...], list[int]] = {}

    def word(self, word: str) -> int:
        if (k := self.words.get(word)) is None:
            if len(self.words) > 300_000:
                self.words.clear()
            k = self.words[word] = bucket(word.strip(".,;:!?()\"'»«"))
        return k

    def path(self, path: tuple[str, ...]) -> list[int]:
        if (found := self.paths.get(path)) is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            found = self.paths[path] = [bucket(x) for x in path if x not in ("html", "body")] + [bucket(f"last {path[-1]}" if path else "")]
        return found

    def rows(self, page: list[Leaf], first: int, n: int) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Places of paths and words, and measures of form, of blocks of a page of ``n`` blocks, from the ``first`` on."""
        form = np.zeros((len(page), FORM), np.float32)
        words = []
        for k, (path, text, linked) in enumerate(page):
            parts = text.lower().split()
            words.append([self.word(w) for w in parts])
            m, w = len(text), len(parts)
            stops = text.count(".") + text.count("!") + text.count("?")
            form[k] = (
                min(m, 4000) ** 0.5 / 20, min(w, 600) ** 0.5 / 8, linked / m, min(stops, 20) / 10, text[-1] in ".!?…\"»", sum(c in text for c in "0123456789") / 5, text[0].isupper(), "©" in text,
                min(len(path), 30) / 10, (first + k) / n, (n - first - k) / n, w == 1, w < 5, min(n, 400) ** 0.5 / 10,
            )
        return [self.path(x.path) for x in page], words, form


def sums(vectors: np.ndarray, places: list[list[int]], mean: bool) -> np.ndarray:
    """Sum or mean of the vectors at each block's places."""
    sizes = np.array(list(map(len, places)), np.int64)
    out = np.zeros((len(places), vectors.shape[1]), vectors.dtype)
    held = np.flatnonzero(sizes)
    if len(held):
        flat = np.fromiter((x for p in places for x in p), np.int64, int(sizes.sum()))
        out[held] = np.add.reduceat(vectors[flat], np.cumsum(sizes[held]) - sizes[held], axis=0)
    return out / np.maximum(sizes, 1)[:, None].astype(vectors.dtype) if mean else out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Bidirectional LSTM over blocks; parameters are arrays, those of the two directions stacked."""

    def __init__(self, seed: int = 7, dtype=np.float32):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(dtype)
        self.p = {
            "paths": np.zeros((BUCKETS, PATHS), dtype), "words": np.zeros((BUCKETS, WORDS), dtype), "x": normal(2, WIDTH, 4 * HIDDEN, scale=WIDTH**-0.5), "h": normal(2, HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5),
            "bias": np.zeros((2, 1, 4 * HIDDEN), dtype), "out": normal(2 * HIDDEN + WIDTH, scale=0.1), "last": np.zeros(1, dtype),
        }
        # Vectors that weren't trained are zero; the first ones get a direction, or nothing would tell one from another.
        self.p["paths"] += normal(BUCKETS, PATHS, scale=0.02)
        self.p["bias"][:, :, HIDDEN : 2 * HIDDEN] = 1.0

    def inputs(self, rows) -> np.ndarray:
        paths, words, form = rows
        return np.concatenate([sums(self.p["paths"], paths, False), sums(self.p["words"], words, True), form.astype(self.p["x"].dtype)], 1)

    def run(self, x: np.ndarray, state, which=slice(None), keep: list | None = None):
        """States after each step of x (steps, directions, pages, width) from ``state``, and the last one."""
        h, c = state
        gates = np.matmul(x, self.p["x"][which]) + self.p["bias"][which]
        weight, out = self.p["h"][which], np.empty((*x.shape[:3], HIDDEN), x.dtype)
        for t in range(len(x)):
            z = gates[t] + np.matmul(h, weight)
            s = sigmoid(z[..., : 3 * HIDDEN])
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            g = np.tanh(z[..., 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tanh = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tanh))
            h = o * tanh
            out[t] = h
        return out, (h, c)

    def states(self, x: np.ndarray, turned: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both directions' states of pages (steps, pages, width); ``turned`` are each page's steps in reverse."""
        both = np.stack([x, np.take_along_axis(x, turned[:, :, None], 0)], 1)
        zero = np.zeros((2, x.shape[1], HIDDEN), x.dtype)
        out, _ = self.run(both, (zero, zero), keep=keep)
        return np.concatenate([out[:, 0], np.take_along_axis(out[:, 1], turned[:, :, None], 0)], 2)

    def probabilities(self, pages: list[list[Leaf]], reader: Reader) -> list[np.ndarray]:
        """For each page, how likely each block is main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            if len(pages[order[-1]]) > STEPS:
                k = order.pop()
                out[k] = self.long(pages[k], reader)
                continue
            n = len(pages[order[-1]])
            group, order = order[-max(1, 4 * STEPS // n) :], order[: -max(1, 4 * STEPS // n)]
            x, turned = batch_of([self.inputs(reader.rows(pages[k], 0, len(pages[k]))) for k in group])
            z = np.concatenate([self.states(x, turned), x], 2) @ self.p["out"] + self.p["last"]
            for j, k in enumerate(group):
                out[k] = sigmoid(z[: len(pages[k]), j])
        return out

    def long(self, page: list[Leaf], reader: Reader) -> np.ndarray:
        """A page of any length: backward states first, then forward, both in steps that carry over."""
        n, zero = len(page), np.zeros((1, 1, HIDDEN), self.p["x"].dtype)
        back, state = np.empty((n, HIDDEN), zero.dtype), (zero, zero)
        inputs = lambda a, b: self.inputs(reader.rows(page[a:b], a, n))
        for b in range(n, 0, -STEPS):
            a = max(0, b - STEPS)
            found, state = self.run(inputs(a, b)[::-1, None, None], state, slice(1, 2))
            back[a:b] = found[::-1, 0, 0]
        out, state = np.empty(n, zero.dtype), (zero, zero)
        for a in range(0, n, STEPS):
            x = inputs(a, min(n, a + STEPS))
            found, state = self.run(x[:, None, None], state, slice(0, 1))
            out[a : a + len(x)] = sigmoid(np.concatenate([found[:, 0, 0], back[a : a + len(x)], x], 1) @ self.p["out"] + self.p["last"][0])
        return out

    def gradients(self, rows: list, y: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over the blocks of pages given as rows, and its gradient."""
        keep: list = []
        x, turned = batch_of([self.inputs(r) for r in rows])
        hidden = self.states(x, turned, keep)
        all_in = np.concatenate([hidden, x], 2)
        z = all_in @ self.p["out"] + self.p["last"]
        mask, target = np.zeros(z.shape, z.dtype), np.zeros(z.shape, z.dtype)
        for j, labels in enumerate(y):
            mask[: len(labels), j], target[: len(labels), j] = 1, labels
        total = mask.sum()
        loss = float((mask * (np.logaddexp(0, z) - target * z)).sum() / total)
        dz = mask * (sigmoid(z) - target) / total
        g = {"out": np.einsum("tb,tbk->k", dz, all_in), "last": np.array([dz.sum()], z.dtype)}
        d_in = dz[:, :, None] * self.p["out"]
        back = np.zeros_like(d_in[:, :, HIDDEN : 2 * HIDDEN])
        np.put_along_axis(back, turned[:, :, None], d_in[:, :, HIDDEN : 2 * HIDDEN], 0)
        d_h = np.stack([d_in[:, :, :HIDDEN], back], 1)
        dx = d_in[:, :, 2 * HIDDEN :]
        both = np.stack([x, np.take_along_axis(x, turned[:, :, None], 0)], 1)
        d_gates = np.empty((*both.shape[:3], 4 * HIDDEN), x.dtype)
        dh, dc = np.zeros((2, x.shape[1], HIDDEN), x.dtype), np.zeros((2, x.shape[1], HIDDEN), x.dtype)
        g["h"] = np.zeros_like(self.p["h"])
        weight = self.p["h"].transpose(0, 2, 1)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, u, tanh = keep[t]
            dh = dh + d_h[t]
            dc = dc + dh * o * (1 - tanh * tanh)
            d = d_gates[t]
            d[..., :HIDDEN], d[..., HIDDEN : 2 * HIDDEN] = dc * u * i * (1 - i), dc * c * f * (1 - f)
            d[..., 2 * HIDDEN : 3 * HIDDEN], d[..., 3 * HIDDEN :] = dh * tanh * o * (1 - o), dc * i * (1 - u * u)
            g["h"] += np.matmul(h.transpose(0, 2, 1), d)
            dh, dc = np.matmul(d, weight), dc * f
        g["x"] = np.einsum("tdbi,tdbj->dij", both, d_gates)
        g["bias"] = d_gates.sum((0, 2))[:, None]
        d_both = np.matmul(d_gates, self.p["x"].transpose(0, 2, 1))
        put = np.zeros_like(dx)
        np.put_along_axis(put, np.broadcast_to(turned[:, :, None], dx.shape), d_both[:, 1], 0)
        dx = dx + d_both[:, 0] + put
        g["paths"], g["words"] = np.zeros_like(self.p["paths"]), np.zeros_like(self.p["words"])
        for j, (paths, words, _) in enumerate(rows):
            own = dx[: len(paths), j]
            for k, places, name, a, b in ((0, paths, "paths", 0, PATHS), (1, words, "words", PATHS, PATHS + WORDS)):
                sizes = np.array(list(map(len, places)), np.int64)
                flat = np.fromiter((v for p in places for v in p), np.int64, int(sizes.sum()))
                share = own[:, a:b] / np.maximum(sizes, 1)[:, None] if k else own[:, a:b]
                np.add.at(g[name], flat, np.repeat(share, sizes, axis=0))
        return loss, g


def batch_of(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (steps, pages, width), filled up with zeros, and the steps of each page in reverse; the rest stays in place."""
    n = max(map(len, pages))
    x, turned = np.zeros((n, len(pages), pages[0].shape[1]), pages[0].dtype), np.repeat(np.arange(n)[:, None], len(pages), 1)
    for j, page in enumerate(pages):
        x[: len(page), j], turned[: len(page), j] = page, np.arange(len(page))[::-1]
    return x, turned


def examples(pages: list[str], seed: int = 11, dressings: int = 5) -> list[tuple[list[Leaf], list[int]]]:
    """Labelled sequences of blocks: each page as it is, with some odd phrases in it, and ``dressings`` times dressed anew; windows of ``WINDOW`` blocks."""
    read = [(p, y) for p, y in ((p, from_elements(p)) for p in map(leaves, pages)) if p]
    if not any(y for _, y in read):
        read = [(p, [int(x.path[-1:] in (("p",), ("h1",), ("li",), ("td",), ("pre",)) and not SIDE.intersection(x.path)) for x in p]) for p, _ in read]
    read = [(p, y) for p, y in read if y]
    main = [[x.text for x, k in zip(p, y, strict=True) if k] for p, y in read]
    plain = [x.text for p, y in read for x, k in zip(p, y, strict=True) if not k and len(x.text) < 60]
    dresser = Dresser(seed, [t for m in main for t in m], plain)
    out = []
    for (page, y), texts in zip(read, main, strict=True):
        out += [(page, y), ([x._replace(text=dresser.odd(x.text), linked=0) if k else x for x, k in zip(page, y, strict=True)], y)]
        for _ in range(dressings if texts else 0):
            size = dresser.pick.choice((1, 2, 4, 8, 16, 30))
            first = dresser.pick.randrange(max(1, len(texts) - size + 1))
            out.append(tuple(map(list, zip(*dresser.page(texts[first : first + size]), strict=True))))
    return [(p[a : a + WINDOW], y[a : a + WINDOW]) for p, y in out for a in range(0, len(p), WINDOW)]


def train(pages: list[str], epochs: int = 10, size: int = 48, rate: float = 0.01) -> Labeller:
    """A labeller learned from pages by Adam; the same pages give the same labeller."""
    model, reader, pick = Labeller(), Reader(), np.random.default_rng(5)
    rows = [(reader.rows(p, 0, len(p)), np.array(y, np.float32)) for p, y in examples(pages)]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, steps = 0, epochs * -(-len(rows) // size)
    for _ in range(epochs):
        by_length = sorted(pick.permutation(len(rows)).tolist(), key=lambda k: len(rows[k][1]) // 8)
        starts = range(0, len(by_length), size)
        for a in pick.permutation(list(starts)):
            part = [rows[k] for k in by_length[a : a + size]]
            _, g = model.gradients([r for r, _ in part], [y for _, y in part])
            norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))))
            step += 1
            pace = rate * (1 - step / (steps + 1)) ** 0.5
            for k in model.p:
                d = g[k] / norm
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                model.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(model.p[k].dtype)
    return model


def sample(pages: DataFrame, most: int = SAMPLE, length: int = PAGE) -> list[str]:
    """At most ``most`` different pages of at most ``length`` code points: those with the smallest hashes of id and address.

    Hashes are ranked first, and pages are read again for those alone, so no task sends more than ``most`` hashes to the driver.
    """
    rows = pages.where(F.length("html").between(1, length)).select(F.xxhash64("page_id", "url").alias("k"), "html")
    picked = rows.select("k").distinct().orderBy("k").limit(most)
    found = rows.join(F.broadcast(picked), "k").groupBy("k").agg(F.min("html").alias("html")).orderBy("k").collect()
    return [r["html"] for r in found]


def fit(pages: DataFrame) -> Labeller:
    return train(sample(pages))


def main_text(page: list[Leaf], likely: np.ndarray) -> str:
    return "\n".join(x.text for x, p in zip(page, likely.tolist(), strict=True) if p >= 0.5)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url and main text of each page; one narrow pass."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reader = shared.value, Reader()
        for batch in source:
            texts, out, at = batch.column("html").to_pylist(), [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and held < 1_000_000 and end - at < 512:
                    held += len(texts[end] or "")
                    end += 1
                read = [leaves(t) if t else [] for t in texts[at:end]]
                out += [main_text(p, y) for p, y in zip(read, own.probabilities(read, reader), strict=True)]
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return found.mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
