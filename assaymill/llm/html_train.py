"""Trains the block labeller of ``html_extract`` on generated pages:
``python -m assaymill.llm.html_train`` writes its weights.

Pages are random layouts of an article among menus, headers, notices, adverts,
sidebars, forms, comments and footers, in semantic markup, in classed divisions
or in tables, partly unclosed, with words of invented languages.  Blocks carry
a private mark by which their label is found again after parsing."""

from __future__ import annotations

import random

import numpy as np

from .html_extract import COUNTS, PATHS, WEIGHTS, WORDS, Block, Labeller, bag, blocks, inputs, lstm, sigmoid

UNITS, PATH_DIM, WORD_DIM = 24, 16, 12
_KEEP, _DROP = "", ""

_SYLLABLES = [
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "en er ch de ei ie in te ge un nd ich sch die auf ung heit keit ver zu".split(),
    "es de le en re nt on er ou ai eau tion qu eux ment par vi ai".split(),
    "os as ue de en la ar cion ado ez mente rr ll ta co mi ga".split(),
    "ka no shi ta ri mo na wa to ke su".split(),
]
_COMMON = "the of and to in is for on with that this by as at from are it was be or".split()
_CUE = {
    "nav": "home about contact news sports login register menu search products services blog archive help faq shop cart account world business culture".split(),
    "footer": "copyright all rights reserved privacy policy terms contact imprint powered by sitemap".split(),
    "ad": "sponsored advertisement buy now sale offer discount deal promoted shop".split(),
    "notice": "we use cookies accept consent subscribe newsletter sign up update your browser javascript settings".split(),
    "form": "name email password submit send search subscribe comment your reset".split(),
    "side": "related popular recent most read trending tags categories share follow us archive more".split(),
    "comment": "reply says agree thanks great posted ago report like".split(),
}
_CLASSES = {
    "nav": "nav navbar menu navigation topnav main-menu breadcrumb breadcrumbs site-nav links toolbar pagination pager".split(),
    "header": "header site-header masthead top banner branding logo page-header topbar".split(),
    "footer": "footer site-footer bottom foot copyright colophon legal credits".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad ad-slot adbox adsbygoogle commercial".split(),
    "notice": "notice cookie cookie-banner alert gdpr consent message warning popup modal info-bar overlay paywall subscribe newsletter".split(),
    "side": "sidebar side related widget widgets aside rail recommended popular trending tags share social teaser more-stories author-box".split(),
    "form": "form search-form login signup contact-form subscribe newsletter-form".split(),
    "comment": "comments comment comment-list disqus respond discussion replies reader-comments user-comments feedback".split(),
    "main": "content article post entry story main body text article-body post-content entry-content page-content main-content".split(),
}


class Writer:
    def __init__(self, r: random.Random):
        self.r = r
        self.syllables = r.choice(_SYLLABLES)
        self.bag = ["".join(r.choices(self.syllables, k=r.randint(1, 4))) for _ in range(r.randint(40, 400))]
        if r.random() < 0.5:
            self.bag += _COMMON * (1 + len(self.bag) // 40)
        self.semantic = r.random() < 0.55
        self.opaque = not self.semantic and r.random() < 0.3
        self.noise = r.choice(["", "", "", "!!", "***", "$$$"])
        self.upper = r.random() < 0.06

    def words(self, n: int) -> str:
        out = [self.r.choice(self.bag) + (self.noise if self.r.random() < 0.8 else "") for _ in range(n)]
        text = " ".join(out).capitalize()
        return text.upper() if self.upper else text

    def prose(self, low: int, high: int) -> str:
        n, out = self.r.randint(low, high), []
        while n > 0:
            k = min(n, self.r.randint(1, 18))
            s = self.words(k)
            if k > 6 and self.r.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice(["."] * 8 + ["?", "!"]))
            n -= k
        text = " ".join(out)
        if self.r.random() < 0.2:
            text = text.replace("e", "&eacute;", 2).replace(" ", " &amp; ", 1)
        if self.r.random() < 0.25:
            w = text.split(" ")
            k = self.r.randrange(len(w))
            w[k] = f'<a href="/x{k}">{w[k]}</a>'
            text = " ".join(w)
        return text

    def junk(self) -> str:
        """A paragraph as scraped pages have them: a repeated word or line, bars
        between words, a licence line, contact data, code."""
        r, w = self.r, self.words
        kind = r.randrange(7)
        if kind == 0:
            return (w(1) + " ") * r.randint(2, 60)
        if kind == 1:
            return " | ".join(w(1) for _ in range(r.randint(1, 40))) + r.choice(["", " |"])
        if kind == 2:
            return r.choice(["Licensed under CC BY 4.0.", "This work is licensed under the MIT License.", "All rights reserved by the author.", "Copyright of the text: " + w(2) + "."])
        if kind == 3:
            return f"{w(2)} {r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.7 {w(1)}@{w(1)}.example {r.randint(10**6, 10**9)}"
        if kind == 4:
            return f"https://{w(1)}.example.com/{w(1)}?page={r.randint(1, 99)}"
        if kind == 5:
            return f'{w(1)} = "{r.getrandbits(128):x}"'
        return w(r.randint(1, 3)) + r.choice(["", ".", ":"])

    def cue(self, kind: str, low: int, high: int) -> str:
        r = self.r
        return " ".join(r.choice(_CUE[kind]) if r.random() < 0.5 else r.choice(self.bag) for _ in range(r.randint(low, high))).capitalize()

    def open(self, kind: str, tag: str) -> tuple[str, str]:
        """An element of that kind: its own tag where markup is semantic, else a
        classed division, or a meaningless one."""
        r = self.r
        if self.opaque:
            name = "".join(r.choices("bcdfghjkl", k=5))
            return f'<div class="{name}">', "</div>"
        name = r.choice(_CLASSES[kind])
        if self.semantic and r.random() < 0.8:
            return (f"<{tag}>" if r.random() < 0.5 else f'<{tag} class="{name}">'), f"</{tag}>"
        return f'<{r.choice(["div", "div", "section"])} {r.choice(["class", "class", "id"])}="{name}">', "</div>"

    def links(self, mark: str, low: int, high: int, kind: str) -> str:
        r = self.r
        items = [f'<a href="/p{k}">{mark}{self.cue(kind, 1, 4) if r.random() < 0.5 else self.words(r.randint(1, 8))}</a>' for k in range(r.randint(low, high))]
        shape = r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if shape < 0.8:
            return " | ".join(items)
        return "".join(f"<div>{i}</div>" for i in items)

    def boilerplate(self, kind: str) -> str:
        r, d = self.r, _DROP
        say = lambda low, high: d + (self.prose(low, high) if r.random() < 0.6 else self.cue(kind, low, high))
        if kind == "nav":
            a, b = self.open("nav", "nav")
            return a + self.links(d, 2, 12, "nav") + b
        if kind == "header":
            a, b = self.open("header", "header")
            return a + f"<{r.choice(['h1', 'div', 'p', 'h2'])}>{d}{self.words(r.randint(1, 4))}" + (self.links(d, 2, 8, "nav") if r.random() < 0.5 else "") + b
        if kind == "ad":
            a, b = self.open("ad", r.choice(["aside", "ins", "div"]))
            if r.random() < 0.4:
                a, b = f'<div class="{r.choice(_CLASSES["ad"])}">', "</div>"
            return r.choice(["", "<!-- ad -->"]) + a + r.choice(["", "<p>"]) + say(3, 30) + b
        if kind == "notice":
            a, b = self.open("notice", r.choice(["aside", "dialog", "div"]))
            if r.random() < 0.4:
                a, b = f'<div class="{r.choice(_CLASSES["notice"])}">', "</div>"
            return a + "<p>" + say(4, 40) + "</p>" + (f"<button>{d}{self.cue('notice', 1, 2)}</button>" if r.random() < 0.6 else "") + b
        if kind == "side":
            a, b = self.open("side", "aside")
            more = f"<p>{say(5, 40)}</p>" if r.random() < 0.4 else ""
            return a + f"<h{r.choice('234')}>{d}{self.cue('side', 1, 3)}</h3>" + self.links(d, 2, 10, "side") + more + b
        if kind == "form":
            fields = "".join(f"<label>{d}{self.cue('form', 1, 3)}</label><input name=x{k}>" for k in range(r.randint(1, 4)))
            extra = f"<p>{say(4, 25)}</p>" if r.random() < 0.4 else ""
            choice = f"<select><option>{d}{self.words(1)}<option>{d}{self.words(2)}</select>" if r.random() < 0.3 else ""
            return f'<form action="/s" class="{r.choice(_CLASSES["form"])}">' + extra + fields + choice + f"<button>{d}{self.cue('form', 1, 2)}</button></form>"
        if kind == "comment":
            a, b = self.open("comment", "section")
            if r.random() < 0.5:
                a, b = f'<{r.choice(["div", "section", "ol"])} {r.choice(["class", "id"])}="{r.choice(_CLASSES["comment"])}">', "</div>"
            one = lambda: f'<div class="comment"><b>{d}{self.words(1)}</b><p>{d}{self.prose(4, 70)}</p></div>' if r.random() < 0.6 else f"<li>{d}{self.prose(4, 50)}</li>"
            return a + f"<h3>{d}{self.cue('comment', 1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 7))) + b
        a, b = self.open("footer", "footer")
        return a + r.choice(["", "<p>"]) + f"{d}{r.choice(['&copy; ', ''])}{self.cue('footer', 2, 12) if r.random() < 0.6 else self.words(r.randint(2, 14))}" + (self.links(d, 2, 8, "footer") if r.random() < 0.4 else "") + b

    def article(self) -> str:
        r, k = self.r, _KEEP
        a, b = self.open("main", r.choice(["article", "article", "main"]))
        if self.semantic and r.random() < 0.5:
            a, b = "<article>", "</article>"
        loose = r.random() < 0.3
        out = [a]
        if r.random() < 0.85:
            head = f"<h1>{k}{self.words(r.randint(2, 12))}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.66:
                text = self.junk() if r.random() < 0.18 else self.prose(1, 12) if r.random() < 0.2 else self.prose(8, 120)
                bold = r.random() < 0.15
                out.append(("<p><b>" if bold else "<p>") + k + text + (r.choice(["<br>", ""]) if loose and r.random() < 0.5 else ("</b></p>" if bold else "</p>")))
            elif kind < 0.74:
                out.append(f"<h{r.choice('234')}>{k}{self.words(r.randint(1, 8))}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{k}{self.prose(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{k}{self.prose(5, 50)}</blockquote>")
            elif kind < 0.89:
                out.append(f"<pre>{k}{self.words(r.randint(3, 30))}</pre>")
            elif kind < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{k}{self.words(r.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{k}{self.prose(3, 15)}</figcaption></figure>")
            else:
                out.append(f"<div>{k}{self.prose(8, 80)}</div>")
            if r.random() < 0.06:
                out.append(self.boilerplate(r.choice(["ad", "ad", "side", "notice", "form"])))
        if r.random() < 0.12:
            out.append(self.boilerplate(r.choice(["comment", "side", "nav"])))
        return "".join(out) + b

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("ad", 0.45), ("form", 0.15), ("side", 0.2)) if r.random() < p]
        after = [k for k, p in (("side", 0.35), ("comment", 0.4), ("ad", 0.25), ("form", 0.2), ("nav", 0.2), ("notice", 0.1), ("footer", 0.85)) if r.random() < p]
        main = [self.article()] if r.random() < 0.96 else []
        if r.random() < 0.2:
            main = [f'<div class="{r.choice(["wrapper", "container", "page", "row", "site"])}">', *main, "</div>"]
        body = [*map(self.boilerplate, before), *main, *map(self.boilerplate, after)]
        head = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        return head + r.choice(["", "\n"]).join(body) + ("</body></html>" if r.random() < 0.9 else "")


def sample(r: random.Random) -> tuple[list[Block], np.ndarray]:
    """A generated page's blocks without their marks, and their labels."""
    out, labels = [], []
    for b in blocks(Writer(r).page()):
        if _KEEP in b.text or _DROP in b.text:
            text = " ".join(b.text.replace(_KEEP, "").replace(_DROP, "").split())
            if text:
                out.append(Block(text, b.path, b.linked))
                labels.append(_KEEP in b.text)
    return out, np.array(labels, np.float32)


def _backward(x, mask, keep, dh_all, w, u):
    """Gradients of one direction's weights and inputs."""
    steps, pages, units = dh_all.shape
    dz_all = np.zeros((steps, pages, 4 * units), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, units), np.float32), np.zeros((pages, units), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, shape, m = keep[t]
        dh = dh + dh_all[t]
        da, pass_h, pass_c = m * dh, (1 - m) * dh, (1 - m) * dc
        dn = m * dc + da * o * (1 - shape * shape)
        dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), da * shape * o * (1 - o), dn * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh = dz @ u.T + pass_h
        dc = dn * f + pass_c
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0), dz_all @ w.T


def train(pages: int = 14_000, epochs: int = 9, seed: int = 11, batch: int = 32, rate: float = 4e-3, tell=print) -> Labeller:
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = [s for s in (sample(r) for _ in range(pages)) if len(s[0])]
    data = [(inputs(b), y) for b, y in data]
    d = PATH_DIM + WORD_DIM + COUNTS
    w = {"paths": rng.normal(0, 0.1, (PATHS, PATH_DIM)), "words": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "o": np.zeros(1)}
    for s in "fb":
        w |= {"w" + s: rng.normal(0, d**-0.5, (d, 4 * UNITS)), "u" + s: rng.normal(0, UNITS**-0.5, (UNITS, 4 * UNITS)), "b" + s: np.r_[np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)], "o" + s: rng.normal(0, UNITS**-0.5, UNITS)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda k: len(data[k][1]) + rng.random() * 12)
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        rng.shuffle(groups)
        loss = right = total = 0.0
        for some in groups:
            steps, n = max(len(data[k][1]) for k in some), len(some)
            x, mask, y = np.zeros((steps, n, d), np.float32), np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
            used = []
            for col, k in enumerate(some):
                (paths, words, counts), label = data[k]
                # drop features at random, so that none is relied on alone
                paths = [p[rng.random(len(p)) > 0.15] for p in paths]
                words = [v[rng.random(len(v)) > 0.3] for v in words]
                used.append((paths, words))
                x[: len(label), col] = np.concatenate([bag(w["paths"], paths, False), bag(w["words"], words, True), counts], axis=1)
                mask[: len(label), col], y[: len(label), col] = 1, label
            kf: list = []
            kb: list = []
            hf = lstm(x, mask, w["wf"], w["uf"], w["bf"], kf)
            hb = lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"], kb)
            z = hf @ w["of"] + hb[::-1] @ w["ob"] + w["o"]
            p = sigmoid(z)
            size = mask.sum()
            loss += float((mask * -(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
            right += float((mask * ((z > 0) == (y > 0.5))).sum())
            total += float(size)
            dz = (mask * (p - y) / size).astype(np.float32)
            g = {"of": np.einsum("tn,tnu->u", dz, hf), "ob": np.einsum("tn,tnu->u", dz, hb[::-1]), "o": dz.sum(keepdims=True).reshape(1)}
            g["wf"], g["uf"], g["bf"], dxf = _backward(x, mask, kf, dz[:, :, None] * w["of"], w["wf"], w["uf"])
            g["wb"], g["ub"], g["bb"], dxb = _backward(x[::-1], mask[::-1], kb, dz[::-1, :, None] * w["ob"], w["wb"], w["ub"])
            dx = dxf + dxb[::-1]
            g["paths"], g["words"] = np.zeros_like(w["paths"]), np.zeros_like(w["words"])
            for col, (paths, words) in enumerate(used):
                for t, (a, b) in enumerate(zip(paths, words)):
                    np.add.at(g["paths"], a, dx[t, col, :PATH_DIM])
                    if len(b):
                        np.add.at(g["words"], b, dx[t, col, PATH_DIM : PATH_DIM + WORD_DIM] / len(b))
            step += 1
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            speed = rate * (0.5 ** max(0, epoch - epochs // 2))
            for name, grad in g.items():
                grad = grad * min(1.0, 1.0 / (norm + 1e-9)) + 1e-5 * w[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad * grad
                w[name] -= (speed * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        tell(f"epoch {epoch}: loss {loss / total:.4f}, right {right / total:.4f}")
    return Labeller(w)


def accuracy(labeller: Labeller, pages: int = 400, seed: int = 99) -> tuple[float, float]:
    """Share of blocks, and of whole pages, labelled right on new pages."""
    r = random.Random(seed)
    data = [s for s in (sample(r) for _ in range(pages)) if len(s[0])]
    kept = labeller.keep([b for b, _ in data])
    same = [k == (y > 0.5) for k, (_, y) in zip(kept, data)]
    return float(np.concatenate(same).mean()), float(np.mean([s.all() for s in same]))


if __name__ == "__main__":
    made = train()
    print("blocks, pages right:", accuracy(made))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in made.w.items()})
