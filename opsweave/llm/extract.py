"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (``blocks``). A bidirectional LSTM in numpy reads each page's block vectors
(tag path, hashed words, a few numbers) from both ends and labels every block as article or not, with
the whole page as context. It is fitted for each run on made-up pages of many layouts, whose labels are
known, and on at most ``FIT_PAGES`` pages of the table (those of up to ``FIT_CHARS`` characters, in the
order of the MD5 of their ids), labelled by what their tag paths say. Every page is read whole.

One output row per page row. A null or empty page, or one without article blocks, gives an empty text.
Repeated rows give repeated results, an empty table none. Pages are read together by the number of their
blocks, a very long one alone, so memory goes with the longest page. Other columns of the table may have any name but
those of the result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.blocks import BOILERPLATE_WORDS, PATH_WORDS, SIZE, blocks, vectors
from opsweave.llm.common import ROWS_PER_BATCH

FIT_PAGES = 100
FIT_CHARS = 20_000
MADE_PAGES = 260
HIDDEN = 10
EPOCHS = 16
CELLS = 1 << 15  # steps times pages that are read at once
_BAD = {PATH_WORDS[w] for w in BOILERPLATE_WORDS}


class Labeller:
    """Two LSTMs and a linear layer on both states and the block vector itself."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden

        def lstm() -> list[np.ndarray]:
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            return [rng.normal(0, 0.1, (SIZE, 4 * hidden)), rng.normal(0, 0.2, (hidden, 4 * hidden)), bias]

        self.w = [*lstm(), *lstm(), rng.normal(0, 0.1, 2 * hidden), np.zeros(SIZE), np.zeros(1)]

    def _run(self, x: np.ndarray, alive: np.ndarray, wx, wh, b):
        """x: steps x pages x size; pages in order of falling length, so ``alive[t]`` lead the rest."""
        steps, pages, _ = x.shape
        pre = x @ wx + b
        h, c = np.zeros((pages, self.h)), np.zeros((pages, self.h))
        hs, cs, gates = np.zeros((steps + 1, pages, self.h)), np.zeros((steps + 1, pages, self.h)), np.zeros((steps, pages, 4 * self.h))
        for t in range(steps):
            k = alive[t]
            z = pre[t, :k] + hs[t, :k] @ wh
            g = np.empty_like(z)
            g[:, : 3 * self.h] = 1 / (1 + np.exp(-z[:, : 3 * self.h]))
            g[:, 3 * self.h :] = np.tanh(z[:, 3 * self.h :])
            i, f, o, u = np.split(g, 4, axis=1)
            c = f * cs[t, :k] + i * u
            h = o * np.tanh(c)
            gates[t, :k], cs[t + 1, :k], hs[t + 1, :k] = g, c, h
        return hs, cs, gates

    def _back(self, x, alive, wh, hs, cs, gates, dh_out):
        steps, pages, _ = x.shape
        dz_all = np.zeros_like(gates)
        dh, dc, dwh = np.zeros((pages, self.h)), np.zeros((pages, self.h)), np.zeros_like(wh)
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            i, f, o, u = np.split(gates[t, :k], 4, axis=1)
            tc = np.tanh(cs[t + 1, :k])
            d = dh[:k] + dh_out[t, :k]
            dcc = dc[:k] + d * o * (1 - tc * tc)
            dz = np.concatenate([dcc * u * i * (1 - i), dcc * cs[t, :k] * f * (1 - f), d * tc * o * (1 - o), dcc * i * (1 - u * u)], axis=1)
            dz_all[t, :k] = dz
            dwh += hs[t, :k].T @ dz
            dh[:k], dc[:k] = dz @ wh.T, dcc * f
        flat = dz_all.reshape(-1, dz_all.shape[2])
        return [x.reshape(-1, SIZE).T @ flat, dwh, flat.sum(axis=0)]

    def _pack(self, pages: list[np.ndarray]):
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        lens = np.array([len(pages[i]) for i in order])
        x = np.zeros((int(lens[0]), len(pages), SIZE))
        r = np.zeros_like(x)
        for k, i in enumerate(order):
            x[: lens[k], k], r[: lens[k], k] = pages[i], pages[i][::-1]
        alive = (lens[None, :] > np.arange(lens[0])[:, None]).sum(axis=1)
        return order, lens, x, r, alive

    def _turn(self, a: np.ndarray, lens: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for k, n in enumerate(lens):
            out[:n, k] = a[:n, k][::-1]
        return out

    def logits(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        full = [p for p in pages if len(p)]
        if not full:
            return [np.zeros(0) for _ in pages]
        order, lens, x, r, alive = self._pack(full)
        f = self._run(x, alive, *self.w[:3])[0][1:]
        b = self._turn(self._run(r, alive, *self.w[3:6])[0][1:], lens)
        z = np.concatenate([f, b], axis=2) @ self.w[6] + x @ self.w[7] + self.w[8]
        got: list = [None] * len(full)
        for k, i in enumerate(order):
            got[i] = z[: lens[k], k]
        rest = iter(got)
        return [next(rest) if len(p) else np.zeros(0) for p in pages]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        order, lens, x, r, alive = self._pack(pages)
        y, mask = np.zeros(x.shape[:2]), np.zeros(x.shape[:2])
        for k, i in enumerate(order):
            y[: lens[k], k], mask[: lens[k], k] = labels[i], 1
        run_f, run_b = self._run(x, alive, *self.w[:3]), self._run(r, alive, *self.w[3:6])
        both = np.concatenate([run_f[0][1:], self._turn(run_b[0][1:], lens)], axis=2)
        z = both @ self.w[6] + x @ self.w[7] + self.w[8]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
        dz = (p - y) * mask / mask.sum()
        d_both = dz[:, :, None] * self.w[6]
        gf = self._back(x, alive, self.w[1], *run_f, d_both[:, :, : self.h])
        gb = self._back(r, alive, self.w[4], *run_b, self._turn(d_both[:, :, self.h :], lens))
        return loss, [*gf, *gb, np.tensordot(dz, both, 2), np.tensordot(dz, x, 2), np.array([dz.sum()])]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24) -> Labeller:
        pairs = [(p, y) for p, y in zip(pages, labels) if len(p)]
        rng = random.Random(11)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            rng.shuffle(pairs)
            for at in range(0, len(pairs), batch):
                own = pairs[at : at + batch]
                _, grads = self.step([p for p, _ in own], [y for _, y in own])
                t, rate = t + 1, 0.02 * (1 - epoch / epochs) + 0.001
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def _votes(self, pages: list[np.ndarray], direction: int) -> list[np.ndarray]:
        """Of one direction (0 or 1), what its states add to each block's score. Pages in order of falling
        length; only the gates' inputs of all steps are held, no states."""
        wx, wh, b = self.w[3 * direction : 3 * direction + 3]
        out = self.w[6][self.h * direction : self.h * (direction + 1)]
        lens = np.array([len(p) for p in pages])
        pre = np.zeros((int(lens[0]), len(pages), 4 * self.h))
        for k, page in enumerate(pages):
            rows = page[::-1] if direction else page
            for at in range(0, len(rows), 4096):
                pre[at : at + 4096, k][: len(rows) - at] = rows[at : at + 4096] @ wx + b
        votes = np.zeros(pre.shape[:2])
        h, c = np.zeros((len(pages), self.h)), np.zeros((len(pages), self.h))
        for t, k in enumerate((lens[None, :] > np.arange(lens[0])[:, None]).sum(axis=1).tolist()):
            z = pre[t, :k] + h[:k] @ wh
            g = 1 / (1 + np.exp(-z[:, : 3 * self.h]))
            c[:k] = g[:, self.h : 2 * self.h] * c[:k] + g[:, : self.h] * np.tanh(z[:, 3 * self.h :])
            h[:k] = g[:, 2 * self.h :] * np.tanh(c[:k])
            votes[t, :k] = h[:k] @ out
        return [votes[:n, k][::-1] if direction else votes[:n, k] for k, n in enumerate(lens.tolist())]

    def labels(self, pages: list[np.ndarray], cells: int = CELLS) -> list[np.ndarray]:
        """Pages of like length are read together, as many as fit into ``cells`` steps times pages; a longer page alone."""
        out: list = [np.zeros(0, dtype=bool) for _ in pages]
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        while order:
            n = max(1, cells // len(pages[order[0]]))
            own, order = order[:n], order[n:]
            some = [pages[i] for i in own]
            for i, page, f, b in zip(own, some, self._votes(some, 0), self._votes(some, 1)):
                out[i] = f + b + page @ self.w[7] + self.w[8] > 0
        return out


def path_labels(found: list) -> np.ndarray:
    """What the tag paths say: article unless a boilerplate word stands on the path."""
    return np.array([not _BAD.intersection(b.path) for b in found], dtype=float)


_SYLLABLES = "ba den lo mir ta shel von qui ra ent is the ou ver nd ch ti on eau ment ción str ä é".split()


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A made-up page and the label of each of its blocks, in many layouts."""
    parts: list[str] = []
    labels: list[bool] = []

    def words(n: int) -> str:
        if rng.random() < 0.05:
            return " ".join([rng.choice(_SYLLABLES) * 2] * n)
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def add(tag: str, text: str, good: bool, attributes: str = "") -> None:
        end = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        parts.append(f"<{tag}{attributes}>{text}{end}")
        labels.append(good)

    def named(bad: str) -> str:
        kind = rng.choice(("class", "id", "class"))
        noise = rng.choice(("", f" c{rng.randint(1, 99)}", " left", " box"))
        return f' {kind}="{rng.choice(("", "site-", "the_", "js-"))}{bad}{noise}"'

    def bad_part(word: str, tag: str, items: int, inner: str, linked: bool, long: bool = False) -> None:
        parts.append(f"<{tag}{named(word) if tag in ('div', 'section', 'ul', 'span') or rng.random() < 0.5 else ''}>")
        if inner == "li":
            parts.append("<ul>")
        for _ in range(items):
            text = words(rng.randint(6, 60) if long else rng.randint(1, 6)) + (rng.choice(("", ".")) if long else "")
            add(inner, f'<a href="/x">{text}</a>' if linked else text, False)
        if inner == "li":
            parts.append("</ul>")
        parts.append(f"</{tag}>")

    menus = ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "topbar")
    boxes = [w for w in BOILERPLATE_WORDS if w not in menus and w not in ("head", "skip", "tags")]

    def box() -> None:
        word = rng.choice(boxes)
        if rng.random() < 0.3:
            tag, word = rng.choice((("aside", "sidebar"), ("form", "search"), ("footer", "legal"), ("header", "masthead")))
        else:
            tag = rng.choice(("div", "div", "section"))
        bad_part(word, tag, rng.randint(1, 4), rng.choice(("p", "p", "div", "li")), rng.random() < 0.3, rng.random() < 0.7)

    def menu() -> None:
        if rng.random() < 0.6:
            bad_part(rng.choice(menus), "nav", rng.randint(1, 8), "li", True)
        else:
            bad_part(rng.choice(menus), rng.choice(("div", "ul")), rng.randint(1, 8), rng.choice(("li", "p")), True)

    parts.append('<!DOCTYPE html><html lang="en"><head><title>x</title></head><body>')
    for f in rng.choice(((menu,), (menu, box), (box, menu), (box,), (menu, box, box), ())):
        f()
    wrap = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
    kind = "" if wrap in ("article", "main") else f' class="{rng.choice(("content", "post", "entry", "story", "text", "page c7", "x12"))}"'
    parts.append(f"<{wrap}{kind}>")
    if rng.random() < 0.8:
        add("h1", words(rng.randint(2, 9)), True)
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.7:
            add("p", words(rng.choice((1, 3, 8, 20, 40, 80))) + rng.choice((".", ".", ".", "", "!")), True)
        elif kind < 0.78:
            add("p", f'<b>{words(rng.randint(1, 8))}.<br>', True)
        elif kind < 0.84:
            add(rng.choice(("h2", "h3", "blockquote", "pre")), words(rng.randint(2, 12)), True)
        elif kind < 0.9:
            parts.append("<ul>")
            for _ in range(rng.randint(1, 5)):
                add("li", words(rng.randint(1, 14)), True)
            parts.append("</ul>")
        else:
            box()
    parts.append(f"</{wrap}>")
    for f in rng.choice(((box,), (box, box), (menu,), (), (box, menu))):
        f()
    if rng.random() < 0.8:
        bad_part("footer", "footer", rng.randint(1, 3), rng.choice(("p", "span", "div")), False)
        if parts[-2].startswith("<span"):  # inline: one block
            n = sum(p.startswith("<span>") for p in parts[-4:])
            del labels[len(labels) - max(0, n - 1) :]
    parts.append("</body></html>")
    return "".join(parts), labels


def made_pages(n: int, seed: int = 3) -> Iterator[tuple[list, np.ndarray]]:
    rng = random.Random(seed)
    while n:
        page, labels = made_page(rng)
        found = blocks(page)
        if found and len(found) == len(labels):
            n -= 1
            yield found, np.array(labels, dtype=float)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    own = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    own = own.where(F.length("html").between(1, FIT_CHARS))
    ids = own.select("id").distinct().orderBy(F.md5("id"), "id").limit(FIT_PAGES)  # ids first: only theirs travel
    sample = own.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()
    x, y = [], []
    for found, labels in made_pages(MADE_PAGES):
        x.append(vectors(found))
        y.append(labels)
    for r in sample:
        if found := blocks(r["html"]):
            x.append(vectors(found))
            y.append(path_labels(found))
    return Labeller().fit(x, y)


def _by_length(pages: list, most: int = 4 << 20) -> Iterator[list]:
    """The pages in order, as many at once as have ``most`` characters; a longer one alone."""
    own, total = [], 0
    for page in pages:
        if own and total + len(page or "") > most:
            yield own
            own, total = [], 0
        own.append(page)
        total += len(page or "")
    yield own


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model: Labeller | None = None) -> DataFrame:
    """One row ``(id_col, *keep, text, n_chars)`` per page; pages are not shuffled."""
    model = model or fit(pages, id_col, html_col)
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    own = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("_html"))
    columns = own.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for some in _by_length(batch.column(len(columns)).to_pylist()):
                found = [blocks(h) for h in some]
                good = model.labels([vectors(f) for f in found])
                texts += ["\n\n".join(b.text for b, g in zip(f, own) if g) for f, own in zip(found, good)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*columns, "text", "n_chars"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
