"""Pages to text and chunks, held against a plain recursive version."""

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from spindrift.operators import chunks
from spindrift.plans import catalogue

SMALL = "/root/testdata/sf0.001"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS, HEADINGS = set("p div ul ol dl blockquote".split()), {f"h{n}" for n in range(1, 7)}


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path = [("", {}, [])]
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.path[-1][2].append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))

    def handle_endtag(self, tag):
        names = [n[0] for n in self.path]
        if tag in names[1:]:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.path[-1][2].append(data)


def strings(node, skip=()):
    if isinstance(node, str):
        return [node.strip()] if node.strip() else []
    return [] if node[0] in skip else [s for c in node[2] for s in strings(c, skip)]


def boilerplate(node):
    tag, attrs, _ = node
    classes = attrs.get("class", "")
    return (
        tag in ("nav", "aside", "footer", "header")
        or attrs.get("role") in ("navigation", "banner", "contentinfo")
        or any(w in attrs.get("aria-label", "") for w in ("breadcrumb", "navigation"))
        or set(classes.split()) & set("edit-on-github copy-button toc table-of-contents nav navbar sidebar footer header".split())
        or (tag == "button" and "copy" in classes)
        or (tag == "a" and "edit" in classes)
    )


def pruned(node):
    return node if isinstance(node, str) else (node[0], node[1], [pruned(c) for c in node[2] if isinstance(c, str) or not boilerplate(c)])


def found(node, tag):
    if isinstance(node, str):
        return None
    return node if node[0] == tag else next((f for c in node[2] if (f := found(c, tag))), None)


def raw(node):
    return node if isinstance(node, str) else "".join(map(raw, node[2]))


def sections(page):
    root = pruned(Tree(page).path[0])
    out = [([], [])]

    def holds(node):
        return not isinstance(node, str) and any(not isinstance(c, str) and (c[0] in BLOCKS | HEADINGS | {"pre", "table"} or holds(c)) for c in node[2])

    def visit(node):
        for child in node[2]:
            if isinstance(child, str):
                out[-1][1].extend([("text", child.strip())] if child.strip() else [])
            elif child[0] in HEADINGS:
                title = " ".join(strings(child))
                out.append(([*(h for h in out[-1][0] if h[0] < int(child[0][1])), (int(child[0][1]), title, child[1].get("id") or re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", title.lower().strip())))], []))
            elif child[0] == "pre":
                names = ((found(child, "code") or child)[1].get("class") or child[1].get("class", "")).split()
                out[-1][1].append(("code", f"```{names[0].removeprefix('language-') if names else ''}\n{raw(child).strip()}\n```"))
            elif child[0] == "table":
                out[-1][1].append(("table", " ".join(strings(child))))
            elif child[0] in BLOCKS and not holds(child):
                out[-1][1].extend([("text", t)] if (t := " ".join(strings(child))) else [])
            else:
                visit(child)

    visit(found(root, "body") or root)
    return out


def count(text):
    return len(regex.findall(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+", text))


def filled(parts, most, joint):
    out = []
    for part in parts:
        if out and sum(map(count, out[-1])) + count(part) <= most:
            out[-1].append(part)
        else:
            out.append([part])
    return [joint.join(o) for o in out]


def brute(url, page, child_least, child_most, parent_most, part_most):
    rows = []
    for path, blocks in sections(page):
        blocks = [(k, v) for k, v in blocks if len(v.strip()) >= 20]
        if not any(len(v.strip()) > 20 for _, v in blocks):
            continue
        if count("\n\n".join(v for _, v in blocks)) <= parent_most:
            groups = [blocks]
        else:
            groups = []
            for kind, value in blocks:
                for piece in [value] if count(value) <= part_most else filled(re.split(r"(?<=[.!?])\s+", value), parent_most, " "):
                    if not groups or sum(count(v) for _, v in groups[-1]) + count(piece) > parent_most:
                        groups.append([])
                    groups[-1].append((kind, piece))
        titles = [h[1] for h in path]
        for n, group in enumerate(groups):
            parent = hashlib.sha256(f"{url}||{' > '.join(titles) or 'root'}::{n}".encode()).hexdigest()[:16]
            rows.append(("parent", parent, None, "\n\n".join(v for _, v in group), " > ".join(titles)))
            children, waiting = [], []

            def flush(children=children, waiting=waiting):
                if waiting and sum(map(count, waiting)) >= child_least // 2:
                    children.append("\n\n".join(waiting))
                waiting.clear()

            for kind, value in group:
                if kind in ("code", "table") or count(value) >= child_least:
                    flush()
                    children += [value] if kind in ("code", "table") or count(value) <= child_most else filled(re.split(r"(?<=[.!?])\s+", value), child_most, " ")
                else:
                    if sum(map(count, waiting)) + count(value) > child_most:
                        flush()
                    waiting.append(value)
            flush()
            rows += [("child", f"{parent}_child_{k}", parent, c, " > ".join(titles)) for k, c in enumerate(children)]
    return rows


ODD = [
    "<body><h2 id='own'>Two</h2><p>" + "A sentence of some words. " * 60 + "</p><pre><code class='language-py x'>run(1)\nfor ever and ever</code></pre><h3>Three &amp; four_5</h3><table><tr><td>cells of a table</td><td>with more text</td></tr></table></body>",
    "<div><nav>menu</nav><p>first unclosed paragraph of a page<p>second <b>bold</b> paragraph of a page<div>inner block of some length</div>tail text of some length</div>",
    "<h1></h1><p>short</p>",
    "",
    None,
    "no markup at all but long enough to count as a block",
]


def test_chunks_equal_a_plain_version(spark):
    pages = [(r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()] + [(f"https://odd.org/{k}", p) for k, p in enumerate(ODD)]
    frame = spark.createDataFrame(pages, "url string, html string")
    plain = lambda url: re.sub(r"/+$", "", re.sub(r"[?#].*$", "", url))
    for limits in ((20, 60, 120, 200), (150, 350, 900, 1200), (5, 10, 15, 20)):
        got = sorted((r.url, r.kind, r.chunk_id, r.parent_id or "", r.content, r.heading_path) for r in chunks.chunk_pages(frame, chunks.Limits(*limits)).collect())
        expected = sorted((plain(url), kind, own, parent or "", text, path) for url, page in pages for kind, own, parent, text, path in brute(plain(url), page, *limits))
        assert got == expected and len(got) > len(pages)


def test_page_texts_equal_a_plain_version(spark):
    pages = [(r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()] + [(f"https://odd.org/{k}", p) for k, p in enumerate(ODD)]
    rows = {r.url: r for r in chunks.page_texts(spark.createDataFrame(pages, "url string, html string")).collect()}
    for url, page in pages:
        root = Tree(page).path[0]
        assert rows[url].text == " ".join(" ".join(strings(root, ("script", "style", "nav", "footer", "header"))).split())
        body, whole = " ".join(strings(pruned(root))), " ".join(strings(root))
        if len(body) >= 100:
            assert (rows[url].place, rows[url].main) == ("body", body)
        else:
            own = [(n, " ".join(strings(f))) for n in ("article", "main") if (f := found(root, n))]
            assert (rows[url].place, rows[url].main) == next(((n, t) for n, t in own if t), ("page", whole))


def test_parents_without_children_are_those_that_no_child_names(spark):
    rows = chunks.chunk_pages(spark.read.parquet(f"{SMALL}/pages.parquet").select("url", "html")).collect()
    named = {r.parent_id for r in rows if r.kind == "child"}
    assert sorted(r.chunk_id for r in catalogue.QUERIES["parents_without_children"](spark, SMALL).collect()) == sorted(r.chunk_id for r in rows if r.kind == "parent" and r.chunk_id not in named)
    assert catalogue.QUERIES["page_text"](spark, SMALL).where(F.col("text").isNull()).count() == 0


def test_what_a_task_holds_does_not_grow_with_its_batch():
    """Pages that come as one batch leave in many, and are worked on in parts."""
    page = "<h1>One</h1>" + "".join(f"<h2>Part {k}</h2><p>{'word after word. ' * 60}</p>" for k in range(20))
    pages = pa.record_batch({"url": [f"u{k}" for k in range(400)], "html": [page] * 399 + [None]})
    made = list(chunks._chunked(chunks.Limits(), False)(iter([pages])))
    assert len(made) > 8 and max(b.nbytes for b in made) < 4 << 20
    assert sum(b.num_rows for b in made) == 399 * len(list(chunks.page_chunks("u", page, chunks.Limits())))
    assert max(p["html"].nbytes for p in chunks.parts_of(iter([pages]), "html")) < 2 << 20
