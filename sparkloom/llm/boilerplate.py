"""Keeping the main body of web pages (problem 1).

Method: composite text density over the page's tree. The markdown of a page is read as a tree: the body, sections by heading
depth, blocks between blank lines, lines. Every node has characters, tags (itself and its markup), link characters and link
tags; its composite density is its characters per tag, adjusted by what of it are links, as Sun, Song and Liao (2011) define it.
The densities of a node's children are summed, the node with the largest sum is the core, and the least density on the path
from the core up to the body is the threshold. The outermost section that holds the core is the article, or the whole body where
several stand side by side, since sections belong together. Outside it a block of whatever kind, sentences and lists included, must reach the
threshold, or be no more linked than the page is. Inside it a line goes that is nothing but links, and a short one that is neither
structural nor a sentence and below the threshold. What a site puts around an article is short, or linked into the site itself, or
speaks of the site; characters of such furniture count as link characters, so they have no density of their own.

A page is read by itself, in Arrow batches, without any shuffle.

Defined results: lines end at ``\\n`` and count from 1; a trailing ``\\r`` is white space; blank lines are neither; null, empty and
blank bodies have no lines; a page without any dense line keeps only its headings, items, rows and quotes; rows that repeat or
were fetched again count once; a fetch_id with several bodies gives the lines of each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Titles of blocks that lead elsewhere in a site, in the four languages.
ELSEWHERE = (
    "you may also like", "most viewed", "most read", "most popular", "popular now", "trending", "related reading", "related articles", "related posts", "related",
    "in this category", "more from", "more on", "read next", "read more", "recommended", "latest", "see also on", "comments", "share this", "follow us", "newsletter",
    "à lire aussi", "lire aussi", "plus de", "les plus lus", "dans cette rubrique", "dans cette catégorie", "sur le même sujet", "articles liés", "commentaires",
    "también le puede interesar", "le puede interesar", "más de", "lo más leído", "más leído", "en esta categoría", "en esta sección", "artículos relacionados", "comentarios",
    "das könnte sie auch interessieren", "auch interessant", "mehr von", "meistgelesen", "in dieser kategorie", "in dieser rubrik", "ähnliche artikel", "weiterlesen", "kommentare",
)
VAGUE = frozenset(("related", "latest", "trending", "recommended", "comments", "newsletter", "plus de", "más de", "mehr von", "more from", "more on", "commentaires", "comentarios", "kommentare"))
# Labels of menus, buttons and tools.
LABELS = frozenset(
    "home|start|inicio|accueil|contact|kontakt|contacto|about|about us|über uns|à propos|quiénes somos|blog|archive|archives|archiv|archivo|help|help centre|hilfe|aide|ayuda|"
    "pricing|preise|tarifs|precios|status|docs|library|download|downloads|careers|community|support|products|reports|berichte|dossiers|temas|themen|team|sign in|log in|login|sign up|"
    "anmelden|connexion|entrar|search|suche|recherche|buscar|menu|menü|menú|topics|news|jobs|events|shop|share|print|print this page|imprimer|imprimir|seite drucken|drucken|copy link|"
    "copier le lien|copiar enlace|link kopieren|save for later|send by mail|listen to this page|back to top|nach oben|haut de page|volver arriba|advertisement|anzeige|publicidad|publicité|"
    "accept all|reject all|got it|only necessary|save preferences|manage settings|alle akzeptieren|ablehnen|einstellungen speichern|tout accepter|tout refuser|enregistrer|aceptar todo|"
    "rechazar|guardar|impressum|datenschutz|agb|imprint|privacy|terms of use|terms|legal notice|mentions légales|vie privée|aviso legal|privacidad|subscribe|unsubscribe|rss|feed".split("|")
)
# How sites speak to visitors and of themselves, in lower case.
SPEAKS = re.compile(
    r"(?:\b(?:we|this site|by continuing|accept|manage)\b.*\b(?:cookies?|tracking technolog\w+|choices)\b|\byour (?:privacy|device|choices|consent)\b|\bprivacy matters\b|\bon your device\b"
    r"|\b(?:wir verwenden|nous utilisons|usamos|utilizamos)\b.*\bcookies?\b|\bauf ihrem gerät\b|\bsur votre appareil\b|\ben su dispositivo\b|\bsie können frei\b|\busted decide\b"
    r"|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|may be reproduced|without the consent of|©|^\(c\) ?\d{4}"
    r"|^(?:share|teilen|partager|compartir) (?:on|auf|sur|en|with|this)\b|^follow \w+ ?:|^page last \w+|^last (?:updated|generated|modified)|^read next|^next article|^previous article"
    r"|^(?:lire ensuite|à suivre|siguiente|lea también|siga leyendo|weiterlesen|als nächstes|nächster beitrag)\b ?:?|^you are here|^sie sind hier|^vous êtes ici|^está en\b|^usted está"
    r"|\b(?:enjoying this|share it with|get one mail|one mail a week|newsletter|digest and|rundbrief|lettre de|boletín de)\b|\b(?:registration required|no card needed|free for \d+ days)\b"
    r"|\breceive a fee\b|\bdo not bind\b|^download the full|^try \w+ pro\b|^\d+ (?:comments?|kommentare?|commentaires?|comentarios?)$"
    r"|^(?:posted|published|updated) (?:in|on|by)\b|^\d+ (?:min|minutes?) read$|^tags? ?:|^filed under)",
)
LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
HEADING = re.compile(r"\s{0,3}(#{1,6})\s+\S")
ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
QUOTE = re.compile(r"\s*>")
TABLE_RULE = re.compile(r"\s*\|?[\s:|-]*---[\s:|-]*$")
MARKUP = re.compile(r"\*\*|__|`+|<[^>]+>|\|")
HASHTAGS = re.compile(r"\s*#[^\s#]+(?:\s+#[^\s#]+)*\s*$")
SPLIT_LABELS = re.compile(r"\s*(?:\||·|/|»|›|•|\*|\s{2,})\s*")
WORD = re.compile(r"[^\W_]+")


@dataclass
class Node:
    """A node of the page: its own counts and its children; ``line`` is set for leaves."""

    chars: int = 0
    tags: int = 1
    link_chars: int = 0
    link_tags: int = 0
    line: int = 0
    section: bool = False
    children: list["Node"] = field(default_factory=list)
    density: float = 0.0
    density_sum: float = 0.0

    def total(self) -> None:
        for c in self.children:
            c.total()
            self.chars += c.chars
            self.tags += c.tags
            self.link_chars += c.link_chars
            self.link_tags += c.link_tags

    def measure(self, body: "Node") -> None:
        """Composite text density: (C / T) * log(C/LC' * T/LT') to the base ln(C/notLC * LC + LCb/Cb * C + e)."""
        c, t, lc, lt = self.chars, self.tags, self.link_chars, self.link_tags
        if c:
            free = max(1, c - lc)
            base = math.log(c / free * lc + body.link_chars / max(1, body.chars) * c + math.e)
            ratio = (c / max(1, lc)) * (t / max(1, lt))
            self.density = max(0.0, c / t * math.log(max(ratio, 1.0)) / max(base, 1e-6 + math.log(base + 1.0)))
        for x in self.children:
            x.measure(body)
        self.density_sum = sum(x.density for x in self.children)

    def path_to_core(self) -> list["Node"]:
        """From this node down to the one of the largest density sum."""
        best: tuple[float, list[Node]] = (self.density_sum, [self])
        for c in self.children:
            if c.children:
                path = c.path_to_core()
                if path[-1].density_sum > best[0]:
                    best = (path[-1].density_sum, [self, *path])
        return best[1]

    def leaves(self) -> Iterator["Node"]:
        if self.line:
            yield self
        for c in self.children:
            yield from c.leaves()

    def blocks(self) -> Iterator["Node"]:
        if self.children and self.children[0].line:
            yield self
        else:
            for c in self.children:
                yield from c.blocks()

    def more_linked(self, body: "Node") -> bool:
        return self.link_chars * body.chars > body.link_chars * self.chars

    def only_links(self) -> bool:
        """Whether nothing of a line is text of its own: all its characters and tags are those of links."""
        return self.link_chars >= self.chars and self.link_tags >= self.tags


def article(path: list[Node]) -> Node:
    """The selected subtree: the outermost section that holds the core, or the body where that isn't its only section."""
    body = path[0]
    sections = [c for c in body.children if c.section]
    return sections[0] if len(sections) == 1 and any(x is sections[0] for x in path) else body


def site_names(url: str | None, origin: str | None) -> frozenset[str]:
    """The names by which a site may speak of itself: the labels of its host but for the last and the usual first ones."""
    host = re.sub(r"^[a-z]+://", "", (url or origin or "").lower()).split("/")[0].split(":")[0]
    parts = host.split(".")
    return frozenset(p for p in parts[:-1] if len(p) > 3 and p not in ("www", "docs", "notes", "blog", "news", "wiki"))


def bare(line: str) -> str:
    """A line without heading marks, emphasis and list marks."""
    return re.sub(r"^\s*(?:#{1,6}\s+|[-*+•]\s+|>\s*)?", "", line).strip().strip("*_ ").strip()


def leads_elsewhere(line: str, names: frozenset[str]) -> bool:
    """Whether a line is the title of a block of links into the site."""
    text = bare(line).lower().rstrip(":")
    if len(text) > 60 or text[-1:] in ".!?":
        return False
    named = not names.isdisjoint(WORD.findall(text))
    return any(text == t or text.startswith(t + " ") and len(text.split()) <= len(t.split()) + 3 and (named or t not in VAGUE) for t in ELSEWHERE)


def inside_site(target: str, names: frozenset[str]) -> bool:
    if not target or target[0] in "#/?" or not re.match(r"[a-z]+:", target):
        return True
    host = re.sub(r"^[a-z]+://", "", target.lower()).split("/")[0]
    return any(n in host.split(".") for n in names)


def is_furniture(line: str, names: frozenset[str], title: str) -> bool:
    """Whether a line, by itself, is what a site puts around an article."""
    text = line.strip()
    if HASHTAGS.match(text):
        return True
    if HEADING.match(line):
        return False
    links = LINK.findall(text)
    plain = LINK.sub(r"\1", text)
    low = bare(plain).lower()
    words = WORD.findall(low)
    if SPEAKS.search(low) or low[:1] in ("_", "*") and SPEAKS.search(low.lstrip("_*")):
        return True
    if names and not names.isdisjoint(words):
        return True
    parts = [bare(x).lower() for x in SPLIT_LABELS.split(bare(plain)) if x.strip(" *-_[]#")]
    known = sum(p in LABELS for p in parts)
    if parts and known * 2 > len(parts):
        return True
    if links and sum(len(a) for a, _ in links) > 0.5 * len(plain) and all(inside_site(b, names) for _, b in links):
        return True
    crumbs = [x.strip() for x in re.split(r"\s[/»›>]\s", plain) if x.strip()]
    return len(crumbs) >= 3 and bool(title) and crumbs[-1].lower() == title.lower()


def structural(line: str, neighbours: bool) -> bool:
    """Headings, items, quotes and rows of tables, which are short by nature."""
    return bool(HEADING.match(line) or ITEM.match(line) or QUOTE.match(line) or TABLE_RULE.match(line) or (line.count("|") >= 2 and (neighbours or line.strip()[0] == "|")))


def read_tree(lines: list[str], furniture: set[int]) -> Node:
    """The page's tree; characters of furniture lines count as link characters."""
    body = Node()
    open_sections: list[tuple[int, Node]] = [(0, body)]
    block: Node | None = None
    for i, line in enumerate(lines, 1):
        if not line.strip():
            block = None
            continue
        heading = HEADING.match(line)
        if heading:
            depth = len(heading[1])
            while open_sections[-1][0] >= depth:
                open_sections.pop()
            section = Node(section=True)
            open_sections[-1][1].children.append(section)
            open_sections.append((depth, section))
            block = None
        if block is None:
            block = Node()
            open_sections[-1][1].children.append(block)
        links = LINK.findall(line)
        text = LINK.sub(r"\1", line).strip()
        leaf = Node(chars=len(text), tags=1 + len(links) + len(MARKUP.findall(line)) // 2 + bool(ITEM.match(line)), link_chars=sum(len(a) for a, _ in links), link_tags=len(links), line=i)
        if i in furniture:
            leaf.link_chars, leaf.link_tags = leaf.chars, leaf.tags
        block.children.append(leaf)
        if heading:
            block = None
    return body


def foreign_lines(text: str | None, url: str | None = None, origin: str | None = None) -> list[int]:
    """The numbers of the non-blank lines that do not belong to the article."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    names = site_names(url, origin)
    title = next((bare(x) for x in lines if re.match(r"\s{0,3}#\s+\S", x)), "")
    furniture: set[int] = set()
    elsewhere = False
    for i, line in enumerate(lines, 1):
        if not line.strip():
            elsewhere = False
        elif leads_elsewhere(line, names):
            elsewhere = True
            furniture.add(i)
        elif HEADING.match(line):
            elsewhere = False
        elif elsewhere or is_furniture(line, names, title):
            furniture.add(i)
    body = read_tree(lines, furniture)
    body.total()
    body.measure(body)
    path = body.path_to_core()
    threshold = min(x.density for x in path)
    leaves = {x.line: x for x in body.leaves()}
    chosen = {x.line for x in article(path).leaves()} | {x.line for b in body.blocks() if b.density >= threshold or not b.more_linked(body) for x in b.leaves()}
    out = []
    for i, line in enumerate(lines, 1):
        if not line.strip():
            continue
        near = any(0 < j <= len(lines) and lines[j - 1].count("|") == line.count("|") for j in (i - 1, i + 1))
        dull = leaves[i].density < threshold and not structural(line, near) and not is_prose(line, lines, i)
        if i not in chosen or leaves[i].only_links() or dull:
            out.append(i)
    return out


def is_prose(line: str, lines: list[str], i: int) -> bool:
    """A sentence, or part of a wrapped one: it ends like one, or stands in a block of which it is an inner line."""
    text = line.strip()
    return len(WORD.findall(text)) >= 5 and (text.rstrip("\"'”»)*_]")[-1:] in ".!?…:;," or len(text) >= 45)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [foreign_lines(*x) for x in zip(b["body"].to_pylist(), b["url"].to_pylist(), b["origin"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["fetch_id"], pa.array(found, pa.list_(pa.int32()))], names=["fetch_id", "lines"])


def lines_outside_articles(pages: DataFrame, key: str = "fetch_id", body: str = "body_markdown", url: str = "url", origin: str = "origin") -> DataFrame:
    """(fetch_id, line_no) of every non-blank line that doesn't belong to its page's article."""
    rows = pages.select(F.col(key).alias("fetch_id"), F.col(body).alias("body"), F.col(url).alias("url"), F.col(origin).alias("origin")).where("body is not null")
    found = rows.mapInArrow(_read, f"fetch_id {rows.schema['fetch_id'].dataType.simpleString()}, lines array<int>")
    return found.select("fetch_id", F.explode("lines").alias("line_no")).distinct()


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, url, origin in zip(b["body"].to_pylist(), b["url"].to_pylist(), b["origin"].to_pylist()):
            gone = set(foreign_lines(text, url, origin))
            out.append(None if text is None else re.sub(r"\n{3,}", "\n\n", "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone)).strip("\n"))
        yield pa.RecordBatch.from_arrays([b["fetch_id"], pa.array(out, pa.string())], names=["fetch_id", "article"])


def articles(pages: DataFrame, key: str = "fetch_id", body: str = "body_markdown", url: str = "url", origin: str = "origin") -> DataFrame:
    """(fetch_id, article): each page's main body; null bodies stay null."""
    rows = pages.select(F.col(key).alias("fetch_id"), F.col(body).alias("body"), F.col(url).alias("url"), F.col(origin).alias("origin"))
    return rows.mapInArrow(_keep, f"fetch_id {rows.schema['fetch_id'].dataType.simpleString()}, article string")
