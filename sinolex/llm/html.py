"""Main text of HTML pages, with a suffix array over each host's page furniture.

A page is cut into text blocks. Blocks inside an article (or main) element and outside menus, headers, footers, sidebars,
notices, adverts, forms and comment sections are its body. The other blocks of a host's pages are joined to one token
stream; a suffix array finds the substrings of at least ``MIN_RUN`` tokens that occur on two or more pages. A block that
such substrings cover is boilerplate. What is left is the text of pages that mark no article.

Articles that occur on many pages of a host are wanted, so a marked article is never dropped for being repeated.

Marks are read on every element: element names, and class, id or role tokens made of names of furniture only.

A null or empty page has empty text. Repeated rows are separate pages. Pages with a null url form one host. The pages of a
host of more than ``ARRAY_BYTES`` don't meet in one task: Spark groups the hashes of their runs over the whole host, which
finds the same runs. Pages are read in one pass, whole at any length. Columns other than the three named are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinolex.llm.common import durable, hash_runs, hash_text_words

MIN_RUN = 8
COVERED = 0.5
#: Bytes of a host's pages up to which one suffix array holds it; beyond, its runs are grouped by hash.
ARRAY_BYTES = 8_000_000
#: Hosts up to which their page counts are broadcast; beyond, the join shuffles.
BROADCAST_HOSTS = 100_000

BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of which only their own end tag says where they end.
CONTAINERS = frozenset("article aside body button dialog div fieldset footer form head header main menu nav ol section select table template title ul noscript iframe svg figure details".split())
#: Elements that such a start tag ends.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
RAW = frozenset(["script", "style", "textarea", "xmp"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
FURNITURE = frozenset("aside button dialog footer form head iframe menu nav noscript select svg template title".split())
NAMES = frozenset("ad ads banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice popup related share sharing sidebar social subscribe toolbar widget".split())
STEMS = ("advert", "promo", "sponsor")
COMMENTS = frozenset(["comment", "comments", "disqus"])
TITLES = frozenset(["header", "banner", "masthead"])
#: Possessive, so that a tag is read once; quoted values may hold ``>``.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def names_of(attributes: str) -> list[frozenset]:
    """The furniture names that whole class, id or role tokens are made of: ``cookie-notice``, not ``has-sidebar`` or ``related-work``."""
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in re.split("[_-]+", token) if x]
            if parts and all(x in NAMES or x.startswith(STEMS) for x in parts):
                found.append(frozenset(parts))
    return found


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether it ends, attributes) of each tag in one pass; comments and raw elements have no name.

    A quote that is never closed is read as an ordinary character from there on, as are ``<`` that begin no tag.
    """
    at, pattern = 0, TAG
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            if (end := page.find(">", at)) < 0:
                return
            end += 1
            yield at, end, "", False, ""
        elif not page[at + 1 : at + 3].lstrip("/")[:1].isascii() or not page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
            at += 1
            continue
        else:
            m = pattern.match(page, at)
            if m is None:
                pattern = PLAIN_TAG
                if (m := pattern.match(page, at)) is None:
                    return  # no tag ends behind this place
            name, end = m[2].lower(), m.end()
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}\s*+>", re.I).search(page, end)
                yield at, close.end() if close else len(page), "", False, ""
                end = close.end() if close else len(page)
            else:
                yield at, end, name, bool(m[1]), m[3]
        at = end


def blocks(page: str | None) -> tuple[list[str], list[tuple[str, bool]]]:
    """The blocks of the marked article; the others, each with whether it is furniture."""
    main: list[str] = []
    rest: list[tuple[str, bool]] = []
    if not page:
        return main, rest
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # element, inside a main or article, an article, furniture, merely named furniture
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    hidden: list[str] = []  # furniture amid a block
    inside = article = fixed = named = furniture = False

    def close() -> None:
        for held, is_furniture in ((pieces, False), (hidden, True)):
            if held:
                if text := " ".join("".join(held).split()):
                    if inside and not is_furniture:
                        main.append(text)
                    else:
                        rest.append((text, is_furniture))
                held.clear()

    def end_of(name: str) -> None:
        """Takes elements from the stack up to the last one of the name; ends of inline elements don't reach over containers."""
        while stack and (name in CONTAINERS or stack[-1][0] not in CONTAINERS):
            opened[gone := stack.pop()[0]] -= 1
            if gone == name:
                return

    at = 0
    for begin, end, name, ends, attributes in tags(page):
        if begin > at:
            (hidden if furniture else pieces).append(entities.unescape(page[at:begin]))
        at = end
        if not name:
            continue
        if name in BLOCKS:
            close()
        if ends:
            if not opened[name]:
                continue
            if name in CONTAINERS:
                close()
            end_of(name)
        else:
            while stack and name in ENDED_BY.get(stack[-1][0], ()):
                end_of(stack[-1][0])
            # a name around an article says how the page is laid out; inside one it says what is not its text
            is_main = name in ("article", "main")
            marks = names_of(attributes) if attributes and not is_main and name not in ("body", "html") else []
            if name in HEADINGS:
                marks = [x for x in marks if not x <= TITLES]
            elif name == "span":  # coloured program text has comments
                marks = [x for x in marks if not x <= COMMENTS]
            if name not in CONTAINERS and (name in VOID or not (marks or opened[name])):
                if stack:
                    inside, article, fixed, named = stack[-1][1:]
                else:
                    inside = article = fixed = named = False
                furniture = fixed or named
                continue
            if name in CONTAINERS:
                close()
            up = stack[-1][1:] if stack else (False, False, False, False)
            now_fixed = up[2] or name in FURNITURE or (name == "header" and not up[0]) or any(x & COMMENTS for x in marks)
            stack.append((name, up[0] or is_main, up[1] or name == "article", now_fixed, (up[3] or bool(marks)) and (up[1] or not is_main)))
            opened[name] += 1
        inside, article, fixed, named = stack[-1][1:] if stack else (False, False, False, False)
        furniture = fixed or named
    if at < len(page):
        (hidden if furniture else pieces).append(entities.unescape(page[at:]))
    close()
    return main, rest


def repeated(tokens: np.ndarray, pages: np.ndarray, length: int = MIN_RUN) -> np.ndarray:
    """Marks tokens inside a run of ``length`` tokens that occurs on two or more pages.

    Suffixes are sorted by their first ``length`` tokens, doubling the sorted depth each round.
    """
    n = len(tokens)
    cover = np.zeros(n, bool)
    if n < length:
        return cover
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < length:
        step = min(depth, length - depth)
        m = len(rank) - step
        rank, depth = np.unique(rank[:m] * np.int64(n + 1) + rank[step:], return_inverse=True)[1].astype(np.int64), depth + step
    last = pages[length - 1 :]
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
    first_page, last_page = np.minimum.reduceat(pages[: len(rank)][order], starts), np.maximum.reduceat(pages[: len(rank)][order], starts)
    many = np.repeat(first_page != last_page, np.diff(np.append(starts, len(order))))
    hit = np.zeros(len(rank), bool)
    hit[order] = many
    hit &= pages[: len(rank)] == last  # within one page
    edge = np.zeros(n + 1, np.int64)
    found = np.flatnonzero(hit)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + length, -1)
    return np.cumsum(edge[:-1]) > 0


def unmarked(rest: list[tuple[str, bool]], cover: np.ndarray) -> str:
    """The blocks of a page that are neither furniture nor covered, given which of its tokens are."""
    kept, at = [], 0
    for text, furniture in rest:
        end = at + len(text.split())
        if not furniture and cover[at:end].sum() < COVERED * (end - at):
            kept.append(text)
        at = end
    return "\n".join(kept)


def clean(host: list[tuple[str, list[tuple[str, bool]]]]) -> list[str]:
    """The main texts of all pages of a host: its suffix array decides on the other blocks."""
    ids: dict[str, int] = {}
    streams = [[ids.setdefault(w, len(ids)) for text, _ in rest for w in text.split()] for _, rest in host]
    sizes = [len(s) for s in streams]
    cover = repeated(np.array([i for s in streams for i in s], np.int64), np.repeat(np.arange(len(host)), sizes))
    covers = np.split(cover, np.cumsum(sizes)[:-1]) if host else []
    return [main or unmarked(rest, c) for (main, rest), c in zip(host, covers, strict=True)]


def run_hashes(rest: list[tuple[str, bool]]) -> np.ndarray:
    """A hash for each run of ``MIN_RUN`` tokens of a page's other blocks, in order."""
    words = hash_text_words("\n".join(text for text, _ in rest).encode("utf-8", "surrogatepass"))
    return hash_runs(words, MIN_RUN).view(np.int64) if len(words) >= MIN_RUN else np.empty(0, np.int64)


def clean_by_hash(main: str, rest: list[tuple[str, bool]], shared: np.ndarray | None) -> str:
    """The main text of one page, given the hashes of its runs that other pages of the host hold."""
    if main:
        return main
    edge = np.zeros(sum(len(text.split()) for text, _ in rest) + 1, np.int64)
    if shared is not None:
        found = np.flatnonzero(np.isin(run_hashes(rest), shared))
        np.add.at(edge, found, 1)
        np.add.at(edge, found + MIN_RUN, -1)
    return unmarked(rest, np.cumsum(edge[:-1]) > 0)


def parsed(rows: DataFrame) -> DataFrame:
    """(page_id, url, host, key, main, rest, named): the blocks of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [blocks(p) for p in batch["html"]]
            out = batch[["page_id", "url", "host", "key"]].copy()
            out["main"] = ["\n".join(main) for main, _ in made]
            out["rest"] = [[text for text, _ in rest] for _, rest in made]
            out["named"] = [[named for _, named in rest] for _, rest in made]
            yield out

    given = [rows.schema[c] for c in ("page_id", "url", "host", "key")]
    new = T._parse_datatype_string("main string, rest array<string>, named array<boolean>").fields
    return rows.mapInPandas(run, T.StructType([*given, *new]))


def shared_runs(rows: DataFrame) -> DataFrame:
    """(key, runs): for pages that mark no article the hashes of their runs that two or more pages of the host hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [blocks(p) for p in batch["html"]]
            found = [np.unique(run_hashes(rest)) for _, rest in made]
            at = np.repeat(np.arange(len(made)), [len(f) for f in found])
            still_open = np.array([not main for main, _ in made], bool)
            run = np.concatenate([np.empty(0, np.int64), *found])
            yield pd.DataFrame({"host": batch["host"].to_numpy()[at], "key": batch["key"].to_numpy()[at], "open": still_open[at], "run": run})

    runs = rows.mapInPandas(run, "host string, key long, open boolean, run long")
    # a page gives each of its runs once, so rows are pages; repeated rows count as the pages they are
    shared = runs.groupBy("host", "run").agg(F.count("*").alias("pages"), F.max("open").alias("open")).where("pages > 1 and open").select("host", "run")
    return runs.where("open").join(shared, ["host", "run"]).groupBy("key").agg(F.collect_set("run").alias("runs"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType
    # whole numbers pass as text, since pandas would turn those beside nulls into floats
    page_id = F.col(id_col).cast("string") if isinstance(kind, T.IntegralType) else F.col(id_col)
    rows = pages.select(page_id.alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = rows.withColumn("host", host).withColumn("key", F.xxhash64("page_id", "url", "html", F.col("page_id").isNull(), F.col("url").isNull()))
    large = durable(rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > ARRAY_BYTES).select("host"))
    n = large.count()
    hint = F.broadcast(large) if n <= BROADCAST_HOSTS else large
    schema = T.StructType([rows.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def made(batch: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    def one_host(batch: pd.DataFrame) -> pd.DataFrame:
        return made(batch, clean([(main, list(zip(rest, named, strict=True))) for main, rest, named in zip(batch["main"], batch["rest"], batch["named"], strict=True)]))

    def one_page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield made(batch, [clean_by_hash(main, list(zip(rest, named, strict=True)), runs) for main, rest, named, runs in zip(batch["main"], batch["rest"], batch["named"], batch["runs"], strict=True)])

    out = parsed(rows.join(hint, "host", "left_anti") if n else rows).groupBy("host").applyInPandas(one_host, schema)
    if n:
        rest = rows.join(hint, "host", "left_semi")
        out = out.union(parsed(rest).join(shared_runs(rest), "key", "left").mapInPandas(one_page, schema))
    return out.withColumn("page_id", F.col("page_id").cast(kind))
