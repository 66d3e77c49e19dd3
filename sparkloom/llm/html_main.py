"""Main text of web pages by consensus host paths.

1. Each page's containers are scored: a container's score is the text in it, at any depth, less three times the part in links, and
   nothing inside menus, headers, footers, sidebars, notices, adverts, forms and comments counts.
2. A page gives each of its containers a vote equal to that container's share of the page's score; votes are summed in Spark for
   each host and generalised tag-class path (numbers become #).
3. The deepest path with nearly all votes wins its host (inside an article or main, the whole of that), and every page of the
   host is read again with it. A page of which it does not hold nearly all is read with its own best container.

Defined cases: null or empty html has empty text; a null url, or one without a host, belongs to the empty host; a page without
scored text has empty text; repeated rows are kept; ties go to the path first in order; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import slices, texts, write_shared
from sparkloom.llm.html_blocks import Block, read

BATCH_BYTES = 4 << 20
LINK_COST = 3
#: Elements that never hold the article, and words in classes, ids and roles that mark the rest.
OUTSIDE = frozenset("head title nav aside footer form select button dialog menu noscript template".split())
_MARK = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|sidebar\w*|aside|widget\w*|cookies?\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|share\w*|social\w*|related\w*|recommend\w*|comments?|comment\w*|disqus\w*|repl(?:y|ies)|respond|login|signup|search\w*|pagination|pager|tags?|toolbar|navigation|complementary|contentinfo"
)
_HEADERS = frozenset(("header", "masthead"))
#: Elements that are never marked by their classes.
KEPT = frozenset("html body article main".split())
#: The part of a page's score that the chosen path must hold, on a page and in a host's votes.
NEARLY_ALL = 0.95


def marked(word: str, inside_article: bool) -> bool:
    """True for a class, id or role each part of which is a mark or a number: cookie-banner and ad-#, not has-sidebar."""
    parts = [x for x in re.split(r"[-_]+", word) if x and x != "#"]
    return word == "!hidden" or bool(parts) and all(_MARK.fullmatch(x) or (x in _HEADERS and not inside_article) for x in parts)


def outside(path: tuple[str, ...], tag: str) -> bool:
    """True for blocks of menus, headers, footers, sidebars, notices, adverts, forms and comments."""
    inside_article = False
    for s in (*path, tag):
        name, *words = s.split(".")
        if name in OUTSIDE or (name == "header" and not inside_article) or "!hidden" in words:
            return True
        inside_article |= name in ("article", "main")
        if name not in KEPT and any(marked(w, inside_article) for w in words):
            return True
    return False


def scores(blocks: list[Block]) -> dict[str, float]:
    """Score of each container path of a page that may hold the article: of its own blocks and those further down."""
    out: dict[str, float] = defaultdict(float)
    for b in blocks:
        if not outside(b.path, b.tag):
            for i in range(len(b.path) + 1):
                out["/".join(b.path[:i])] += len(b.text) - LINK_COST * b.links
    return {k: v for k, v in out.items() if v > 0}


def chosen(votes: dict[str, float]) -> str | None:
    """The deepest path with nearly all votes of the root, first in order; from inside an article (or else main) the whole of it."""
    need = NEARLY_ALL * votes.get("", 0.0)
    fit = [k for k, v in votes.items() if v >= need and v > 0]
    if not fit:
        return None
    steps = min(fit, key=lambda k: (-(k.count("/") + bool(k)), k)).split("/")
    for name in ("article", "main"):
        at = [i for i, s in enumerate(steps) if s.partition(".")[0] == name]
        if at:
            return "/".join(steps[: at[0] + 1])
    return "/".join(steps)


def under(path: str, winner: str) -> bool:
    return not winner or path == winner or path.startswith(winner + "/")


def main_text(blocks: list[Block], winner: str | None) -> str:
    """Blocks under the winning path, or under the page's own best container where that does not hold nearly all of its score."""
    own = scores(blocks)
    if winner is None or own.get(winner, 0.0) < NEARLY_ALL * own.get("", 0.0) or not any(under("/".join(b.path), winner) for b in blocks):
        winner = chosen(own)
    if winner is None:
        return ""
    return "\n".join(b.text for b in blocks if under("/".join(b.path), winner) if not outside(b.path, b.tag))


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the winning container path of each host that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", BATCH_BYTES):
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, source in zip(b.column(0).to_pylist(), texts(b, "html")):
                own = scores(read(source).blocks)
                for path, score in own.items():
                    if total := own.get("", 0.0):
                        votes[host, path] += min(1.0, score / total)
            cols = [[k[0] for k in votes], [k[1] for k in votes], list(votes.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], names=["host", "path", "votes"])

    # votes are rounded, so that their sums don't depend on the order of rows
    votes = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, votes double")
    summed = write_shared(votes.groupBy("host", "path").agg(F.sum(F.round(F.col("votes") * 1e6).cast("long")).alias("votes")), "host-votes")
    root = summed.where("path = ''").select("host", (F.col("votes") * NEARLY_ALL).alias("need"))
    deep = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    winners = summed.join(root, "host").where("votes >= need").groupBy("host").agg(F.min_by("path", F.struct(-deep, "path")).alias("path"))
    lift = lambda name: F.regexp_extract("path", rf"^((?:[^/]*/)*?{name}(?:\.[^/]*)?)(?:/|$)", 1)
    return winners.select("host", F.when(lift("article") != "", lift("article")).when(lift("main") != "", lift("main")).otherwise(F.col("path")).alias("path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    winners = write_shared(host_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    joined = rows.join(winners, "host", "left").select(id_col, "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", BATCH_BYTES):
            out = [main_text(read(source).blocks, path) for source, path in zip(texts(b, "html"), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    out = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(run, out)
