"""Pages: text from HTML, links, front matter, titles, groups, and retrieval for questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import SPACE, blank, collapsed, filled, trimmed
from factloom.sources.scratch import written

#: Entities in the order they are decoded, and the order of page groups.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
GROUPS = ("(root)", "Topics", "Sources", "Claims", "Questions", "Lint")
#: Texts of so many pages are Python strings at once.
PAGES = 64


def html_text(html: Column) -> Column:
    """Text of HTML: script, style and noscript blocks and tags gone, entities decoded, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapsed(text)


def extract_page_text(pages: DataFrame, max_chars: int = 8000, html: str = "html", url: str = "url") -> DataFrame:
    """Other columns, ``title`` (of the page, else its URL), ``content``, ``status`` and ``error``.

    Text that holds no tag is taken as it is, trimmed. Longer texts are cut and marked.
    """
    raw = F.coalesce(html, F.lit(""))
    is_html = raw.rlike(r"(?is)<(!doctype|html|head|body|title|p|div)\b")
    rows = pages.withColumn("_text", F.when(is_html, html_text(raw)).otherwise(trimmed(raw)))
    title = html_text(F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1))
    cut = F.when(F.length("_text") > max_chars, F.concat(F.substring("_text", 1, max_chars), F.lit("\n[...truncated]"))).otherwise(F.col("_text"))
    empty = F.col("_text") == ""
    return rows.select(
        *[c for c in pages.columns if c not in (html, "title")],
        filled(title, F.col(url)).alias("title"),
        F.when(~empty, cut).alias("content"),
        F.when(empty, "failed").otherwise("ok").alias("status"),
        F.when(empty, "Empty page content").alias("error"),
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """``path``, ``position``, ``target`` and ``alias`` of each ``[[target|alias]]`` outside code."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"`[^`]*`", " ")
    text = F.regexp_replace(text, r"(?s)```.*?```", " ")
    link = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
    parts = [F.regexp_extract_all("_t", F.lit(link), F.lit(i)) for i in (1, 2)]
    rows = pages.withColumn("_t", text).select("path", F.posexplode(F.arrays_zip(parts[0].alias("a"), parts[1].alias("b"))).alias("position", "l"))
    return rows.select("path", (F.col("position") + 1).alias("position"), trimmed("l.a").alias("target"), F.nullif(trimmed("l.b"), F.lit("")).alias("alias"))


def normal_path(path: Column) -> Column:
    """A path with ``/``, and without ``.``, empty parts and what ``..`` takes back."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    return F.array_join(F.aggregate(parts, none, step), "/")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``links`` with ``resolved_path``: the target beside the page, else from the root; null if neither exists."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    near, root = normal_path(F.concat(folder, "target", F.lit(".md"))), normal_path(F.concat("target", F.lit(".md")))
    known = pages.select(F.col("path").alias("_p")).distinct()
    rows = links.withColumns({"_near": near, "_root": root})
    rows = rows.join(known.withColumnRenamed("_p", "_a"), F.col("_near") == F.col("_a"), "left")
    rows = rows.join(known.withColumnRenamed("_p", "_b"), F.col("_root") == F.col("_b"), "left")
    found = F.coalesce("_a", "_b")
    return rows.select(*links.columns, found.alias("resolved_path"), found.isNotNull().alias("exists"))


def read_frontmatter(pages: DataFrame) -> DataFrame:
    """``path``, ``fields`` (map of text), ``lists`` (map of arrays) and ``body`` of each page."""
    content = F.coalesce("content", F.lit(""))
    block = F.regexp_extract(content, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    rows = pages.select("path", block.alias("_b"), F.regexp_replace(content, r"(?s)^---\r?\n.*?\r?\n---\r?\n*", "").alias("body"))
    bare = lambda c: trimmed(F.regexp_replace(c, r"""^["']|["']$""", ""))
    key, item = r"(?m)^([a-zA-Z0-9_-]+):[ \t]*(\S.*?)\r?$", r"(?m)^[ \t]+-[ \t]+(.+?)\r?$"
    listed = r"(?m)^([a-zA-Z0-9_-]+):[ \t]*\r?\n((?:[ \t]+-[ \t]+.*\n?)*)"
    pick = lambda pattern, i: F.regexp_extract_all(F.col("_b"), F.lit(pattern), F.lit(i))
    latest = lambda m: F.map_from_entries(m)
    scalars = F.arrays_zip(pick(key, 1).alias("k"), F.transform(pick(key, 2), bare).alias("v"))
    lists = F.arrays_zip(
        pick(listed, 1).alias("k"), F.transform(pick(listed, 2), lambda x: F.transform(F.regexp_extract_all(x, F.lit(item), F.lit(1)), bare)).alias("v")
    )
    last = lambda a: F.filter(a, lambda x, i: F.forall(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] != x["k"]))  # noqa: E731  repeats: the last
    # columns of their own: within the filter the patterns would be tried again for each field
    rows = rows.select("path", scalars.alias("_scalars"), lists.alias("_lists"), "body")
    return rows.select("path", latest(last(F.col("_scalars"))).alias("fields"), latest(last(F.col("_lists"))).alias("lists"), "body")


def page_titles(pages: DataFrame) -> DataFrame:
    """``path`` and ``title``: from the front matter, else the file's name without ``.md`` and its source number."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?i)\.md$", "")
    told = read_frontmatter(pages).select("path", F.col("fields")["title"].alias("title"))
    return told.select("path", filled("title", F.regexp_replace(name, r"^Source \d{3} - ", "")).alias("title"))


def filter_pages(pages: DataFrame, text: str | None) -> DataFrame:
    """Pages whose path or title holds the text in any case; all of them for a blank text."""
    wanted = (text or "").strip().lower()
    if not wanted:
        return pages
    return pages.where(F.contains(F.lower("path"), F.lit(wanted)) | F.contains(F.lower("title"), F.lit(wanted)))


def page_groups(pages: DataFrame) -> DataFrame:
    """``segment`` (first part of the path), ``n_pages`` and ``place``, without templates."""
    segment = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^([^/]*)/", 1)).otherwise("(root)")
    rows = pages.withColumn("segment", segment).where("segment <> 'Templates'")
    known = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("segment"))
    grouped = rows.groupBy("segment").agg(F.count("*").alias("n_pages"))
    return grouped.withColumn("place", F.when(known > 0, known).otherwise(len(GROUPS) + 1)).orderBy("place", "segment")


def retrieve(questions: DataFrame, pages: DataFrame, k: int = 5, excerpt: int = 400, block_bytes: int = 8 << 20) -> DataFrame:
    """``question_id``, ``rank``, ``path``, ``score`` and ``excerpt`` of each question's best k pages with a score.

    A page scores 1 for each word of the question longer than two characters that it contains anywhere (a
    repeated word counts again), and 5 for the whole question, spaces at its ends included; ties go by path.
    Blank questions have no result. Pages of one path share the least of their excerpts.

    Questions go to the pages, ``block_bytes`` of them at a time, and texts are never shuffled: a task reads each of
    its pages once for all different words of a block and keeps each question's best k pages, so what leaves it is
    bounded by the questions.
    """
    spark, lowered = questions.sparkSession, F.lower("question")
    words = F.filter(F.split(lowered, f"{SPACE}+"), lambda w: F.length(w) > 2)
    asked = questions.where(~blank("question")).select(F.col("question_id").alias("id"), lowered.alias("q"), words.alias("words"))
    asked = written(asked.withColumn("number", F.monotonically_increasing_id()), "questions")
    blocks = -(-(asked.agg(F.sum(F.octet_length("q") + 16)).first()[0] or 0) // block_bytes)
    pages = pages.withColumn("path", F.coalesce("path", F.lit("")))
    texts = pages.select("path", F.coalesce(F.lower("content"), F.lit("")).alias("text"))
    found = asked.limit(0).select("number", F.lit("").alias("path"), F.lit(0).cast("long").alias("score"))
    kind = "number long, path string, score long"
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).toArrow()
        held = spark.sparkContext.broadcast([some[c].to_pylist() for c in ("number", "q", "words")])
        best = written(texts.mapInArrow(_best_pages(held, k), kind), "best-pages")
        found = found.unionByName(best) if b else best
        held.unpersist()
    order = Window.partitionBy("number").orderBy(F.desc("score"), "path")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    shown = pages.join(best.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min(F.substring("content", 1, excerpt)).alias("excerpt"))
    return best.join(shown, "path").join(asked.select("number", F.col("id").alias("question_id")), "number").select("question_id", "path", "score", "excerpt", "rank")


def _best_pages(held, k: int):
    """``number``, ``path`` and ``score``: of each question the best k pages of a task."""

    def run(batches):
        import ahocorasick

        numbers, whole, word_lists = held.value
        n = len(numbers)
        number_of = {w: i for i, w in enumerate(sorted({w for words in word_lists for w in words} | {q for q, words in zip(whole, word_lists, strict=True) if not words}))}
        asks: list[list[int]] = [[] for _ in number_of]  # questions of each word, again for each time they have it
        bare: dict[int, list[int]] = {}  # of each text that is a question without words
        for j, words in enumerate(word_lists):
            for w in words:
                asks[number_of[w]].append(j)
            if not words:
                bare.setdefault(number_of[whole[j]], []).append(j)
        asked = np.array([j for a in asks for j in a], np.int64)
        size = np.array([len(a) for a in asks], np.int64)
        start = np.cumsum(size) - size
        most = np.array([len(w) or -1 for w in word_lists])
        finder = ahocorasick.Automaton()
        for w, i in number_of.items():
            finder.add_word(w, i)
        if number_of:
            finder.make_automaton()

        step = max(1, min(PAGES, (4 << 20) // max(n, 1)))
        none = np.zeros(0, np.int64)
        paths: list[str] = []  # of the pages in ``best`` and ``new``
        best, new = (none, none, none), []  # question, score and page
        least = np.ones(n, np.int64)  # what a page must score to be among a question's best
        waiting = 0

        def settle() -> None:
            """Of the best pages so far and the new ones each question keeps k, by score and then by path."""
            nonlocal best, new, paths, waiting
            j, score, page = (np.concatenate(x) for x in zip(best, *new, strict=True))
            kept, page = np.unique(page, return_inverse=True)
            paths = [paths[i] for i in kept.tolist()]
            place = np.empty(len(paths), np.int64)
            place[np.argsort(np.array(paths, object), kind="stable")] = np.arange(len(paths))
            order = np.lexsort((place[page], -score, j))
            j, score, page = j[order], score[order], page[order]
            rank = np.arange(len(j)) - np.searchsorted(j, j)
            last = rank == k - 1
            least[j[last]] = score[last]
            best, new, waiting = (j[rank < k], score[rank < k], page[rank < k]), [], 0

        for batch in batches:
            for at in range(0, len(batch) if number_of else 0, step):
                named, bodies = (batch.column(i).slice(at, step).to_pylist() for i in (0, 1))
                found = [{i for _, i in finder.iter(body)} for body in bodies]
                word = np.array([i for some in found for i in some], np.int64)
                page = np.repeat(np.arange(len(found)), [len(some) for some in found])
                many = size[word]
                asking = np.repeat(start[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
                scores = np.bincount(np.repeat(page, many) * n + asked[asking], minlength=len(found) * n).reshape(len(found), n)
                # a page that holds a whole question holds all its words
                for p, j in zip(*(x.tolist() for x in np.nonzero(scores == most)), strict=True):
                    if whole[j] in bodies[p]:
                        scores[p, j] += 5
                if bare:
                    for p, some in enumerate(found):
                        for i in some & bare.keys():
                            scores[p, bare[i]] += 5
                p, j = np.nonzero(scores >= least)
                kept, page = np.unique(p, return_inverse=True)
                new.append((j, scores[p, j], page + len(paths)))
                paths += [named[i] for i in kept.tolist()]
                waiting += len(j)
                # what waits is bounded by the questions; few pages reach what the best have, once they are known
                if waiting > 4 * k * n:
                    settle()
        settle()
        j, score, page = best
        columns = [pa.array([numbers[i] for i in j.tolist()], pa.int64()), pa.array([paths[i] for i in page.tolist()], pa.string()), pa.array(score)]
        yield pa.record_batch(columns, ["number", "path", "score"])

    return run
