"""Main text of web pages by wrapper induction over the pages of a host.

1. Every page becomes an outline: its tree of elements, where a run of equal siblings is one node.
2. The host's most frequent outline, counted over all its pages, is its first reference.  Every outline
   is aligned with it by simple tree matching; those of which too little matches (``ALIKE``) come from
   another template, and the most frequent of them is the next reference, until fewer than ``LEAST`` pages
   of the host are left.  Matched nodes are slots of the reference.
3. A slot's text is its main text: without elements that are menus, notices and the like by their
   tag, role or class.  Over all pages of the reference, a slot whose text is the same on nearly every
   page is template, any other is content.  References of fewer than ``LEAST`` pages, and those whose
   main text would all be template (groups of copies), have no template.
4. A page's text is its main text without the slots that hold just what the template holds there.

Counts are combined before they are shuffled, and joins that could meet a host with a third of all
pages deal it over tasks.  Wrappers are one small row for each host.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm import dom
from sightline.llm.spread import join_spread
from sightline.llm.workers import bound_batches
from sightline.sources.work import cut

#: Pages that a host must have for a template, and the share of them that a template text is on.
LEAST, SHARE = 5, 0.9
#: Pages of one host that a task of the last join takes.
HOST_PAGES = 2000
#: The part of two outlines' nodes that matches within a template.
ALIKE = 0.5
#: Outlines of a host that are looked at for references in one pass; it doubles up to the second number.
WAVE, WIDEST = 8, 64


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _outlines(it):
    for batch in it:
        trees, keys, hashes = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = dom.parse(html.as_py() or "")
            tree, number = dom.layout(root)
            texts = dom.slot_texts(root, number)
            trees.append(tree)
            keys.append(hashlib.blake2b(f"{host}\n{tree}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            hashes.append([(i, _hash(t)) for i, t in texts.items()])
        kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(trees, pa.string()), pa.array(keys, pa.string()), pa.array([[{"node": i, "text": t} for i, t in x] for x in hashes], kind)],
            names=["host", "outline", "key", "texts"],
        )


def _references(it):
    """The outlines of each host, most frequent first, without those that one before them is the template of."""
    for batch in it:
        out = []
        for outlines in batch.column("outlines").to_pylist():
            kept: list[str] = []
            for own in outlines:
                if all(aligned(own, ref) is None for ref in kept):
                    kept.append(own)
            out.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.string()))], names=["host", "references"])


def _slots(it):
    """The first reference that an outline is aligned with: its place, and the slot (number in the reference) of each
    node, -1 for none; null if too little matches any."""
    for batch in it:
        places, slots = [], []
        for own, refs in zip(batch.column("outline").to_pylist(), batch.column("references").to_pylist()):
            place, slot = None, None
            for k, ref in enumerate(refs):
                pairs = aligned(own, ref)
                if pairs is not None:
                    place, slot = k, [-1] * dom.size(own)
                    for i, j in pairs:
                        slot[i] = j
                    break
            places.append(place)
            slots.append(slot)
        found = [None if k is None else refs[k] for k, refs in zip(places, batch.column("references").to_pylist())]
        names = ["host", "outline", "key", "n"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(places, pa.int32()), pa.array(found, pa.string()), pa.array(slots, pa.list_(pa.int32()))],
            names=[*names, "place", "reference", "slots"],
        )


def _common(own: str, reference: str) -> int:
    """Lines that two outlines share, which no matching exceeds, as it keeps depths and labels."""
    a, b = _lines(own), _lines(reference)
    return sum(min(n, b[line]) for line, n in a.items() if line in b)


def _lines(outline: str) -> Counter:
    return _counted(outline) if len(outline) < 50_000 else _counted.__wrapped__(outline)


@functools.lru_cache(5000)
def _counted(outline: str) -> Counter:
    return Counter(outline.split("\n"))


def aligned(own: str, reference: str) -> list[tuple[int, int]] | None:
    """Pairs of nodes of two outlines, or none if they are not of one template."""
    enough = ALIKE * (dom.size(own) + dom.size(reference))
    if own != reference and 2 * _common(own, reference) < enough:
        return None
    pairs = dom.match(own, reference)
    return pairs if 2 * len(pairs) >= enough else None


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each host: ``host, pages`` and ``wrappers``, an array of ``rank``, ``reference`` (outline)
    and ``template`` (slots whose text is template, and the hash of that text; empty without any)."""
    bound_batches(pages.sparkSession)
    picked = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    outlines = cut(
        picked.mapInArrow(_outlines, "host string, outline string, key string, texts array<struct<node int, text long>>"), "outlines"
    )
    kinds = cut(outlines.groupBy("host", "key").agg(F.first("outline").alias("outline"), F.count(F.lit(1)).alias("n")), "kinds")
    aligned_ones, left, before, wave = [], kinds, 0, WAVE
    while True:
        place = F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), F.desc("outline")))
        first = left.withColumn("i", place).where(F.col("i") <= wave)
        first = first.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "outline"))), lambda x: x["outline"]).alias("outlines"))
        enough = left.groupBy("host").agg(F.sum("n").alias("pages")).where(F.col("pages") >= LEAST)
        asked = first.join(enough.select("host"), "host")
        references = cut(asked.mapInArrow(_references, "host string, references array<string>"), "references")
        if references.isEmpty():
            break
        ddl = "host string, outline string, key string, n long, place int, reference string, slots array<int>"
        tried = join_spread(left, references, "host").select("host", "outline", "key", "n", "references").mapInArrow(_slots, ddl)
        tried = cut(tried, "tried")
        aligned_ones.append(tried.where("slots is not null").withColumn("rank", F.col("place") + before))
        left = tried.where("slots is null").select("host", "key", "outline", "n")
        before, wave = before + wave, min(2 * wave, WIDEST)
    counts = kinds.groupBy("host").agg(F.sum("n").alias("pages"))
    if not aligned_ones:
        return counts.withColumn("wrappers", F.array().cast("array<struct<rank int, reference string, template array<struct<slot int, text long>>>>"))
    slots = functools.reduce(DataFrame.unionByName, aligned_ones)
    slots = slots.select("key", "rank", "slots", "reference")
    totals = cut(
        join_spread(kinds, slots.drop("slots"), "key").groupBy("host", "rank").agg(F.first("reference").alias("reference"), F.sum("n").alias("pages")),
        "totals",
    )
    filled = (
        join_spread(outlines.select("host", "key", "texts"), slots.drop("reference"), "key", kinds.select("key", F.col("n").alias("rows")))
        .select("host", "rank", "slots", F.explode("texts").alias("s"))
        .select("host", "rank", F.get("slots", "s.node").alias("slot"), "s.text")
        .where("slot >= 0")
        .groupBy("host", "rank", "slot", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_slot = filled.groupBy("host", "rank", "slot").agg(F.max(F.struct("n", "text")).alias("most"), F.sum("n").alias("n")).join(
        totals, ["host", "rank"]
    )
    constant = (F.col("n") >= LEAST) & (F.col("most.n") >= SHARE * F.col("pages"))
    wrappers = (
        per_slot.groupBy("host", "rank")
        .agg(
            F.first("reference").alias("reference"),
            F.array_sort(F.collect_list(F.when(constant, F.struct("slot", "most.text")))).alias("template"),
            F.count_if(~constant).alias("content"),
        )
        .withColumn("template", F.when(F.col("content") > 0, F.col("template")).otherwise(F.slice("template", 1, 0)))
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "reference", "template"))).alias("wrappers"))
    )
    return counts.join(wrappers, "host", "left")


def _extract(it):
    for batch in it:
        texts = []
        for html, wrappers in zip(batch.column("html").to_pylist(), batch.column("wrappers").to_pylist()):
            root = dom.parse(html or "")
            tree, number = dom.layout(root)
            drop: set[int] = set()
            if any(w["template"] for w in wrappers or ()):
                for w in wrappers:
                    pairs = aligned(tree, w["reference"])
                    if pairs is not None:
                        wanted, own = {t["slot"]: t["text"] for t in w["template"]}, dom.slot_texts(root, number)
                        drop = {i for i, j in pairs if i in own and j in wanted and _hash(own[i]) == wanted[j]}
                        break
            texts.append("\n".join(dom.blocks(root, number, drop)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row for each page row: ``page_id, url, text, n_chars`` (code points).

    Blocks of text, white space inside each made one space, joined by a line feed.  Null or empty
    pages have the empty text; broken markup is read as far as it goes; pages without URL share one
    host.  Repeated rows each keep their row; an empty table gives none.  Very long or deeply nested pages
    are read whole.  Of outlines that are as frequent, the greatest is the reference.  Other columns are
    not looked at.
    """
    wrappers = cut(induce_wrappers(pages, url_col, html_col), "wrappers")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    counts = wrappers.select("host", F.col("pages").alias("rows"))
    # references after the last one that has a template change nothing
    last = F.array_max(F.transform(F.filter("wrappers", lambda w: F.size(w["template"]) > 0), lambda w: w["rank"]))
    useful = wrappers.withColumn("last", last).select("host", F.filter("wrappers", lambda w: w["rank"] <= F.col("last")).alias("wrappers"))
    joined = join_spread(rows, useful, "host", counts, rows=HOST_PAGES).select("page_id", "url", "html", "wrappers")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
