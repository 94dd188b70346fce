"""Benchmark decontamination by plain words and by template canonicalisation, in DataFrame functions only.

Numbers, units and names become typed placeholders, so an item and its re-parameterised copy share their template.
Windows of ``WINDOW`` words, of the template and of the plain words whatever their case, are hash-joined with the items' windows.
A pair of document and item is kept on one diagonal (document position minus item position) if at least ``LEAST``
windows meet, or all of a shorter item. Items of ``WINDOW`` words or more survive one changed word: of those too short to
keep ``LEAST`` windows then, all words but one must be there. Windows with other values than the item's count only if the values are consistent:
one item value never stands for two document values in them. Windows said word for word count in any case.

The windows of the items are broadcast only while they number at most ``BROADCAST_WINDOWS``; beyond that Spark joins
them as it sees fit. Documents and items are counted whole; items of fewer than ``WINDOW`` words are looked for at their
own length. Template windows with fewer than ``LITERALS`` words outside placeholders say nothing and are left out, so an
item of hardly more than names and numbers is found by its plain words (verbatim), not with other values.

Defined cases: null and empty texts match nothing; documents that share an id are reported as one, null ids likewise;
repeated items are reported one by one; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import GAP, settled

WINDOW, LEAST, LITERALS = 8, 3, 4
BROADCAST_WINDOWS = 1_000_000

# Units that become a placeholder.
UNITS = (
    "kg|g|mg|km|m|cm|mm|l|ml|km/h|mph|kwh|gb|mb|usd|eur|euros?|dollars?|pounds?|cents?|percent|%|hours?|minutes?|seconds?|"
    "days?|weeks?|months?|years?|miles?|feet|inches|inch|meters?|metres?|liters?|litres?|degrees?"
)
#: Patterns begin with a class of characters, which fails fast; that nothing stands before is looked at after it.
PUNCTUATION = r"!\"#&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
EDGES = rf"[{PUNCTUATION}](?<!\S.)[{PUNCTUATION}]*|[{PUNCTUATION}]+(?!\S)"
PLACEHOLDERS = (
    (r"[$€£0-9](?<!\S.)[0-9.,:/%-]*(?!\S)", "<number>"),
    (rf"<number>[\x20\x09-\x0D]+(?i:{UNITS})(?!\S)", "<number> <unit>"),
    (r"\p{Lu}(?<!\S.)\p{Ll}[\p{L}'-]*(?!\S)", "<name>"),
)
SLOTS = ("<number>", "<unit>", "<name>")


def plain(text: Column) -> Column:
    """The text without the punctuation at the ends of its words."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), EDGES, "")
    return F.btrim(bare, F.lit(" \t\n\v\f\r"))


def template(bare: Column) -> Column:
    """The plain text in lower case; numbers, units that follow them, and names as placeholders, word for word."""
    for pattern, name in PLACEHOLDERS:
        bare = F.regexp_replace(bare, pattern, name)
    return F.lower(bare)


def folded(bare: Column) -> Column:
    """The plain text without regard to case; by way of upper case, where one letter can become two."""
    return F.lower(F.upper(bare))


def words(text: Column) -> Column:
    """The words of a plain text or template; an empty one has a single empty word, which no item holds."""
    return F.split(text, GAP)


def with_windows(rows: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """Adds ``hs``: the hashes of the windows of every kind (column and width), one kind after the other, and ``begins``: where each begins.

    Windows grow by doubling: 1, 2, 4 ... words. Every step is a column of its own, so Spark keeps it instead of computing
    it for each use. Hashes of templates differ from those of the plain words.
    """
    def paired(left: str, gap: int) -> Column:
        n = F.greatest(F.size(left) - gap, F.lit(0))
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(left, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))

    made, all_made = {}, []
    for kind in sorted({k for k, _ in kinds}):
        widths, span = [w for k, w in kinds if k == kind], 1
        salt = F.lit(kind)
        rows = rows.withColumn(f"{kind}1", F.transform(kind, lambda t: F.xxhash64(t, salt)))  # noqa: B023
        all_made.append(f"{kind}1")
        while 2 * span <= max(widths):
            rows = rows.withColumn(f"{kind}{2 * span}", paired(f"{kind}{span}", span))
            span *= 2
            all_made.append(f"{kind}{span}")
        for width in widths:
            span = 1 << (width.bit_length() - 1)
            if span != width:
                rows = rows.withColumn(f"{kind}{width}", paired(f"{kind}{span}", width - span))
                all_made.append(f"{kind}{width}")
            made[kind, width] = f"{kind}{width}"
    columns = [made[k] for k in kinds]
    begins, at = [], F.lit(0)
    for c in columns:
        begins.append(at)
        at = at + F.size(c)
    return rows.withColumn("begins", F.array(*begins)).withColumn("hs", F.concat(*columns)).drop(*all_made)


def index(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(item_key, item_id, w, c, f, width, tells, n_windows) of the items and (item_key, c, f, kind, width, ats) of what is looked for.

    ``c`` are the plain words without regard to case, ``f`` the template; ``tells`` are the template windows with enough literal words.
    """
    known = items.select(F.col(item_id).alias("item_id"), plain(F.col(text)).alias("w")).filter("w <> ''")
    known = known.withColumn("item_key", F.xxhash64("item_id", "w"))
    known = known.select("item_key", "item_id", words(folded(F.col("w"))).alias("c"), words(template(F.col("w"))).alias("f"))
    known = known.withColumn("width", F.least(F.size("c"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(0), F.size("c") - F.col("width"))
    said = F.transform("f", lambda t: (~t.isin(*SLOTS)).cast("int"))
    literal = lambda at: F.aggregate(F.slice("said", at + 1, F.col("width")), F.lit(0), lambda a, x: a + x)
    known = known.withColumn("said", said).withColumn("starts", starts)
    known = known.withColumn("tells", F.filter("starts", lambda at: literal(at) >= F.least(F.lit(LITERALS), F.col("width"))))
    # windows of a template without a slot are those of the plain words
    slotted = F.filter("tells", lambda at: literal(at) < F.col("width"))
    known = settled(known.withColumn("slotted", slotted).withColumn("n_windows", F.size("starts")).dropDuplicates(["item_key"]))
    n = F.size("c")
    half = F.floor(n / 2).cast("int")
    wanted = F.array(
        F.struct(F.lit("c").alias("kind"), "width", F.col("starts").alias("ats")),
        F.struct(F.lit("f").alias("kind"), "width", F.col("slotted").alias("ats")),
        # the halves: one changed word leaves one of them; from 2 * WINDOW words on, they hold a window
        F.struct(F.lit("c").alias("kind"), half.alias("width"), F.when(n.between(WINDOW, 2 * WINDOW - 1), F.array(F.lit(0), n - half)).alias("ats")),
    )
    cuts = known.select("item_key", "c", "f", F.inline(wanted)).filter("size(ats) > 0")
    return known.drop("said", "slotted"), cuts


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item that it holds: windows met, where, slots, and whether values were replaced."""
    known, cuts = index(items, item_id, text)
    sizes = cuts.groupBy("kind", "width").agg(F.sum(F.size("ats")).alias("n")).orderBy("kind", "width").collect()  # a few rows for each width
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, {RESULT}")
    few = sum(r.n for r in sizes) <= BROADCAST_WINDOWS
    kinds = [(r.kind, r.width) for r in sizes]
    mine = []
    for k, (kind, width) in enumerate(kinds):
        part = cuts.filter((F.col("kind") == kind) & (F.col("width") == width))
        part = with_windows(part, [(kind, width)]).select("item_key", F.explode("ats").alias("at"), "hs")
        mine.append(part.select("item_key", "at", F.get("hs", F.col("at")).alias("h"), F.lit(k).alias("nth")))
    looked_for = mine[0]
    for part in mine[1:]:
        looked_for = looked_for.unionByName(part)
    rows = docs.select(F.col(doc_id).alias("doc_id"), plain(F.col(text)).alias("w"))
    rows = rows.select("doc_id", "w", words(folded(F.col("w"))).alias("c"), words(template(F.col("w"))).alias("f"), F.xxhash64("w").alias("row"))
    # outer, as for the inner form Spark would add a filter that computes all windows once more
    cut = with_windows(rows, kinds).select("doc_id", "w", "row", "begins", F.posexplode_outer("hs").alias("pos", "h"))
    met = cut.join(F.broadcast(looked_for) if few else looked_for, "h")
    diagonal = F.col("pos") - F.get("begins", F.col("nth")) - F.col("at")
    # texts are cut into words again only here, once for each document, item and diagonal
    found = met.groupBy("doc_id", "row", "item_key", diagonal.alias("diagonal")).agg(F.first("w").alias("w"))
    found = found.select("doc_id", "item_key", "diagonal", words(folded(F.col("w"))).alias("ours"), words(template(F.col("w"))).alias("forms"))
    found = found.join(known, "item_key")
    # the whole diagonal is compared word for word: the words, not only their hash
    pair = lambda kind, i: F.struct(
        kind.alias("kind"), F.get("c", i).alias("theirs"), F.get("ours", F.col("diagonal") + i).alias("ours"), F.get("forms", F.col("diagonal") + i).alias("form"),
    )
    found = found.withColumn("pairs", F.transform("f", pair))
    same = lambda s: F.coalesce(s["theirs"] == s["ours"], F.lit(False))
    found = found.withColumn("same", F.transform("pairs", same))
    found = found.withColumn("alike", F.transform("pairs", lambda s: same(s) | F.coalesce(s["kind"] == s["form"], F.lit(False))))
    whole = lambda c, at: F.forall(F.slice(c, at + 1, F.col("width")), lambda x: x)
    found = found.withColumn("exact", F.filter("starts", lambda at: whole("same", at)))
    found = found.withColumn("other", F.filter("tells", lambda at: whole("alike", at) & ~whole("same", at)))
    slots_of = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda at: F.transform(
        F.filter(F.slice("pairs", at + 1, F.col("width")), lambda s: s["kind"].isin(*SLOTS)), lambda s: F.struct(s["kind"], s["theirs"], s["ours"])))))
    found = found.withColumn("slots", slots_of("other"))
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["theirs"])))
    # windows with other values count only if these are consistent; those said word for word count in any case
    found = found.withColumn("ats", F.when(F.size(values) == F.size("slots"), F.concat("exact", "other")).otherwise(F.col("exact")))
    found = found.withColumn("slots", slots_of("ats"))
    enough = (F.size("ats") >= F.least(F.lit(LEAST), F.col("n_windows"))) | (
        (F.size("tells") > 0) & (F.size(F.array_intersect("ats", "tells")) >= F.least(F.lit(LEAST), F.size("tells"))))
    # where one changed word leaves fewer than LEAST windows, all other words must be there
    n = F.size("f")
    near = n.between(WINDOW, 2 * WINDOW + LEAST - 2) & (F.size(F.filter("same", lambda x: x)) >= n - 1)
    found = found.withColumn("near", near).filter(enough | F.col("near"))
    changed = F.size(F.filter("slots", lambda s: s["theirs"] != s["ours"]))
    best = F.struct(
        F.size("ats").alias("windows"), (-changed).alias("kept"), (-F.col("diagonal")).alias("early"), F.size("slots").alias("slots"),
        F.when(F.col("near"), F.greatest(F.col("diagonal"), F.lit(0))).otherwise(F.col("diagonal") + F.array_min("ats")).alias("first"),
        F.when(F.col("near"), F.least(F.col("diagonal") + n, F.size("ours"))).otherwise(F.col("diagonal") + F.array_max("ats") + F.col("width")).alias("end"),
    )
    found = found.groupBy("doc_id", "item_id", "n_windows").agg(F.max(best).alias("b"))
    long = lambda c: c.cast("long")
    return found.select(
        "doc_id", "item_id", long(F.col("b.windows")).alias("windows"), long(F.col("n_windows")).alias("item_windows"),
        long(F.col("b.first")).alias("first_word"), long(F.col("b.end")).alias("end_word"), long(F.col("b.slots")).alias("slots"),
        long(-F.col("b.kept")).alias("replaced"),
    )


RESULT = "windows long, item_windows long, first_word long, end_word long, slots long, replaced long"


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns kept."""
    hit = matches(docs, items, doc_id, text=text).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["__hit"]), "left_anti")
