"""Operator 7 [native], benchmark decontamination by winnowing.

A benchmark item's windows are its runs of `length` consecutive words; a
shorter item is one window. Words that lie inside any occurrence of a window in
a document are hit.

Winnowing keeps, of each `length` consecutive words, the least hash among the
`gram`-word runs inside. The choice depends on those words only, so wherever a
window occurs its fingerprint is among the document's: no occurrence is missed.
Documents' distinct fingerprints are joined with the items'. Only documents
with a common fingerprint are read again; each place of such a fingerprint is
extended to the windows that contain it, and these are compared with the
benchmark's as exact word sequences. Item windows shorter than `length` get
fingerprints of their own length.

All of it is DataFrame functions. The benchmark's side is small in practice but not
by definition: it is broadcast up to BROADCAST_ROWS windows and BROADCAST_BYTES of their words and items, both counted first, and
shuffled beyond that. Of a document only distinct fingerprints leave its row,
and windows come back as one list per fingerprint, so a passage that many documents share makes
rows in proportion to those documents.

Defined cases: null, empty or wordless texts and items have no windows;
repeated rows and items count each by its id (item ids once); ties between
equal least hashes are one fingerprint; extra columns are ignored; an empty
table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, carried, keyed, shared_checkpoint

LENGTH, GRAM = 10, 5
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """Lower-cases A-Z only; words are runs of ASCII digits, letters and anything beyond ASCII."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _grams(words: Column, size: int) -> Column:
    """A hash for each run of `size` words, by its place."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _prints(grams: Column, width: int) -> Column:
    """The distinct least hashes over all windows of `width` neighbours."""
    if width == 1:
        return F.array_distinct(grams)
    count = F.size(grams) - (width - 1)
    least = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(*[F.get(grams, i + k) for k in range(width)]))
    return F.when(count > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _plan(length: int, gram: int) -> tuple[int, int]:
    """Words in a gram, and grams in a window of `length` words."""
    size = min(gram, length)
    return size, length - size + 1


def _marked(length: int, gram: int) -> Column:
    """A document's fingerprints for windows of `length` words, with that length; from its grams in g1, g2, …"""
    size, width = _plan(length, gram)
    return F.transform(_prints(F.col(f"g{size}"), width), lambda p: F.struct(F.lit(length).alias("len"), p.alias("print")))


def _windows(benchmark: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each distinct window: its words, their number, its fingerprint, and the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(length)))
    w = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("window"))
    w = w.groupBy("len", "window").agg(F.collect_set("item").alias("items"))
    least = F.coalesce(*[F.when(F.col("len") == n, F.array_min(_grams(F.col("window"), _plan(n, gram)[0]))) for n in range(1, length + 1)])
    return w.select("len", "window", "items", least.alias("print"))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, also: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, text, n_words, hits (places of window starts with their lengths, ordered), n_hit, items (sorted ids), and columns named in also."""
    return _judged(keyed(docs, *also), benchmark, length, gram, "left").select("doc_id", "text", *also, "n_words", "hits", "n_hit", "items")


def _judged(rows: DataFrame, benchmark: DataFrame, length: int, gram: int, how: str) -> DataFrame:
    """rows with n_words, hits, n_hit and items; with how = inner only those that have a fingerprint in common with an item."""
    windows = shared_checkpoint(_windows(benchmark, length, gram))
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most `length` of them
    prints = windows.groupBy("len", "print").agg(F.collect_list(F.struct(F.array_join("window", " ").alias("window"), "items")).alias("windows"))
    text = F.sum(F.octet_length(F.array_join("window", " ")) + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16))
    size = windows.agg(F.count("*").alias("rows"), F.coalesce(text, F.lit(0)).alias("bytes")).first()
    if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:  # fingerprints are no more than windows
        prints = F.broadcast(prints)

    split = rows.select(*KEY, words_of("text").alias("w"))
    own = split.select(*KEY, *[_grams(F.col("w"), size).alias(f"g{size}") for size in sorted({_plan(n, gram)[0] for n in lengths})])
    each = [_marked(n, gram) for n in lengths]
    if not lengths:
        none = F.array().cast("array<struct<at:int,len:int>>")
        empty = rows if how == "left" else rows.limit(0)
        return empty.select(*rows.columns, F.size(words_of("text")).cast("long").alias("n_words"), none.alias("hits"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    some = own.select(*KEY, F.explode(F.concat(*each)).alias("p")).select(*KEY, "p.len", "p.print")  # all lengths in one pass
    found = some.join(prints, ["len", "print"]).select(*KEY, F.struct("len", "print", "windows").alias("hit"))
    found = shared_checkpoint(found.groupBy(*KEY).agg(F.collect_set("hit").alias("found")))

    both = rows.join(found, KEY, how).select(*rows.columns, "found", words_of("text").alias("w"))
    at = F.array().cast("array<struct<at:int,len:int,items:array<string>>>")
    for n in sorted(lengths):
        at = F.concat(at, _extended(n, gram))
    both = both.withColumn("found", F.expr("filter(found, h -> h is not null)"))
    both = both.withColumn("windows", F.when(F.col("found").isNull(), F.array().cast("array<struct<at:int,len:int,items:array<string>>>")).otherwise(at))
    both = both.withColumn("hits", F.array_sort(F.transform("windows", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len")))))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(s["end"], x["at"]))).alias("n")),
        lambda s: s["n"].cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("windows", lambda x: x["items"]))))
    return both.select(*rows.columns, F.size("w").cast("long").alias("n_words"), "hits", covered.alias("n_hit"), items.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents without any hit word; columns as in docs.

    Verdicts are checkpointed before they are filtered: a filter on n_hit would
    move below the words' projection and split each text again for every place.
    """
    hits = shared_checkpoint(_judged(keyed(docs), benchmark, length, gram, "inner").select(*KEY, "n_hit"))
    return carried(docs).join(hits.where("n_hit > 0").select(*KEY).distinct(), KEY, "left_anti").select("_row.*")


def _extended(length: int, gram: int) -> Column:
    """Windows of `length` words around the places of the found fingerprints, with the items that have them."""
    size, width = _plan(length, gram)
    mine = F.filter("found", lambda h: h["len"] == length)
    known = F.map_from_entries(F.array_distinct(F.flatten(F.transform(mine, lambda h: F.transform(h["windows"], lambda x: F.struct(x["window"].alias("key"), x["items"].alias("value")))))))
    hashes = F.transform(mine, lambda h: h["print"])
    grams = _grams(F.col("w"), size)
    places = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(hashes, g), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.greatest(F.lit(0), F.least(i, F.size("w") - length))))))
    tried = F.transform(starts, lambda p: F.struct(p.alias("at"), F.lit(length).alias("len"), F.try_element_at(known, F.array_join(F.slice("w", p + 1, length), " ")).alias("items")))
    return F.when(F.size(mine) > 0, F.filter(tried, lambda x: x["items"].isNotNull())).otherwise(F.array().cast("array<struct<at:int,len:int,items:array<string>>>"))
