"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window
is the ordered set of its ``shingle``-word shingles. It occurs in a text only where all of
them do, so of each window one shingle is enough to find candidates, and the rarest in the
corpus yields the fewest.

* Documents are read once. A bit table of the items' shingles, of bounded size, tells which
  stretches of a text consist of such shingles; these *spans* are all that is kept of a text.
  Stretches shorter than the shortest window are left out (length bound).
* Equal spans are handled once, whatever number of documents share them.
* Shingles of spans are counted over the corpus. Each window takes its rarest as prefix,
  which is joined with the spans' shingles. The place of the shingle in the window fixes
  where the window would begin and end in the span (positional and length bounds), and the
  words there are compared (verification).

Result for odd input: a null or empty text has no words and no hits; an item without words
has no windows; an item without id marks words but is not listed; repeated documents and
items give repeated rows and one listed id; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import TEXT_WORD_PATTERN, TEXT_WORDS, ascii_lower, row_key, stored, utf8, words_of, free_name

SPANS = "array<struct<at:bigint,size:int,words:string>>"
#: The bit table has about 64 bits a shingle and no more than 2^27 bits (16 MB).
BITS_PER_SHINGLE, MOST_BITS = 64, 27


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TEXT_WORD_PATTERN), F.lit(0))


def item_windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words): each window of each item."""
    words = items.select(F.col(item_id).alias("item_id"), item_words(F.col(text)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return words.select(
        "item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, F.lit(window)))).alias("words")
    ).distinct()


def _shingles(words: Column, size: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - size)
    return F.transform(at, lambda i: F.struct(i.alias("off"), F.array_join(F.slice(words, i + 1, size), " ").alias("shingle")))


def _bit_table(shingles: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the hashes of all shingles: 4 KB a row, ``2 ** (bits - 15)`` rows at most."""
    bits = int(np.clip(np.ceil(np.log2(max(1, shingles.count()) * BITS_PER_SHINGLE)), 16, MOST_BITS))

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = np.asarray(part.column("size"))
            for low, high, words in words_of(part.column("shingle"), TEXT_WORDS):
                out = np.zeros(high - low, dtype=np.int64)
                for size in np.unique(sizes[low:high]):
                    at, h = words.grams(int(size))
                    whole = np.isin(at, words.bounds[:-1]) & (sizes[low:high][words.rows[at]] == size)
                    out[words.rows[at[whole]]] = (h[whole] >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["bit"])

    found = shingles.mapInArrow(hashes, "bit bigint")
    rows = (
        found.groupBy((F.col("bit") / 32768).cast("bigint").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))
        .collect()
    )
    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in rows:
        table[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return table, bits


def find_spans(docs: DataFrame, table: np.ndarray, bits: int, least_run: dict[int, int]) -> DataFrame:
    """(doc_id, row_key, n_words, spans): stretches of shingles that the bit table has.

    ``least_run``: by shingle size, of how many neighbouring shingles the shortest window
    of that size consists.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in parts:
            counts, spans = [], []
            for low, high, words in words_of(part.column("text"), TEXT_WORDS):
                counts.append(words.counts)
                found: list[list] = [[] for _ in range(high - low)]
                for size, least in least_run.items():
                    at, h = words.grams(size)
                    bit = h >> np.uint64(64 - bits)
                    hit = at[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    if not len(hit):
                        continue
                    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(words.rows[hit]) != 0)) + 1
                    for first, last in zip(hit[np.r_[0, cut]], hit[np.r_[cut - 1, len(hit) - 1]]):
                        if last - first + 1 >= least:
                            row = words.rows[first]
                            found[row].append((first - words.bounds[row], size, words.text(first, last + size)))
                spans += found
            n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), pa.array(n), pa.array([[dict(zip(("at", "size", "words"), s)) for s in x] for x in spans], type=pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32()), ("words", pa.string())])))],
                names=["doc_id", "row_key", "n_words", "spans"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(scan, f"doc_id {kind}, row_key string, n_words bigint, spans {SPANS}")


def _merged(intervals: Column) -> Column:
    """Sorted disjoint intervals covering the same words."""
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return F.aggregate(
        F.array_sort(intervals),
        none,
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["e"] >= x["s"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(done, F.array(x))),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    shingle: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, item_ids): what of each document lies in windows of items."""
    windows = stored(
        item_windows(items, window, item_id, item_text).select(
            "item_id", "words", F.least(F.lit(shingle), F.size("words")).alias("size"), F.array_join("words", " ").alias("window")
        ),
        "windows",
    )
    each = windows.select("window", "words", "size").distinct()
    parts = stored(each.select("window", "words", "size", F.inline(_shingles(F.col("words"), F.col("size")))), "window-shingles")
    sizes = each.groupBy("size").agg(F.min(F.size("words") - F.col("size") + 1).alias("least")).collect()  # at most `shingle` rows
    table, bits = _bit_table(parts.select("shingle", "size").distinct())

    texts = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).cast("string").alias("text")
    )
    facts = stored(
        find_spans(texts, table, bits, {r["size"]: r["least"] for r in sizes}).withColumn("row", F.monotonically_increasing_id()),
        "spans",
    )
    spans = facts.select("row", F.inline("spans")).withColumnRenamed("words", "span")

    # shingles of different spans, each with the words around it
    side = window - 1
    near = spans.groupBy("span", "size").agg(F.count("*").alias("copies")).withColumn("words", F.split("span", " "))
    low = lambda i: F.greatest(i - side, F.lit(0))
    places = F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("size")),
        lambda i: F.struct(
            i.alias("pos"),
            F.array_join(F.slice("words", i + 1, F.col("size")), " ").alias("shingle"),
            F.slice("words", low(i) + 1, F.lit(2 * side + shingle)).alias("around"),
        ),
    )
    places = stored(near.select("span", "size", "copies", F.size("words").alias("n"), F.inline(places)), "span-shingles")

    counts = places.groupBy("shingle", "size").agg(F.sum("copies").alias("frequency"))
    ranked = parts.join(counts, ["shingle", "size"], "left").groupBy("window", "words", "size").agg(
        F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "off", "shingle")).alias("prefix")
    )
    prefixes = ranked.where(F.col("prefix.frequency") > 0).select("window", "words", "size", "prefix.off", "prefix.shingle")
    begin = F.col("pos") - F.col("off")
    hits = stored(
        places.join(prefixes, ["shingle", "size"])
        .where((begin >= 0) & (begin + F.size("words") <= F.col("n")))
        .where(F.slice("around", begin - low(F.col("pos")) + 1, F.size("words")) == F.col("words"))
        .select("span", "size", "window", begin.cast("bigint").alias("s"), (begin + F.size("words")).cast("bigint").alias("e")),
        "hits",
    )
    covered = hits.groupBy("span", "size").agg(F.collect_set(F.struct("s", "e")).alias("intervals"))
    listed = hits.select("span", "size", "window").distinct().join(windows.select("window", "item_id"), "window")
    listed = listed.groupBy("span", "size").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    found = stored(covered.select("span", "size", _merged(F.col("intervals")).alias("intervals")).join(listed, ["span", "size"]), "found")

    by_row = (
        spans.join(found, ["span", "size"])
        .select("row", "items", F.transform("intervals", lambda x: F.struct((x["s"] + F.col("at")).alias("s"), (x["e"] + F.col("at")).alias("e"))).alias("intervals"))
        .groupBy("row")
        .agg(F.flatten(F.collect_list("intervals")).alias("intervals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    )
    # where an interval begins behind all earlier ones, all of it counts, else what exceeds them
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    width = F.aggregate(
        F.array_sort("intervals"),
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0).cast("bigint"))).alias("n"),
            F.greatest(a["end"], x["e"]).alias("end"),
        ),
    )["n"]
    by_row = by_row.select("row", width.alias("n_hit"), "item_ids")
    return facts.join(by_row, "row", "left").select(
        "doc_id",
        "row_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """At least one word in ``one_in`` lies in a window."""
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, with their columns."""
    judged = contamination(docs, items)
    bad = stored(judged.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("row_key").distinct(), "contaminated")
    key = free_name(docs, "__row_key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(bad, keyed[key] == bad["row_key"], "left_anti").drop(key)
