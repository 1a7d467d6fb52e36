"""Rendering types to short texts and packing them into size-bounded batches.

Greedy packing depends on order: where a batch ends decides where the next begins.
A directory may hold a third of all rows, so its rows are never walked by one task:

1. rows are grouped into chunks of neighbouring order values (bounded size);
2. each chunk tells, for each of the few places where a batch can begin at its start,
   in which state it ends (a batch has at most ``size`` members, so the first begin
   lies within the first ``size`` rows);
3. these short summaries, one row per chunk, are chained per group with constant state;
4. with its entry state each chunk assigns its own rows.

The result is exactly that of the sequential walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import directory_of, token_estimate

# Default limits.
TOKEN_CEILING = 4000
BATCH_SIZE = 6


# --- rendering ---------------------------------------------------------------


def _annotation_text(annotations: Column) -> Column:
    return F.array_join(
        F.transform(
            annotations,
            lambda a: F.concat(
                F.lit("@"), a["name"], F.lit("("), F.array_join(a["arguments"], ", "), F.lit(") ")
            ),
        ),
        "",
    )


def _doc_text(javadoc: Column, before: str, after: str) -> Column:
    return F.when(
        F.coalesce(javadoc, F.lit("")) != "",
        F.concat(F.lit(before + "/** "), javadoc, F.lit(" */" + after)),
    ).otherwise("")


def method_text(methods: DataFrame) -> DataFrame:
    """Adds ``piece``: doc line, annotations, signature and metric note of a method."""
    flag = F.when(F.col("high_complexity"), " [HIGH COMPLEXITY]").otherwise("")
    note = F.when(
        F.col("loc").isNotNull(),
        F.concat(F.lit("  // loc="), "loc", F.lit(", cyclomatic~="), "cyclomatic", flag),
    ).otherwise("")
    return methods.withColumn(
        "piece",
        F.concat(
            _doc_text(F.col("javadoc"), "\n    ", ""),
            F.lit("\n    "),
            _annotation_text(F.col("annotations")),
            "signature",
            F.lit(";"),
            note,
        ),
    )


def type_head(types: DataFrame) -> DataFrame:
    """Adds ``head``: the text of a type before its methods."""
    return types.withColumn(
        "head",
        F.concat(
            _doc_text(F.col("javadoc"), "", "\n"),
            _annotation_text(F.col("annotations")),
            F.lit("class "),
            "class_name",
            F.lit(" (package: "),
            "package",
            F.lit(", type: "),
            "class_type",
            F.lit(", file: "),
            "file_path",
            F.lit(") {"),
        ),
    )


TAIL = "\n}"


def render_types(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(repo, type_ord, file_path, class_name, head, pieces, text) of each type.

    A type's methods come from one file, so its list is bounded by that file's text.
    """
    pieces = (
        method_text(methods)
        .groupBy("repo", "type_ord")
        .agg(F.array_sort(F.collect_list(F.struct("method_ord", "piece"))).alias("_pieces"))
    )
    return (
        type_head(types)
        .join(pieces, ["repo", "type_ord"], "left")
        .withColumn("pieces", F.coalesce(F.col("_pieces.piece"), F.array().cast("array<string>")))
        .select(
            "repo",
            "type_ord",
            "file_path",
            "class_name",
            "head",
            "pieces",
            F.concat("head", F.array_join("pieces", ""), F.lit(TAIL)).alias("text"),
        )
    )


# --- greedy packing ----------------------------------------------------------


def _links(costs: np.ndarray, ceiling: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row as a batch's first: the first row after that batch."""
    n = len(costs)
    sums = np.concatenate(([0], np.cumsum(costs)))
    alone = costs > ceiling
    rows = np.arange(n)
    by_cost = np.searchsorted(sums, sums[:-1] + ceiling, side="right") - 1
    stops = np.minimum.accumulate(np.where(alone, rows, n)[::-1])[::-1] if n else rows
    after = np.minimum(np.minimum(by_cost, rows + size), np.minimum(stops, n))
    return np.where(alone, rows + 1, after), sums, alone


def _summarise(ceiling: int, size: int) -> Callable:
    @F.pandas_udf(
        "rows bigint, head array<bigint>, exit_ord array<bigint>, exit_len array<bigint>, "
        "exit_sum array<bigint>, units array<bigint>"
    )
    def summarise(ords: pd.Series, costs: pd.Series) -> pd.DataFrame:
        out = []
        for row_ords, row_costs in zip(ords, costs, strict=True):
            cost = np.asarray(row_costs, dtype=np.int64)
            after, sums, alone = _links(cost, ceiling, size)
            n = len(cost)
            # last begin before the end, and number of batches, by doubling the links
            last = np.where(after == n, np.arange(n), after)
            while not np.array_equal(last, last[last]):
                last = last[last]
            jump = np.append(after, n)
            units = np.append(np.ones(n, dtype=np.int64), 0)
            while (jump[:n] < n).any():
                units = units + units[jump]
                jump = jump[jump]
            entry = np.arange(min(size, n))
            begin = last[entry]
            is_open = ~alone[begin]
            out.append(
                (
                    n,
                    cost[: min(size, n)],
                    np.asarray(row_ords, dtype=np.int64)[begin],
                    np.where(is_open, n - begin, 0),
                    np.where(is_open, sums[n] - sums[begin], 0),
                    units[entry],
                )
            )
        return pd.DataFrame(
            out, columns=["rows", "head", "exit_ord", "exit_len", "exit_sum", "units"]
        )

    return summarise


def _chain(keys: list[str], ceiling: int, size: int) -> Callable:
    """Entry state of every chunk; chunks arrive sorted inside each group."""

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: tuple | None = None
        length = total = begun = open_ord = open_no = 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = tuple(getattr(row, name) for name in keys)
                if key != group:
                    group, length, total, begun, open_ord, open_no = key, 0, 0, 0, 0, 0
                taken, limit = 0, len(row.head)
                while (
                    length > 0
                    and taken < limit
                    and length + taken < size
                    and total + row.head[taken] <= ceiling
                ):
                    total += int(row.head[taken])
                    taken += 1
                out.append((*key, row.chunk, taken, open_ord, open_no, begun))
                if taken == row.rows:
                    length += taken
                    continue
                begun += int(row.units[taken])
                open_ord, open_no = int(row.exit_ord[taken]), begun - 1
                length, total = int(row.exit_len[taken]), int(row.exit_sum[taken])
            yield pd.DataFrame(out, columns=[*keys, "chunk", "taken", "open_ord", "open_no", "begun"])

    return chain


def _assign(ceiling: int, size: int) -> Callable:
    @F.pandas_udf("batch_ord array<bigint>, batch_no array<bigint>")
    def assign(
        ords: pd.Series, costs: pd.Series, taken: pd.Series, open_ord: pd.Series, open_no: pd.Series, begun: pd.Series
    ) -> pd.DataFrame:
        out = []
        for o, c, t, oo, on, b in zip(ords, costs, taken, open_ord, open_no, begun, strict=True):
            order = np.asarray(o, dtype=np.int64)
            n = len(order)
            after = _links(np.asarray(c, dtype=np.int64), ceiling, size)[0].tolist()
            begins, at = [], int(t)
            while at < n:
                begins.append(at)
                at = after[at]
            spans = np.diff(np.append(begins, n)).astype(np.int64) if begins else np.zeros(0, np.int64)
            starts = np.asarray(begins, dtype=np.int64)
            out.append(
                (
                    np.concatenate((np.full(int(t), oo), np.repeat(order[starts], spans))).astype(np.int64),
                    np.concatenate((np.full(int(t), on), np.repeat(b + np.arange(len(starts)), spans))).astype(np.int64),
                )
            )
        return pd.DataFrame(out, columns=["batch_ord", "batch_no"])

    return assign


def greedy_batches(
    items: DataFrame,
    keys: list[str],
    ceiling: int = TOKEN_CEILING,
    size: int = BATCH_SIZE,
    chunk: Column | None = None,
) -> DataFrame:
    """items(keys…, ord, cost) to (keys…, ord, cost, batch_ord, batch_no, oversized).

    A batch closes when the next row would lift its cost above ``ceiling`` or when it has
    ``size`` rows. A row above the ceiling closes the batch and stands alone
    (``oversized``). ``batch_ord`` is the order value of the batch's first row,
    ``batch_no`` counts within the group. ``ord`` is unique within the keys, and ``chunk``
    must be a non-decreasing function of it that holds a bounded number of rows
    (default: 50,000 order values).
    """
    by = F.floor(F.col("ord") / 50_000) if chunk is None else chunk
    packed = (
        items.select(*keys, "ord", F.col("cost").cast("bigint").alias("cost"), by.alias("chunk"))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "cost"))).alias("rows"))
        .select(*keys, "chunk", F.col("rows.ord").alias("ords"), F.col("rows.cost").alias("costs"))
    )
    summary = packed.select(
        *keys, "chunk", _summarise(ceiling, size)(F.col("ords"), F.col("costs")).alias("s")
    ).select(*keys, "chunk", "s.*")
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys, "chunk").schema)
    entries = (
        summary.repartition(*keys)
        .sortWithinPartitions(*keys, "chunk")
        .mapInPandas(
            _chain(keys, ceiling, size),
            f"{key_types}, taken bigint, open_ord bigint, open_no bigint, begun bigint",
        )
    )
    placed = packed.join(entries, [*keys, "chunk"]).select(
        *keys,
        "ords",
        "costs",
        _assign(ceiling, size)(
            *[F.col(c) for c in ("ords", "costs", "taken", "open_ord", "open_no", "begun")]
        ).alias("a"),
    )
    return placed.select(
        *keys,
        F.inline(
            F.arrays_zip(
                F.col("ords").alias("ord"),
                F.col("costs").alias("cost"),
                F.col("a.batch_ord").alias("batch_ord"),
                F.col("a.batch_no").alias("batch_no"),
            )
        ),
    ).withColumn("oversized", F.col("cost") > ceiling)


# --- oversized records -------------------------------------------------------


def oversized_parts(
    lengths: Column,
    frame_length: Column,
    ceiling: int = TOKEN_CEILING,
    estimate: Callable[[Column], Column] = token_estimate,
) -> Column:
    """Part number of each piece: array<int> for ``lengths`` (array<bigint>).

    A part closes when head + its pieces + the next piece + tail would be estimated above
    the ceiling; a piece that is too long by itself still goes alone.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("len"),
        F.lit(0).alias("part"),
        F.expr("cast(array() as array<int>)").alias("parts"),
    )

    def step(state: Column, piece: Column) -> Column:
        closes = (F.size(state["parts"]) > 0) & (
            estimate(frame_length + state["len"] + piece) > ceiling
        )
        part = state["part"] + closes.cast("int")
        return F.struct(
            F.when(closes, piece).otherwise(state["len"] + piece).alias("len"),
            part.alias("part"),
            F.array_append(state["parts"], part).alias("parts"),
        )

    return F.aggregate(lengths, start, step, lambda s: s["parts"])


def split_oversized(
    rendered: DataFrame,
    ceiling: int = TOKEN_CEILING,
    estimate: Callable[[Column], Column] = token_estimate,
) -> DataFrame:
    """Records whose text is over the ceiling, as parts of whole pieces.

    rendered(…, head, pieces, text) to (…, part, first_piece, n_pieces, part_text). All
    pieces are kept; a record without pieces gives no part.
    """
    keep = [c for c in rendered.columns if c not in ("head", "pieces", "text")]
    lengths = F.transform("pieces", lambda p: F.length(p).cast("bigint"))
    frame = (F.length("head") + len(TAIL)).cast("bigint")
    numbered = rendered.filter(estimate(F.length("text")) > ceiling).select(
        *keep, "head", "pieces", oversized_parts(lengths, frame, ceiling, estimate).alias("parts")
    )
    last = F.try_element_at("parts", F.lit(-1))
    per_part = F.when(
        F.size("parts") > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(
                k.alias("part"),
                (F.array_position("parts", k) - 1).cast("bigint").alias("first_piece"),
                F.size(F.filter("parts", lambda p: p == k)).cast("bigint").alias("n_pieces"),
            ),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<part:int,first_piece:bigint,n_pieces:bigint>>)"))
    return (
        numbered.select(*keep, "head", "pieces", F.inline(per_part))
        .withColumn(
            "part_text",
            F.concat(
                "head",
                F.array_join(
                    F.slice("pieces", (F.col("first_piece") + 1).cast("int"), F.col("n_pieces").cast("int")), ""
                ),
                F.lit(TAIL),
            ),
        )
        .drop("head", "pieces")
    )


def build_batches(
    rendered: DataFrame,
    ceiling: int = TOKEN_CEILING,
    size: int = BATCH_SIZE,
    estimate: Callable[[Column], Column] = token_estimate,
    ord_bits: int = 28,
    chunk_files: int = 4096,
) -> DataFrame:
    """Batch members: (repo, dir, batch_ord, part, type_ord, file_path, class_name, member_text).

    Types are packed per directory. A type over the ceiling forms batches of its own, one
    per part of its methods.
    """
    sized = rendered.withColumn("dir", directory_of(F.col("file_path"))).withColumn(
        "cost", estimate(F.length("text")).cast("bigint")
    )
    batches = greedy_batches(
        sized.select("repo", "dir", F.col("type_ord").alias("ord"), "cost"),
        ["repo", "dir"],
        ceiling,
        size,
        F.floor(F.shiftright(F.col("ord"), ord_bits) / chunk_files),
    ).filter(~F.col("oversized"))
    whole = (
        sized.join(
            batches.select("repo", "dir", F.col("ord").alias("type_ord"), "batch_ord"),
            ["repo", "dir", "type_ord"],
        )
        .select(
            "repo", "dir", "batch_ord", F.lit(0).alias("part"), "type_ord", "file_path", "class_name",
            F.col("text").alias("member_text"),
        )
    )
    split = split_oversized(sized.drop("cost"), ceiling, estimate).select(
        "repo", "dir", F.col("type_ord").alias("batch_ord"), "part", "type_ord", "file_path", "class_name",
        F.col("part_text").alias("member_text"),
    )
    return whole.unionByName(split)


def batch_prompts(members: DataFrame) -> DataFrame:
    """Members of a batch (at most ``size``) joined by a blank line, in order."""
    keys = ["repo", "dir", "batch_ord", "part"]
    return members.groupBy(*keys).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("type_ord", "member_text"))).getField("member_text"),
            "\n\n",
        ).alias("prompt"),
        F.count("*").alias("members"),
    )
