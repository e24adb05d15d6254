"""Conversations without the quotes that repeat them, in reply order, by linking quotations to their originals.

Each message's lines are parsed into quote levels (leading ">" marks).  Blocks of quoted
lines are normalised and hashed, whole, by paragraph and by line, and joined on
conversation and hash to the first message that has the passage as its own words; a
passage inside a larger one that is found does not count.  A message replies to the
latest original of its first-level quotes.  Threads come from
following replies, doubling the distance each round.  What was found is taken out of the
message; quoted lines from elsewhere stay, with their marks.

Originals are reduced to one row per conversation and passage before the join, so a
passage or a conversation of any size adds rows in proportion to its messages only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: A line that only says who is quoted.
_SAYS = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|.{0,100}\bwrites|am\b.{0,200}\bschrieb.*|le\b.{0,200}\ba écrit\s*|el\b.{0,200}\bescribió)\s*:\s*$", re.I)


def split_levels(text: str | None) -> list[tuple[int, str]]:
    """Each line with its quote level, 0 for the message's own."""
    out = []
    for line in (text or "").splitlines():
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normalised(passage: str) -> str:
    return " ".join(passage.casefold().split())


def _hash(passage: str) -> bytes | None:
    from xxhash import xxh3_128_digest

    words = normalised(passage)
    return xxh3_128_digest(words.encode("utf-8", "surrogatepass")) if words else None


def _passages(lines: list[str]) -> list[tuple[int, int, bytes]]:
    """(rank, paragraph, hash) of the whole (0, paragraph -1), its paragraphs (1) and their lines (2), without those equal to what they are in."""
    paragraphs, now = [], []
    for line in lines:
        if line.strip():
            now.append(line)
        elif now:
            paragraphs.append(now)
            now = []
    paragraphs += [now] if now else []
    whole = _hash("\n".join(lines))
    out = [(0, -1, whole)] if whole else []
    for p, some in enumerate(paragraphs):
        known = {whole}
        for rank, x in [(1, "\n".join(some)), *((2, line) for line in some)]:
            if (h := _hash(x)) and h not in known:
                known.add(h)
                out.append((rank, p, h))
    return out


def _blocks(levels: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(level, first line, line after the last) of each run of lines of one level over 0."""
    out, i = [], 0
    while i < len(levels):
        j = i
        while j < len(levels) and levels[j][0] == levels[i][0]:
            j += 1
        if levels[i][0]:
            out.append((levels[i][0], i, j))
        i = j
    return out


def _says(levels: list[tuple[int, str]], i: int) -> bool:
    """Whether line i only says who is quoted below it."""
    return levels[i][0] == 0 and i + 1 < len(levels) and levels[i + 1][0] > 0 and bool(_SAYS.match(levels[i][1]))


def parse(text: str | None) -> tuple[list[bytes], list[tuple[int, int, int, int, bytes]]]:
    """Hashes of a message's own passages; (block, level, rank, paragraph, hash) of its quotes."""
    levels = split_levels(text)
    own = [line for i, (level, line) in enumerate(levels) if level == 0 and not _says(levels, i)]
    quotes = [(block, level, *x) for block, (level, i, j) in enumerate(_blocks(levels)) for x in _passages([line for _, line in levels[i:j]])]
    return list({h: None for *_, h in _passages(own)}), quotes


def without(text: str | None, found: list) -> str:
    """The text without the found passages: (block, rank, paragraph, hash), and without lines that only say who they are of."""
    if not found:
        return text or ""
    lines, levels = (text or "").splitlines(), split_levels(text)
    gone: set[int] = set()
    for block, (_, i, j) in enumerate(_blocks(levels)):
        own = [f for f in found if f[0] == block]
        paragraph, before = -1, True
        whole, parts, single = any(f[1] == 0 for f in own), {f[2] for f in own if f[1] == 1}, {(f[2], bytes(f[3])) for f in own if f[1] == 2}
        for k in range(i, j):
            blank = not levels[k][1].strip()
            paragraph += before and not blank
            before = blank
            if whole or not blank and (paragraph in parts or (paragraph, _hash(levels[k][1])) in single):
                gone.add(k)
        # blank quoted lines say nothing where all others went
        if all(k in gone or not levels[k][1].strip() for k in range(i, j)):
            gone.update(range(i, j))
            if i and _says(levels, i - 1):
                gone.add(i - 1)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line for k, line in enumerate(lines) if k not in gone)).strip()


def link(messages: DataFrame, *, conversation="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, turn, role, parent_turn, thread_root, depth, n_quotes, n_linked, position, text (without the quotes that were found).

    One row per row of messages.  parent_turn is null where nothing is linked; such a
    message is the root of its thread.  n_quotes counts blocks of quoted lines, n_linked the
    passages in them that were found (the largest only).  position numbers a conversation's
    rows from 1 in reply order: thread_root, depth, turn.  Null texts are empty; messages with a null
    conversation or turn are not linked; repeated rows stay, and the first turn that holds
    a passage counts as its original.  Columns other than the four named are not read.
    """
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (conversation, turn, role)}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(t) for t in pdf["text"]]
            out = pdf.copy()
            out["own"] = [r[0] for r in rows]
            out["quotes"] = [[{"block": b, "level": lv, "rank": k, "paragraph": p, "hash": h} for b, lv, k, p, h in r[1]] for r in rows]
            yield out

    def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [without(t, [] if f is None else [tuple(x.values()) for x in f]) for t, f in zip(pdf["text"], pdf["found"], strict=True)]
            yield pdf.drop(columns="found")

    rows = messages.select(
        F.monotonically_increasing_id().alias("rid"), F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    parsed = common.stored(
        rows.mapInPandas(
            read,
            f"rid long, conv_id {kinds[conversation]}, turn long, role {kinds[role]}, text string, own array<binary>, quotes array<struct<block:int,level:int,rank:int,paragraph:int,hash:binary>>",
        ),
        "messages",
    )
    quotes = parsed.where("size(quotes) > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = quotes.select("rid", "conv_id", "turn", F.explode("quotes").alias("q")).select("rid", "conv_id", "turn", "q.*")
    own = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("own").alias("hash"))
    first = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    hits = quotes.join(first, ["conv_id", "hash"]).where("original < turn")
    # what lies in a larger passage that was found is part of it
    inside = F.min("rank").over(Window.partitionBy("rid", "block", "paragraph"))
    hits = hits.withColumns({"whole": F.min("rank").over(Window.partitionBy("rid", "block")), "inside": inside})
    hits = hits.where("rank = CASE WHEN whole = 0 THEN 0 ELSE inside END")
    per = hits.groupBy("rid").agg(F.max(F.when(F.col("level") == 1, F.col("original"))).alias("parent_turn"), F.count("*").alias("n_linked"), F.collect_list(F.struct("block", "rank", "paragraph", "hash")).alias("found"))
    n_quotes = F.when(F.size("quotes") > 0, F.array_max(F.transform("quotes", lambda q: q["block"])) + 1).otherwise(0).cast("long")
    # at most what a message quotes itself
    rows = parsed.select("rid", "conv_id", "turn", "role", "text", n_quotes.alias("n_quotes")).join(per, "rid", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    kept = f"rid long, conv_id {kinds[conversation]}, turn long, role {kinds[role]}, text string, n_quotes long, parent_turn long, n_linked long"
    rows = common.stored(rows.select(*[c.split()[0] for c in kept.split(", ")], "found").mapInPandas(clear, kept), "linked")
    placed = _placed(rows.select("rid", "conv_id", "turn", "parent_turn").join(_threads(rows), ["conv_id", "turn", "parent_turn"], "left"))
    return rows.join(placed, "rid").select("conv_id", "turn", "role", "parent_turn", "thread_root", "depth", "n_quotes", "n_linked", "position", "text")


def _placed(rows: DataFrame) -> DataFrame:
    """rid, thread_root, depth, position: rows numbered within their conversation, of which each partition of a range holds a piece."""
    rows = rows.select("rid", "conv_id", "turn", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"))
    rows = rows.repartitionByRange(common.partitions(rows.sparkSession), "conv_id", "thread_root", "depth", "turn", "rid")
    rows = common.stored(rows.withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("thread_root", "depth", "turn", "rid")))
    rows = rows.join(base, rows["conv_id"].eqNullSafe(base["c"]) & (rows["part"] == base["p"]))
    return rows.select("rid", "thread_root", "depth", (F.col("base") + F.col("place")).alias("position"))


def _threads(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, thread_root, depth of every message that replies."""
    replies = rows.where("parent_turn IS NOT NULL").select("conv_id", "turn", "parent_turn").distinct()
    # a turn given twice may reply to two messages; others follow the earlier
    steps = common.stored(replies.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"), F.lit(1).alias("depth")), "steps")
    while True:
        far = steps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        nxt = steps.join(far, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("higher", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")
        )
        nxt = common.stored(nxt, "steps")
        steps = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    up = steps.select("conv_id", F.col("turn").alias("parent_turn"), F.col("up").alias("root"), F.col("depth").alias("above"))
    return replies.join(up, ["conv_id", "parent_turn"], "left").select(
        "conv_id", "turn", "parent_turn", F.coalesce("root", "parent_turn").alias("thread_root"), (F.coalesce("above", F.lit(0)) + 1).alias("depth")
    )


def ordered(linked: DataFrame) -> DataFrame:
    """link()'s rows in reply order: threads by their first turn, answers after what they answer."""
    return linked.orderBy("conv_id", "position")
