"""Chat formatting by quotation linking.

Messages may quote earlier ones with leading '>' marks, nested or not. Passages
are runs of lines of one level; their normalised texts are hashed, and quoted
passages are joined to the messages that wrote them, as a run of lines or as one
of its lines. Conversations come out
without quotes, in reply order: linked messages form one conversation, in which
a message comes after the one it replies to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .session import checkpointed, salted_join, table
from .words import text_slices

QUOTE = regex.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines of one quote level; blank lines part runs of a level. Marks are left out."""
    out: list[tuple[int, list[str]]] = []
    blank = True
    for line in text.split("\n"):
        found = QUOTE.match(line)
        level, rest = (found[1].count(">"), line[found.end() :]) if found else (0, line)
        if not rest.strip():
            blank = True
            continue
        if blank or not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(rest.rstrip())
        blank = False
    return [(level, "\n".join(lines)) for level, lines in out]


def normalised_passage(text: str) -> str:
    """Letters and digits in lower case, one space between runs: wrapping, spacing and punctuation don't count."""
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", text.lower()))


def written(text: str) -> list[str]:
    """What a passage of one's own lets others quote: the whole of it and each of its lines."""
    lines = text.split("\n")
    return [text, *(lines if len(lines) > 1 else [])]


def _digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(n.encode()) if (n := normalised_passage(text)) else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            levels, hashes, wrote, clean = [], [], [], []
            for text in pc.fill_null(part.column("text"), "").to_pylist():
                found = passages(text)
                quotes = [(x, t) for x, t in found if x]
                levels.append([x for x, _ in quotes])
                hashes.append([_digest(t) for _, t in quotes])
                wrote.append(sorted({_digest(w) for x, t in found if not x for w in written(t)} - {""}))
                clean.append("\n\n".join(t for x, t in found if x == 0) if quotes else text)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), part.column("role"), pa.array(levels, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.string())), pa.array(wrote, pa.list_(pa.string())), pa.array(clean)],
                                             ["conv_id", "turn", "role", "levels", "hashes", "wrote", "clean_text"])


#: Bits of a turn that number it inside a run of turns.
RUN = 10


def previous_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, distinct) with ``before``, the turn before it in the conversation; the first one's is null.

    A conversation may be of any length: turns are looked up inside runs of 1,024 numbers, and then across the runs.
    """
    rows = turns.withColumn("run", F.shiftright("turn", RUN))
    runs = rows.groupBy("conv_id", "run").agg(F.max("turn").alias("last"))
    runs = runs.select("conv_id", "run", F.lag("last").over(Window.partitionBy("conv_id").orderBy("run")).alias("earlier"))
    inside = rows.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "run").orderBy("turn")))
    return inside.join(runs, ["conv_id", "run"]).select("conv_id", "turn", F.coalesce("near", "earlier").alias("before"))


def linked_messages(messages: DataFrame) -> DataFrame:
    """One row per message, without its quotes, with the message it replies to and its place in the conversation of replies.

    conv_id, turn, role, clean_text, n_quotes (quoted passages), n_linked (those whose message was found), max_level,
    parent_conv_id, parent_turn, linked (the parent is the source of a quote), thread_conv_id, thread_turn (the message
    that opens the conversation), position in it from 0. A quoted passage belongs to the earliest
    message of its own conversation that wrote it (as unquoted text, a whole run of lines or one of them) before the
    quoting turn, else to the first message by (conv_id, turn) of another conversation; part of a line is not looked for,
    and a passage without a letter or digit belongs to none. A message replies to the source of its last outermost quote
    that has one; without one, to the turn before it, however far, and the first turn to none. Messages that reply to each other, over any number of
    steps, are one conversation, whatever their conv_id; in it they are ordered by the number of replies down from its
    opening, then by (conv_id, turn). Quotes across conversations may run in a circle; its first message by (conv_id,
    turn) then opens the conversation, though it has a parent. Null texts count as empty; rows with a null conv_id or turn
    are passed through without links and place; messages that repeat are kept, and replies to them count as replies to
    one of them. Other columns are ignored; an empty table gives an empty result.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = checkpointed(rows.mapInArrow(_parse, "conv_id long, turn long, role string, levels array<int>, hashes array<string>, wrote array<string>, clean_text string").withColumn("uid", F.monotonically_increasing_id()))
    known = parsed.where("conv_id is not null and turn is not null")
    quoted = known.select("uid", "conv_id", "turn", F.posexplode(F.arrays_zip("levels", "hashes")).alias("pos", "p")).select("uid", "conv_id", "turn", "pos", F.col("p.levels").alias("level"), F.col("p.hashes").alias("hash")).where("hash <> ''")
    here = known.select("conv_id", "turn", F.explode("wrote").alias("hash")).groupBy("hash", "conv_id").agg(F.min("turn").alias("own_turn"))
    here = here.join(quoted.select("hash").distinct(), "hash", "left_semi")
    # Of the two smallest conversations that wrote a passage, one is another than the quoting one, if any is.
    first = F.min(F.struct("conv_id", "own_turn"))
    least = here.groupBy("hash").agg(first.alias("first"))
    second = here.join(least, "hash").where("conv_id <> first.conv_id").groupBy("hash").agg(first.alias("second"))
    anywhere = least.join(second, "hash", "left")
    quoted = checkpointed(quoted.join(here, ["hash", "conv_id"], "left"))
    found = salted_join(quoted, anywhere, "hash", quoted.count(), "left")
    source = lambda c: F.struct(c["conv_id"].alias("c"), c["own_turn"].alias("t"))
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), source(F.col("first"))).when(F.col("second").isNotNull(), source(F.col("second")))
    found = found.select("uid", "pos", "level", F.when(F.col("own_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("own_turn").alias("t"))).otherwise(other).alias("source"))
    per = found.groupBy("uid").agg(F.count("source").alias("n_linked"), F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("a"), F.col("pos").alias("b"), F.col("source").alias("s")))).alias("best"))
    before = previous_turns(known.select("conv_id", "turn").distinct())
    joined = parsed.join(per, "uid", "left").join(before, ["conv_id", "turn"], "left")
    source = F.col("best.s")
    linked = joined.select(
        "uid", "conv_id", "turn", "role", "clean_text", F.size("levels").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"),
        F.when(source.isNotNull(), source["c"]).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv_id"), F.coalesce(source["t"], F.col("before")).alias("parent_turn"), source.isNotNull().alias("linked"),
    )
    return _ordered(checkpointed(linked)).drop("uid")


def _jumped(state: DataFrame) -> tuple[DataFrame, int]:
    """Pointer doubling until no more rows reach an opening; and how many rows don't, as they lead to a circle."""
    left, before = state.where("not done").count(), -1
    while left and left != before:
        s = state.select(F.col("uid").alias("anc"), F.col("anc").alias("anc_"), F.col("depth").alias("depth_"), F.col("done").alias("done_"), F.col("root_conv").alias("conv_"), F.col("root_turn").alias("turn_"))
        moved = state.where("not done").join(s, "anc").select("uid", F.col("anc_").alias("anc"), (F.col("depth") + F.col("depth_")).alias("depth"), F.col("done_").alias("done"), F.col("conv_").alias("root_conv"), F.col("turn_").alias("root_turn"))
        state = checkpointed(state.where("done").unionByName(moved))
        left, before = state.where("not done").count(), left
    return state, left


def _circle_openings(steps: DataFrame, rows: int) -> DataFrame:
    """The first message (uid) by (conv_id, turn) of each circle that ``steps`` (uid, anc, key) of ``rows`` rows lead to."""
    walk, length = steps.select("uid", F.col("anc").alias("to"), F.col("key").alias("low")), 1
    while length < rows:
        s = walk.select(F.col("uid").alias("to"), F.col("to").alias("to_"), F.col("low").alias("low_"))
        walk = checkpointed(walk.join(s, "to").select("uid", F.col("to_").alias("to"), F.least("low", "low_").alias("low")))
        length *= 2
    circle = walk.select(F.col("to").alias("uid")).distinct()
    return walk.join(circle, "uid").join(steps.select("uid", "key"), "uid").where(F.col("low") == F.col("key")).select("uid")


def _ordered(linked: DataFrame) -> DataFrame:
    """``linked`` with thread_conv_id, thread_turn and position."""
    placed = linked.where("conv_id is not null and turn is not null")
    # Of messages with one key, the first by content stands for it.
    one = placed.groupBy(F.col("conv_id").alias("parent_conv_id"), F.col("turn").alias("parent_turn")).agg(F.min(F.struct(F.xxhash64("role", "clean_text").alias("h"), "uid"))["uid"].alias("up"))
    # Many messages may reply to one.
    up = lambda rows: rows.withColumn("up_key", F.struct("parent_conv_id", "parent_turn")).drop("parent_conv_id", "parent_turn")
    own = placed.select("uid", "conv_id", "turn", "parent_conv_id", "parent_turn")
    replies = own.where("parent_turn is not null")
    first = salted_join(up(replies), up(one), "up_key", replies.count(), "left").drop("up_key").unionByName(own.where("parent_turn is null").select("uid", "conv_id", "turn", F.lit(None).cast("long").alias("up")))
    opens = F.col("up").isNull()
    first = checkpointed(first.select("uid", F.coalesce("up", "uid").alias("anc"), F.when(opens, 0).otherwise(1).cast("long").alias("depth"), opens.alias("done"), F.when(opens, F.col("conv_id")).alias("root_conv"), F.when(opens, F.col("turn")).alias("root_turn"), F.struct("conv_id", "turn").alias("key")))
    state, left = _jumped(first.drop("key"))
    if left:
        round_ = first.join(state.where("not done").select("uid"), "uid", "left_semi")
        cut = F.col("cut").isNotNull()
        again = round_.join(_circle_openings(round_, left).withColumn("cut", F.lit(True)), "uid", "left")
        again = again.select("uid", F.when(cut, F.col("uid")).otherwise(F.col("anc")).alias("anc"), F.when(cut, 0).otherwise(1).cast("long").alias("depth"), cut.alias("done"), F.when(cut, F.col("key.conv_id")).alias("root_conv"), F.when(cut, F.col("key.turn")).alias("root_turn"))
        state, left = _jumped(checkpointed(state.where("done").unionByName(again)))
        if left:
            raise RuntimeError(f"{left} messages without a conversation")
    thread = ["thread_conv_id", "thread_turn"]
    rows = checkpointed(placed.join(state.select("uid", "depth", F.col("root_conv").alias(thread[0]), F.col("root_turn").alias(thread[1])), "uid"))
    # Conversations may be of any size: ranges of the order are numbered, then the rows of earlier ranges are added.
    order = [*thread, "depth", "conv_id", "turn", F.xxhash64("role", "clean_text"), "uid"]
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    runs = dealt.groupBy("range", *thread).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*thread).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("range", *thread, "start", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    found = dealt.join(runs, ["range", *thread]).select(*linked.columns, *thread, (F.col("at") - F.col("start") + F.col("earlier")).alias("position"))
    return found.unionByName(linked.where("conv_id is null or turn is null"), allowMissingColumns=True)


def op3_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """linked_messages() over all conversations, with the text as a digest."""
    rows = linked_messages(table(spark, sf_dir, "conversations"))
    return rows.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")
