"""Chat formatting by quotation linking.

Lines that begin with > quote; as many > as a line begins with is its level.  Neighbouring lines of one level are a
passage.  Its normalised digest is looked up among those of all messages of the conversation: their own text, its
paragraphs, lines and sentences.  The first message with that passage is its original; of a trimmed passage, paragraphs,
lines and sentences are looked up, and the message that was first with the most of it is the original.  The latest original that a message
quotes at level 1 is what it replies to.  Replies stand below their message, in the order of their turns.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, text_chunks, written

QUOTED = re.compile(r"^[ \t]?((?:>[ \t]?)+)(.*)$")
#: A line that names who is quoted goes with the quotation that it stands before.
NAMED = re.compile(r"^.{1,200}\b(?:wrote|writes|schrieb|écrit|escribió)\b[^:]{0,200}:\s*$", re.IGNORECASE)


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations, and (level, passage) of each quotation in order."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").split("\n"):
        found = QUOTED.match(line)
        now = found[1].count(">") if found else 0
        if now:
            if not level and body and NAMED.match(body[-1]):
                body.pop()
            if now != level:
                passages.append((now, []))
            passages[-1][1].append(found[2])
        else:
            body.append(line)
        level = now
    return "\n".join(body).strip("\n") if passages else text or "", [(n, "\n".join(lines)) for n, lines in passages]


def normal(passage: str) -> str:
    """Small letters, single blanks."""
    return " ".join(passage.lower().split())


def digests(passages) -> set[tuple[int, int]]:
    return {struct.unpack("<qq", xxhash.xxh3_128_digest(x)) for p in passages if (x := normal(p).encode("utf-8", "surrogatepass"))}


def own(body: str) -> list[str]:
    """What of a message can be quoted: its text, paragraphs and lines."""
    lines = body.split("\n")
    return [body, *re.split(r"\n[ \t]*\n", body), *lines]


#: The end of a sentence.
SENTENCE = re.compile(r"(?<=[.!?…])[\s]+|(?<=[。！？])")


def pieces(text: str) -> list[str]:
    """What a trimmed quotation can share with its original: paragraphs, lines and sentences, of lines and over them."""
    lines = text.split("\n")
    paragraphs = re.split(r"\n[ \t]*\n", text)
    return [*paragraphs, *lines, *(x for y in (*lines, *paragraphs) for x in SENTENCE.split(y))]


def asked_for(passages: list[tuple[int, str]]) -> list[dict]:
    """Lookups of each passage: itself, which outweighs all others, and its pieces by their length."""
    out = []
    for at, (level, passage) in enumerate(passages):
        for weight, some in ((1 << 40, [passage]), (0, sorted(set(pieces(passage))))):
            seen: dict[tuple[int, int], int] = {}
            for x in some:
                for d in digests([x]):
                    seen[d] = max(seen.get(d, 0), weight + len(normal(x)))
            out += [{"at": at, "level": level, "d1": a, "d2": b, "weight": n} for (a, b), n in seen.items()]
    return out


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, reply_to, depth, path, n_quotes, n_linked, body, rendered), one for each message.

    reply_to is the turn of the message replied to, depth the number of messages above, path their turns and the own one
    (sorting by conv_id and path gives the reply order), n_linked the quotations whose original was found, rendered
    the chat turn.  A message only replies to an earlier turn.  A null conversation, turn or text links nothing and keeps
    its row, a repeated row is answered each time, equal turns are told apart by their text; other columns are not read.
    One lookup row is made for each passage of a conversation, however often it was said or quoted.
    """

    def parse(batches):
        for batch in batches:
            for start, end in text_chunks(batch, 3):
                part = batch.slice(start, end - start)
                bodies, said, quoted, counts = [], [], [], []
                for text in part.column(3).to_pylist():
                    body, passages = parsed(text)
                    bodies.append(body)
                    said.append([{"d1": a, "d2": b} for a, b in sorted(digests([*own(body), *pieces(body)]))])
                    quoted.append(asked_for(passages))
                    counts.append(len(passages))
                one = [("d1", pa.int64()), ("d2", pa.int64())]
                kinds = pa.list_(pa.struct(one)), pa.list_(pa.struct([("at", pa.int32()), ("level", pa.int32()), *one, ("weight", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(bodies, pa.string()), pa.array(said, kinds[0]), pa.array(quoted, kinds[1]), pa.array(counts, pa.int64())], ["conv_id", "turn", "role", "body", "said", "quoted", "n_quotes"])

    few = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    conv = few.schema["conv_id"].dataType.simpleString()
    found = few.mapInArrow(parse, f"conv_id {conv}, turn long, role string, body string, said array<struct<d1: long, d2: long>>, quoted array<struct<at: int, level: int, d1: long, d2: long, weight: long>>, n_quotes long")
    rows = written(found.select(F.monotonically_increasing_id().alias("uid"), "*"), "messages")
    asked = rows.where("size(quoted) > 0").select("conv_id", "turn", "uid", F.explode("quoted").alias("q")).select("conv_id", "turn", "uid", "q.*")
    asked = written(asked, "quoted")
    wanted = written(asked.select("conv_id", "d1", "d2").distinct(), "wanted")
    spoken = rows.where("turn IS NOT NULL").select("conv_id", "turn", "uid", F.explode("said").alias("s")).select("conv_id", "turn", "uid", "s.*")
    first = spoken.join(wanted, ["conv_id", "d1", "d2"]).groupBy("conv_id", "d1", "d2").agg(F.min(F.struct("turn", "uid")).alias("o"))
    first = written(first, "originals")
    hits = asked.join(first, ["conv_id", "d1", "d2"]).where("o.turn < turn")
    match = hits.groupBy("uid", "turn", "at", "level", "o").agg(F.sum("weight").alias("weight"))
    hits = match.groupBy("uid", "turn", "at", "level").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "o")).alias("m")).select("uid", "turn", "at", "level", "m.o")
    replies = hits.groupBy("uid", "turn").agg(F.max(F.when(F.col("level") == 1, F.struct("o.turn", "o.uid"))).alias("o"), F.countDistinct("at").alias("n_linked"))
    replies = written(replies.select("uid", "turn", F.col("o.turn").alias("reply_to"), F.col("o.uid").alias("above"), "n_linked"), "replies")
    paths = above(replies.where("above IS NOT NULL").select("uid", "above", F.array("reply_to").alias("path")))
    named = rows.join(replies.select("uid", "reply_to", "n_linked"), "uid", "left").join(paths, "uid", "left")
    path = F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array("turn"))
    release(wanted, asked)
    return named.select(
        "conv_id", "turn", "role", "reply_to", (F.size(path) - 1).cast("long").alias("depth"), path.alias("path"), "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n")).alias("rendered"),
    )


def quoting(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Messages as a mail client writes them, with all their columns: by a hash of conversation and turn a message quotes the
    turn before whole, its first line, that and the turn before it one level deeper, or nothing.

    Of repeated turns the least text is quoted; a null conversation, turn or text quotes nothing and isn't quoted.
    """
    conv, turn, text = F.col(conv_col), F.col(turn_col).cast("long"), F.col(text_col).cast("string")
    said = messages.groupBy(conv.alias("_conv"), turn.alias("_turn")).agg(F.min(text).alias("_said")).where("_conv IS NOT NULL AND _turn IS NOT NULL")
    out = messages
    for back in (1, 2):
        before = said.select(F.col("_conv").alias(f"_conv{back}"), (F.col("_turn") + back).alias(f"_turn{back}"), F.col("_said").alias(f"_said{back}"))
        out = out.join(before, (conv == F.col(f"_conv{back}")) & (turn == F.col(f"_turn{back}")), "left")
    first = F.substring_index(F.col("_said1"), "\n", 1)
    mark = lambda x, sign: F.regexp_replace(x, "(?m)^", sign)
    wrote = F.lit("Somebody wrote:\n")
    deeper = F.concat(mark(F.substring_index(F.col("_said2"), "\n", 1), ">> "), F.lit("\n"))
    kind = F.pmod(F.xxhash64(conv, turn), F.lit(4))
    quote = F.when(kind == 0, mark(F.col("_said1"), "> ")).when(kind == 1, mark(first, "> ")).when(kind == 2, F.concat(F.coalesce(deeper, F.lit("")), mark(F.col("_said1"), "> ")))
    whole = F.concat(wrote, quote, F.lit("\n\n"), text)
    return out.withColumn("_text", F.coalesce(whole, text)).select(*[F.col("_text").alias(text_col) if c == text_col else F.col(c) for c in messages.columns])


def above(links: DataFrame) -> DataFrame:
    """(uid, path): the turns above each reply, from the first on.  Each round doubles the way that is known."""
    known = written(links, "paths")
    while True:
        up = known.select(F.col("uid").alias("above"), F.col("above").alias("next"), F.col("path").alias("before"))
        longer = known.join(up, "above", "left").select("uid", F.col("next").alias("above"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"))
        after = written(longer, "paths")
        release(known)
        known = after
        if not known.where("above IS NOT NULL").limit(1).count():
            return known.select("uid", "path")
