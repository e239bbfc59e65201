"""Chat formatting from event logs: events are dealt out by conversation, sorted by sequence and folded into final messages, which a template renders.

A log holds rows (conv_id, turn, message, seq, kind, role, text, at, size): `turn` is the message's place in its conversation, `message` its id, `seq`
the order of its events. Kinds: 'open' (a message of that role begins), 'delta' (text that streams in, put at the end), 'edit' (`size` code points from `at`
on are replaced by the text), 'regenerate' (what the message holds is thrown away; what follows builds it anew), 'delete' (the message is
gone, unless it is opened again).

The template writes a turn as `### `, the role, a line feed, the text, `</turn>` and a line feed. In texts and roles a backslash goes before every
backslash, before the second of two `#` and before the slash of `</turn>`; line feeds in roles become `\\n`. So no text can hold a mark, and taking
the backslashes out gives it back. The loss mask covers the texts of assistants.

Conversations are dealt out by ranges of (conversation, turn, message), so a long one is split and a message stays whole; one message is folded at a time and
written in pieces of about `PIECE` characters. A conversation that lies within a range and a piece is read back where it is stored; the pieces of others
meet in order, and only the state of the hashes is held.

Defined cases: a null text or role is empty, a null turn comes first; messages of one turn come by id; of events with the same number the first by kind and text
counts, so a log delivered twice gives the same; an edit past the end appends, one without `at` does so too, one without `size`
replaces nothing; another kind is an error; rows without conv_id are one conversation without one; an empty log gives no conversations; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import partitions, written

#: Characters of formatted text in a row of the output, and of text in an event that streams in.
PIECE, DELTA = 1 << 20, 4000
MARK, END = "### ", "</turn>\n"
LOG = "conv_id long, turn long, message string, seq long, kind string, role string, text string, at long, size long"
FORMATTED = "conv_id long, part int, piece int, whole boolean, formatted string, mask array<struct<start:int,end:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """The text without marks of the template."""
    if "\\" in text or "##" in text or "</turn>" in text:
        return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def folded(events: Iterable[tuple]) -> tuple[str, str] | None:
    """One message's events (seq, kind, role, text, at, size) in order -> (role, text), or None if it is gone."""
    role, held, there, last = "", [], False, None
    for seq, kind, role_, text, at, size in events:
        if last is not None and seq == last:
            continue
        last, there = seq, there or kind != "delete"
        if kind == "delta":
            held.append(text or "")
        elif kind == "open":
            role, held = role_ or "", []
        elif kind == "regenerate":
            held = []
        elif kind == "edit":
            whole = "".join(held)
            at = len(whole) if at is None else max(0, at)
            held = [whole[:at], text or "", whole[at + max(0, size or 0) :]]
        elif kind == "delete":
            there, held = False, []
        else:
            raise ValueError(f"{kind} is no kind of event")
    return (role, "".join(held)) if there else None


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) pairs that a formatted text holds."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(MARK, at):
            raise ValueError("no turn begins here")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescaped_role(formatted[at + len(MARK) : line]), unescaped(formatted[line + 1 : end])
        at = end + len(END)


def _rows(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    return itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in range(columns)), strict=True) for b in batches)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by conversation, turn, message and seq -> rows of FORMATTED."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def pieces() -> Iterator[tuple]:
        first = True
        waiting = None  # the last row: whether it ends within the range is known once another conversation follows
        for conv, events in itertools.groupby(_rows(batches, 9), key=lambda r: r[0]):
            if waiting is not None:
                yield waiting
                first = False
            texts, mask, n, piece = [], [], 0, 0
            for _, one in itertools.groupby(events, key=lambda r: (r[1], r[2])):
                message = folded(e[3:] for e in one)
                if message is None:
                    continue
                role, text = message
                head, body = f"{MARK}{escaped_role(role)}\n", escaped(text)
                if role == "assistant":
                    mask.append({"start": n + len(head), "end": n + len(head) + len(body)})
                texts.append(f"{head}{body}{END}")
                n += len(texts[-1])
                if n >= PIECE:
                    yield conv, part, piece, False, "".join(texts), mask
                    texts, mask, n, piece = [], [], 0, piece + 1
            waiting = (conv, part, piece, not first and not piece, "".join(texts), mask)
        if waiting is not None:
            yield *waiting[:3], False, *waiting[4:]

    held, size = [], 0
    for row in pieces():
        held.append(row)
        size += len(row[4])
        if size >= 4 * PIECE or len(held) >= 5000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def formatted(log: DataFrame) -> DataFrame:
    """A log -> (conv_id, part, piece, whole, formatted, mask): conversations as the template renders them, in pieces in order of (part, piece).

    mask: the spans of the piece that a loss is taken over, in code points. whole: this row is all of its conversation.
    """
    kinds = {c.split()[0]: c.split()[1] for c in LOG.split(", ")}
    order = ["conv_id", "turn", "message"]
    rows = log.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    dealt = rows.repartitionByRange(partitions(log.sparkSession), *order).sortWithinPartitions(*order, "seq", "kind", "text")
    return dealt.mapInArrow(_rendered, FORMATTED)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, formatted, mask), a conversation's side by side and in order -> DIGESTS."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows() -> Iterator[tuple]:
        for conv, pieces in itertools.groupby(_rows(batches, 3), key=lambda r: r[0]):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, mask in pieces:
                size += len(text)
                for role, said in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    under = unescaped(text[span["start"] : span["end"]])
                    chars += len(under)
                    loss.update(under.encode("utf-8", "surrogatepass"))
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for some in itertools.batched(rows(), 2000):
        yield _batch(list(some), schema)


def digests(pieces: DataFrame) -> DataFrame:
    """What formatted() gave, stored and read back -> DIGESTS: hashes and lengths of the turns, and of the text under the loss mask, of each conversation."""
    columns = ["conv_id", "formatted", "mask"]
    split = pieces.where("not whole").repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return pieces.where("whole").select(*columns).mapInArrow(_digested, DIGESTS).unionByName(split.select(*columns).mapInArrow(_digested, DIGESTS))


# --- a log for conversations that have none -------------------------------------------------------------------------------------------------


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, hash, row) -> the events of a service in which they might have come about."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in LOG.split(", ")])

    def events() -> Iterator[tuple]:
        for conv, turn, role, text, h, row in _rows(batches, 6):
            message = f"{role}\0{h + 2**63:016x}\0{row:x}"
            seqs = itertools.count()
            say = lambda kind, t=None, at=None, size=None: (conv, turn, message, next(seqs), kind, None, t, at, size)  # noqa: B023, E731
            yield conv, turn, message, next(seqs), "open", role, None, None, None
            if h % 4 == 0 and text:  # a draft that is given up
                yield say("delta", text[: len(text) // 8][::-1])
                yield say("regenerate")
            wrong = len(text) // 2 if h % 4 == 1 else None  # a slip in the middle, set right at the end
            for at in range(0, len(text), DELTA):
                some = text[at : at + DELTA]
                if wrong is not None and at <= wrong < at + DELTA:
                    some = f"{some[: wrong - at]}(sic){some[wrong - at + 1 :]}"
                yield say("delta", some)
            if wrong is not None and text:
                yield say("edit", text[wrong], wrong, len("(sic)"))

    for some in itertools.batched(events(), 1000):
        yield _batch(list(some), schema)


def streamed(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a log that leads to them: texts stream in, a quarter after a draft that is given up, a quarter with a slip
    that an edit sets right. Rows of one turn come by role, then by XXH64 of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")), text, F.xxhash64(text), F.monotonically_increasing_id())  # the last tells equal rows apart; a scan gives the same each time
    return rows.mapInArrow(_streamed, LOG)


#: A conversation that is formatted along with the given ones: its texts hold marks of templates.
PROBE = (-7, "\\### Assistant: </turn> ok")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and PROBE, by way of a log, read back from the formatted output."""
    last = F.lit(2**63 - 2)  # after other turns of that conversation, if there are any
    probe = conversations.sparkSession.range(2).select(F.lit(PROBE[0]).cast("long").alias("conv_id"), (last + F.col("id")).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE[1]).alias("text"))
    own = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    return digests(written(formatted(streamed(own.unionByName(probe))), "formatted_chats"))
