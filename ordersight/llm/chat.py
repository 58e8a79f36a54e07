"""Conversations as training texts through a template that is only known as a function from turns to a text.

Where a turn lies in the output is found from outside: the first turns are rendered one by one more, and what the next
output adds to the last is the span of its turn. If it does not begin with the last output, the template rewrites
history, and no span is trusted. Where the text lies inside its span is found by rendering the turn once more with a
probe in its place.

Rendering all beginnings of a conversation grows with the square of its turns, so it is cut into segments of SEGMENT
turns, each rendered after the `reach` turns in front of it. Whether a template looks back no further is checked at
every cut, where two segments render the same turn. No task ever holds more than a segment of a conversation.

Odd rows: null text and null role are empty. Turns of a conversation are ordered by turn (null first), then role, then
text, so repeated rows stay, next to each other. A null conv_id is a conversation of its own. Columns of other names
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import BROADCAST_BYTES, durable

SEGMENT = 16
#: Turn numbers that are counted together before rows are numbered.
STRETCH = 1024
Turn = tuple[str, str]

SPAN = "struct<role string, start int, end int, text_start int, text_end int>"
FORMATTED = f"conv_id long, segment long, text string, spans array<{SPAN}>, rewritten_at long"


class TaggedTemplate:
    """Every turn between control strings of its role; a control string inside a text loses its look by a backslash."""

    controls = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]")
    marks = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
    #: Turns in front of a turn that its rendering may depend on.
    reach = 1

    def __init__(self) -> None:
        self._control = "|".join(map(re.escape, self.controls))
        one = [f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in self.marks.items()]
        self._turn = "|".join([*one, r"\[ROLE\] (?P<role>.*?) \[/ROLE\]\[TEXT\] (?P<text>.*?) \[/TEXT\]"])

    def escaped(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        if "<" in text or "[" in text:
            text = re.sub(self._control, lambda m: f"{m[0][0]}\\{m[0][1:]}", text)
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def render(self, turns: Sequence[Turn]) -> str:
        out = []
        for role, text in turns:
            head, foot = self.marks.get(role) or (f"[ROLE] {self.escaped(role)} [/ROLE][TEXT] ", " [/TEXT]")
            out += [head, self.escaped(text), foot]
        return "".join(out)

    def parsed(self, text: str) -> list[Turn]:
        """The turns of a rendered text; what is no turn is an error."""
        out, at = [], 0
        for m in re.finditer(self._turn, text, re.S):
            if m.start() != at:
                break
            at, found = m.end(), m.groupdict()
            if found["role"] is not None:
                out.append((self.unescaped(found["role"]), self.unescaped(found["text"])))
            else:
                out += [(role, self.unescaped(found[role])) for role in self.marks if found[role] is not None]
        if at != len(text):
            raise ValueError(f"no turn at {at}: {text[at:at + 40]!r}")
        return out


def _probe(text: str) -> str:
    """A character of the private areas that the text does not hold."""
    return next(c for c in map(chr, range(0xE000, 0x10FFFE)) if c not in text)


def located(render, turns: Sequence[Turn], known: int = 0) -> tuple[str, list[tuple], int | None]:
    """What the turns from `known` on add to the output, the span of each in it, and the first turn that rewrites.

    A span is (role, start, end, start of the text, end of the text). With a rewrite the whole output and no spans are
    returned.
    """
    before = render(turns[:known]) if known else ""
    start, spans = len(before), []
    for k in range(known, len(turns)):
        role, text = turns[k]
        now = render(turns[:k + 1])
        if not now.startswith(before):
            return render(turns), [], k
        mark = _probe(now)
        probed = render([*turns[:k], (role, mark)])
        # The output with the probe differs by the text alone: what follows the probe must also end the real output.
        text_start = probed.find(mark)
        text_end = len(now) - (len(probed) - text_start - 1)
        if text_start < len(before) or text_end < text_start or now[:text_start] != probed[:text_start] or \
                now[text_end:] != probed[text_start + 1:]:
            return render(turns), [], k
        spans.append((role, len(before) - start, len(now) - start, text_start - start, text_end - start))
        before = now
    return before[start:], spans, None


def numbered(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, role, text, place): turns numbered from 0, without bringing a long conversation to one task.

    Rows are counted per stretch of turn numbers first; only stretches of one conversation are added up in a window.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(1 << 62))))
    per_stretch = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv_id").orderBy("stretch")
    later = per_stretch.withColumn("before", F.sum("n").over(own) - F.col("n")).where("before > 0")
    # Only conversations of more than one stretch have rows here; all columns are longs.
    later = durable(later.select(F.col("conv_id").alias("_c"), F.col("stretch").alias("_s"), "before"))
    later = F.broadcast(later) if later.count() * 48 <= BROADCAST_BYTES else later
    rows = rows.join(later, F.expr("conv_id <=> _c AND stretch = _s"), "left")
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text",
                       (F.coalesce("before", F.lit(0)) + F.row_number().over(within) - 1).alias("place"))


def formatted(conversations: DataFrame, template=None, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, text, spans, rewritten_at): one row per segment; a conversation's text is its segments in turn.

    `spans` are the turns of the segment with the places of turn and text in `text`. Where the template changes earlier
    output, `rewritten_at` is the first turn that does so, `spans` is empty and `text` the rendering of the segment.
    """
    template = template or TaggedTemplate()
    reach = template.reach
    if not 0 <= reach < segment:
        raise ValueError("a template must look back by less than a segment")
    # The last turns of a segment also go to the next one: as its context, and one more to check the reach.
    ahead = F.col("place") % segment >= segment - reach - 1
    own = F.floor(F.col("place") / segment)
    rows = numbered(conversations).select(
        "conv_id", "role", "text", "place", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))).alias("segment"))
    # In the order of segments, so that a task reads one after the other and keeps only the one it is at.
    rows = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")

    def one(key, part: list) -> tuple | None:
        conv_id, number = key
        known = sum(place < number * segment for _, _, place in part)
        if known == len(part):
            return None  # the conversation ended with the segment before
        turns = [(role, text) for role, text, _ in part]
        if not known:
            text, spans, at = located(template.render, turns)
        else:
            # One turn more than the reach: does it render the same with and without the turn before it?
            text, spans, at = located(template.render, turns, known)
            short = located(template.render, turns[1:], known - 1)
            if at is None and short[:2] != (text, spans):
                raise ValueError(f"the template looks back by more than {reach} turns (conversation {conv_id})")
        return conv_id, number, text, spans, None if at is None else int(number * segment + at - known)

    def run(batches):
        key, part = None, []
        done: list = []
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)).to_pylist()
                       for c in ("conv_id", "segment", "role", "text", "place")]
            for conv_id, number, role, text, place in zip(*columns, strict=True):
                if key != (conv_id, number):
                    if part:
                        done.append(one(key, part))
                    key, part = (conv_id, number), []
                part.append((role, text, place))
            yield _record(done)
            done = []
        if part:
            yield _record([one(key, part)])

    return rows.mapInArrow(run, FORMATTED)


def _record(rows: list) -> pa.RecordBatch:
    rows = [r for r in rows if r is not None]
    span = pa.struct([("role", pa.string()), *[(c, pa.int32()) for c in ("start", "end", "text_start", "text_end")]])
    names = ["role", "start", "end", "text_start", "text_end"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.int64()]
    columns = [[r[i] if i != 3 else [dict(zip(names, s)) for s in r[3]] for r in rows] for i in range(5)]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                           ["conv_id", "segment", "text", "spans", "rewritten_at"])


def read_back(segments: DataFrame, template=None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted texts alone.

    Turns are parsed from the text; the loss mask is the text of the assistant's spans. The digests of a conversation run
    on from segment to segment, so a task keeps one segment and two digest states.
    """
    template = template or TaggedTemplate()
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None  # conv_id, turns, digest of the turns, loss characters, digest of the loss, characters
        done: list = []

        def close():
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def record():
            return pa.record_batch([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("conv_id", "text", "spans")]
            for conv_id, text, spans in zip(*columns, strict=True):
                if state is None or state[0] != conv_id:
                    close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in template.parsed(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["role"] == "assistant":
                        own = template.unescaped(text[s["text_start"]:s["text_end"]])
                        state[3] += len(own)
                        state[4].update(own.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield record()
            done.clear()
        close()
        yield record()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long")
