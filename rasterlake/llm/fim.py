"""Operator 12: fill-in-the-middle by a parallel automaton scan.

Two automata read the bytes of a text: one completes a unit at the last byte of each code point, one looks for the
three sentinels and stays where it found one. A stretch of bytes is read from every state at once, so it needs no
knowledge of what stands before it: it gives a transition function (start state -> end state) and, for each start
state, the units completed. Composing functions is associative. So stretches of LANE bytes are read side by side,
composed by doubling into the function of a chunk, and chunks into that of a document: this gives every stretch's
entry state and the units before it, the document's units and whether it holds a sentinel. A cut after r units lies in
the one stretch whose units reach r, which is read again from its entry state.

Documents up to GIANT bytes are scanned where they stand. Longer ones are cut into chunks of CHUNK bytes that are dealt
to tasks; only functions of chunks come together, and only the chunks that hold a cut are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work

#: The fixed sentinels: before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
LANE = 256
CHUNK = 1 << 14
GIANT = 1 << 16
PLAIN_PERCENT = 10  # of documents that stay as they are
SPM_PERCENT = 20  # of the others that have the suffix first


class Automaton(NamedTuple):
    """step[state, byte] is the next state, emits[state, byte] whether a unit is complete with this byte. Byte 256
    stands for no byte. State 0 is the first one."""

    step: np.ndarray
    emits: np.ndarray


def _automaton(step: np.ndarray, emits: np.ndarray) -> Automaton:
    none = np.arange(len(step), dtype=np.intp)[:, None]
    return Automaton(np.hstack([step, none]), np.hstack([emits, np.zeros((len(emits), 1), np.int32)]))


def code_points() -> Automaton:
    """A unit is a code point of UTF-8; the state is the number of bytes that are missing."""
    step, emits = np.zeros((4, 256), np.intp), np.zeros((4, 256), np.int32)
    follows = np.arange(256) & 0xC0 == 0x80
    missing = np.select([np.arange(256) >= 0xF0, np.arange(256) >= 0xE0, np.arange(256) >= 0xC0], [3, 2, 1], 0)
    step[:, ~follows] = missing[~follows]
    emits[:, ~follows] = missing[~follows] == 0
    for state in (1, 2, 3):
        step[state, follows] = state - 1
        emits[state, follows] = state == 1
    return _automaton(step, emits)


def finder(marks: tuple[str, ...]) -> Automaton:
    """Its last state is reached, and kept, with the end of the first mark. The others are the marks' beginnings."""
    begun = sorted({m.encode()[:k] for m in marks for k in range(len(m.encode()))}, key=len)
    whole = {m.encode() for m in marks}
    step = np.full((len(begun) + 1, 256), len(begun), np.intp)
    for i, x in enumerate(begun):
        for byte in range(256):
            seen = x + bytes([byte])
            if not any(seen.endswith(m) for m in whole):
                step[i, byte] = max(k for k, y in enumerate(begun) if seen.endswith(y))
    return _automaton(step, np.zeros(step.shape, np.int32))


UNITS = code_points()
SENTINELS = finder(MARKS)


def lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts data[start : start + size] as columns of LANE bytes (256 behind a text's end); each column's text and
    the offset of its first byte in it. An empty text has one column."""
    counts = np.maximum(-(-size // LANE), 1)
    text = np.repeat(np.arange(len(size)), counts)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * LANE
    return _columns(data, start[text] + offset, np.minimum(size[text] - offset, LANE)), text, offset


def _columns(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    padded = np.append(data, np.zeros(LANE, np.uint8))
    block = padded[at[None, :] + np.arange(LANE)[:, None]].astype(np.intp)
    block[np.arange(LANE)[:, None] >= size[None, :]] = 256
    return block


def functions(machine: Automaton, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each column's end state and completed units, from every start state."""
    n = len(machine.step)
    state = np.tile(np.arange(n), (block.shape[1], 1))
    units = np.zeros(state.shape, np.int64)
    step, emits = (machine.step * 257).ravel(), machine.emits.ravel()
    state *= 257
    counting = emits.any()
    for row in block:
        at = state + row[:, None]
        if counting:
            units += emits[at]
        state = step[at]
    return state // 257, units


def composed(end: np.ndarray, units: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions of everything from a text's first stretch to each of its stretches, by doubling. Stretches of a text
    stand side by side, in order."""
    end, units = end.copy(), units.copy()
    reach = 1
    while reach < len(text):
        later = np.flatnonzero(text[reach:] == text[:-reach]) + reach
        if not len(later):
            break
        before, more = end[later - reach], units[later - reach]
        end[later], units[later] = np.take_along_axis(end[later], before, 1), more + np.take_along_axis(units[later], before, 1)
        reach *= 2
    return end, units


def located(machine: Automaton, block: np.ndarray, state: np.ndarray, need: np.ndarray) -> np.ndarray:
    """How many bytes of each column complete its `need` units (1 or more), from its entry state."""
    state, seen, out = state * 257, np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    step, emits = (machine.step * 257).ravel(), machine.emits.ravel()
    for k, row in enumerate(block):
        at = state + row
        seen += emits[at]
        state = step[at]
        out[(seen == need) & (out == 0)] = k + 1
    return out


class Scan:
    """Texts read by the two automata, from their first states: units and whether a sentinel is in them, by text."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        self.block, self.text, self.offset = lanes(data, start, size)
        self.own = functions(UNITS, self.block)
        self.marked = functions(SENTINELS, self.block)
        self.end, self.units = composed(*self.own, self.text)
        self.last = np.searchsorted(self.text, np.arange(len(size)), "right") - 1
        self.n = self.units[self.last, 0]
        self.found = composed(*self.marked, self.text)[0][self.last, 0] == len(SENTINELS.step) - 1

    def cut(self, target: np.ndarray) -> np.ndarray:
        """The byte of each text behind its first target units."""
        out = np.zeros(len(target), np.int64)
        asked = np.flatnonzero(target > 0)
        key = self.text * (np.int64(1) << 40) + self.units[:, 0]
        lane = np.searchsorted(key, asked * (np.int64(1) << 40) + target[asked])
        first = (self.offset[lane] == 0) | (lane == 0)
        entry, before = np.where(first, 0, self.end[lane - 1, 0]), np.where(first, 0, self.units[lane - 1, 0])
        out[asked] = self.offset[lane] + located(UNITS, self.block[:, lane], entry, target[asked] - before)
        return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and each value's start and size."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _small(docs: DataFrame) -> DataFrame:
    """Adds n, found, from_byte and to_byte to documents, scanned where they stand."""
    schema = "doc_id long, text string, h1 long, h2 long, h3 long, h4 long, n long, found boolean, from_byte long, to_byte long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in work.slices(batch, "text"):
                scan = Scan(*_bytes(part.column("text")))
                cuts = np.sort(np.stack([part.column(h).to_numpy() % (scan.n + 1) for h in ("h1", "h2")]), axis=0)
                more = [scan.n, scan.found, scan.cut(cuts[0]), scan.cut(cuts[1])]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, more)], names=[*part.schema.names, "n", "found", "from_byte", "to_byte"])

    return docs.mapInArrow(run, schema)


def _giant(docs: DataFrame, chunk: int) -> DataFrame:
    """The same for documents whose chunks are dealt to tasks."""
    docs = work.saved(docs.withColumn("row", F.monotonically_increasing_id()), "giant")

    pieces = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for row, text in zip(batch.column("row").to_pylist(), texts, strict=True):
                whole = memoryview(text.as_buffer())
                for a in range(0, len(whole), chunk):
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": a // chunk, "bytes": whole[a : a + chunk].tobytes()}], schema=pieces)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in work.slices(batch, "bytes"):
                scan = Scan(*_bytes(part.column("bytes")))
                out = {"row": part.column("row"), "k": part.column("k")}
                out |= {"end": pa.array(scan.end[scan.last].tolist()), "units": pa.array(scan.units[scan.last].tolist()), "marked": pa.array(composed(*scan.marked, scan.text)[0][scan.last].tolist())}
                yield pa.RecordBatch.from_pydict(out)

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        same = np.zeros(len(table), np.int64)
        end, units, marked = (np.array(table.column(c).to_pylist(), np.int64) for c in ("end", "units", "marked"))
        end, units = composed(end, units, same)
        marked, _ = composed(marked, np.zeros(marked.shape, np.int64), same)
        n = len(table)
        return pa.table({
            "row": table.column("row"), "k": table.column("k"), "entry": np.append(0, end[:-1, 0]), "before": np.append(0, units[:-1, 0]), "upto": units[:, 0],
            "n": np.full(n, units[-1, 0]), "found": np.full(n, marked[-1, 0] == len(SENTINELS.step) - 1),
        })

    chunks = work.saved(docs.select("row", "text").mapInArrow(cut, "row long, k int, bytes binary").repartition("row", "k"), "bytes")
    read_once = chunks.mapInArrow(read, "row long, k int, end array<long>, units array<long>, marked array<long>")
    state = work.saved(read_once.groupBy("row").applyInArrow(compose, "row long, k int, entry long, before long, upto long, n long, found boolean"), "states")
    targets = state.join(docs.select("row", "h1", "h2"), "row")
    both = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    asked = targets.select("row", "k", "entry", "before", "upto", "n", "found", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.least(*both).alias("target")), F.struct(F.lit(1).alias("side"), F.greatest(*both).alias("target")))).alias("x"))
    asked = asked.select("*", "x.side", "x.target").drop("x").filter("target > before and target <= upto")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in work.slices(batch, "bytes"):
                scan = Scan(*_bytes(part.column("bytes")))
                at = [_from(scan, i, e, x) for i, (e, x) in enumerate(zip(part.column("entry").to_pylist(), part.column("need").to_pylist(), strict=True))]
                place = part.column("k").to_numpy().astype(np.int64) * chunk + np.array(at, np.int64)
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "side": part.column("side"), "byte": place})

    found = asked.join(chunks, ["row", "k"]).select("row", "k", "side", "entry", (F.col("target") - F.col("before")).alias("need"), "bytes").mapInArrow(find, "row long, side int, byte long")
    places = found.groupBy("row").agg(F.max(F.when(F.col("side") == 0, F.col("byte"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("byte"))).alias("b"))
    whole = docs.join(state.filter("k = 0").select("row", "n", "found"), "row").join(places, "row", "left")
    return whole.select("doc_id", "text", "h1", "h2", "h3", "h4", "n", "found", F.coalesce("a", F.lit(0)).cast("long").alias("from_byte"), F.coalesce("b", F.lit(0)).cast("long").alias("to_byte"))


def _from(scan: Scan, i: int, entry: int, need: int) -> int:
    """The byte of the scan's text i behind `need` units, where it is entered in state `entry`."""
    low, high = np.searchsorted(scan.text, [i, i + 1])
    lane = low + int(np.searchsorted(scan.units[low:high, entry], need))
    state, before = (entry, 0) if lane == low else (scan.end[lane - 1, entry], scan.units[lane - 1, entry])
    return int(scan.offset[lane] + located(UNITS, scan.block[:, [lane]], np.array([state]), np.array([need - before]))[0])


def fill_in_middle(docs: DataFrame, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, n (code points), form, prefix_chars, middle_chars and output of each row.

    The cuts, and whether and how a text is turned round, follow from the sha256 of `1:` and the id (of `1:` alone for a
    null id). Null texts are empty ones. Empty texts and those that hold a sentinel are plain. Repeated rows stay."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(1, 5)]
    docs = work.pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *draws)
    scanned = _small(docs.filter(F.octet_length("text") <= giant)).union(_giant(docs.filter(F.octet_length("text") > giant), chunk))
    plain = (F.col("n") == 0) | F.col("found") | (F.col("h3") % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_PERCENT, "spm").otherwise("psm")
    both = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    raw = F.col("text").cast("binary")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("from_byte")), part(F.col("from_byte"), F.col("to_byte")), part(F.col("to_byte"), F.octet_length("text"))
    p, s, m = (F.lit(x).cast("binary") for x in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(raw)
    cuts = [F.when(F.col("form") != "plain", c) for c in (F.least(*both), F.greatest(*both) - F.least(*both))]
    return scanned.withColumn("form", form).select("doc_id", "text", "n", "form", cuts[0].alias("prefix_chars"), cuts[1].alias("middle_chars"), output.cast("string").alias("output"))


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made of. A sentinel can't begin inside another or before its place, as its first
    character occurs in it once and the text holds no sentinel."""
    head, middle = F.substring_index(output, MARKS[2], 1), F.substring_index(output, MARKS[2], -1)
    second = F.when(F.col(form) == "psm", F.lit(MARKS[1])).otherwise(F.lit(MARKS[0]))
    at = F.instr(head, second)
    size = len(MARKS[0])
    one, two = F.substring(head, F.lit(size + 1), at - size - 1), F.substring(head, at + size, F.length(head))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_automaton_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts, and the digests of its output and of the text restored from it."""
    made = fill_in_middle(work.read(spark, sf_dir, "documents")).withColumn("restored", restored())
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""
