"""Fill-in-middle transformation by an Aho-Corasick event scan (operator 11).

A text is cut at unit borders into prefix, middle and suffix, and put in another
order between sentinels. A unit is a run of characters that aren't blank with the
blanks before it; blanks at the end of the text are one unit.

One automaton holds the ASCII characters at which the class changes (the six
blanks) and the sentinels. A scan reports their places; all else is gaps. A blank
that doesn't follow another blank ends a unit (but for one at the start), so the
number of units is the number of gaps between blanks, by subtraction of
neighbouring places, and the end of the r-th unit is looked up by rank in the
sorted places of such blanks. No list of units is built and no character but the
events is looked at in Python. Rebuilding a text scans the output with the same
automaton and puts the parts between its sentinels back in order.

Cuts, form and order come from a hash of the document's id (``draws``), so they
don't depend on partitions, retries or other rows.

Defined results: null and empty texts have no units and are plain; a null id is
drawn for as if it were an empty string; a text that holds a sentinel stays plain,
since it couldn't be rebuilt; repeated rows give repeated rows; very long texts are
scanned whole, eight bytes an event; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rallyplan.llm.common import slices, texts

BLANKS = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of texts that are transformed, and of those the percent that put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: The order of the parts' sentinels in each form.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}


def event_automaton() -> ahocorasick.Automaton:
    """Blanks (value 0) and sentinels (their number from 1) in one automaton."""
    out = ahocorasick.Automaton()
    for c in BLANKS:
        out.add_word(c, 0)
    for i, mark in enumerate((PREFIX, SUFFIX, MIDDLE), 1):
        out.add_word(mark, i)
    out.make_automaton()
    return out


class Events(NamedTuple):
    """What a scan of a text finds: n_units; ends (places where a unit ends, but for the last one); marked (it holds a sentinel)."""

    n_units: int
    ends: np.ndarray
    marked: bool


def scan(text: str, automaton: ahocorasick.Automaton) -> Events:
    """Events of a whole text, places counted in code points."""
    found = np.fromiter((2 * end + (kind > 0) for end, kind in automaton.iter(text)), np.int64)
    marked = bool((found & 1).any())
    blanks = found[(found & 1) == 0] >> 1
    # a blank after something else ends a unit: one that is further than one place from the blank before it
    ends = blanks[np.diff(blanks, prepend=-1) > 1]
    # what follows the last of them is one more unit: characters, with or without blanks before them, or blanks alone;
    # if it has both and blanks at its end, that end has been found above
    return Events(len(ends) + bool(text), ends, marked)


def unit_end(events: Events, rank: int, length: int) -> int:
    """Place after the first ``rank`` units."""
    return 0 if not rank else int(events.ends[rank - 1]) if rank <= len(events.ends) else length


def draws(key: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers for a document's id."""
    digest = hashlib.sha256(f"{SEED}:{'' if key is None else key}".encode()).digest()
    h1, h2, h3, h4 = np.frombuffer(digest[:16], ">u4").tolist()
    return h1, h2, h3, h4


class Infilled(NamedTuple):
    n: int
    form: str
    prefix: str | None
    middle: str | None
    output: str


def transform(key: object, text: str, automaton: ahocorasick.Automaton) -> Infilled:
    """The text's units, form and parts and the transformed text."""
    events = scan(text, automaton)
    h1, h2, h3, h4 = draws(key)
    if not text or events.marked or h3 % 100 >= TRANSFORMED:
        return Infilled(events.n_units, PLAIN, None, None, text)
    low, high = sorted((h1 % (events.n_units + 1), h2 % (events.n_units + 1)))
    a, b = (unit_end(events, rank, len(text)) for rank in (low, high))
    parts = {PREFIX: text[:a], MIDDLE: text[a:b], SUFFIX: text[b:]}
    form = SPM if h4 % 100 < SUFFIX_FIRST else PSM
    return Infilled(events.n_units, form, parts[PREFIX], parts[MIDDLE], "".join(mark + parts[mark] for mark in ORDER[form]))


def restore(output: str, form: str, automaton: ahocorasick.Automaton) -> str:
    """The text that ``transform`` made the output from."""
    if form == PLAIN:
        return output
    starts = [end - len(PREFIX) + 1 for end, kind in automaton.iter(output) if kind]
    ends = [*starts[1:], len(output)]
    parts = {mark: output[a + len(mark) : b] for mark, a, b in zip(ORDER[form], starts, ends, strict=True)}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def _mapped(docs: DataFrame, key: str, text: str, schema: str, row: Callable[[object, str, ahocorasick.Automaton], tuple]) -> DataFrame:
    """key and row(key, text, automaton) for each row; schema names the columns after the key."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], full).schema)
    types, names = [f.type for f in arrow][1:], arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = event_automaton()
        for batch in slices(batches):
            made = [row(k, x, automaton) for k, x in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, full)


def infill(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: the transformed texts themselves, one map pass."""

    def row(k: object, raw: str, automaton: ahocorasick.Automaton) -> tuple:
        x = transform(k, raw, automaton)
        return x.n, x.form, None if x.prefix is None else len(x.prefix), None if x.middle is None else len(x.middle), x.output

    return _mapped(docs, key, text, "n long, form string, prefix_chars long, middle_chars long, output string", row)


def restored(infilled: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text of rows that ``infill`` made: rebuilt from form and output alone."""
    from pyspark.sql import functions as F

    both = infilled.select(F.struct("form", "output").alias("x"), f"`{key}`")
    kind = infilled.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = event_automaton()
        for batch in slices(batches):
            rebuilt = [restore(x["output"], x["form"], automaton) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rebuilt, pa.string())], [key, "text"])

    return both.mapInArrow(run, f"`{key}` {kind}, text string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (hashes of the output and of the text rebuilt from it)."""

    def row(k: object, raw: str, automaton: ahocorasick.Automaton) -> tuple:
        x = transform(k, raw, automaton)
        hashes = (hashlib.sha256(y.encode()).hexdigest() for y in (x.output, restore(x.output, x.form, automaton)))
        return x.n, x.form, None if x.prefix is None else len(x.prefix), None if x.middle is None else len(x.middle), *hashes

    return _mapped(docs, key, text, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", row)


def oracle() -> str:
    """The same rows in DuckDB's SQL: all units as a list, sliced."""
    draw = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
    held = " OR ".join(f"contains(t, '{mark}')" for mark in (PREFIX, SUFFIX, MIDDLE))
    joined = lambda low, high: f"coalesce(array_to_string(list_slice(units, {low}, {high}), ''), '')"
    return f"""
WITH raw AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units, {draw} FROM raw
), formed AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
        CASE WHEN t = '' OR {held} OR h3 % 100 >= {TRANSFORMED} THEN '{PLAIN}' WHEN h4 % 100 < {SUFFIX_FIRST} THEN '{SPM}' ELSE '{PSM}' END AS form
    FROM drawn
), cut AS (
    SELECT doc_id, t, n, form, {joined("1", "low")} AS prefix, {joined("low + 1", "high")} AS middle, {joined("high + 1", "n")} AS suffix FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> '{PLAIN}' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> '{PLAIN}' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN '{PLAIN}' THEN t WHEN '{PSM}' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cut"""
