"""Statistics of whole texts, counted in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import text_batches

#: What counts as a symbol, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
WINDOW = 5
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct", "n_lines", "n_digits", "n_short_lines")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCT = b"!?.,;:\"'()[]{}-_/\\=+~^`@"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words that lie in a window of words found twice or more, the first one included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    found = Counter(grams)
    covered = until = 0
    for i, g in enumerate(grams):
        if found[g] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def text_stats(text: str | None) -> tuple[int, ...]:
    """FIELDS of a text; zeros for null. A line with up to two words is short."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = short = 0
    for line in raw.split(b"\n"):
        if stripped := line.strip():
            lines += 1
            short += stripped.count(b" ") < 2
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        count(SYMBOLS.encode()),
        dup,
        repeated_words(words),
        count(_UPPER),
        count(_PUNCT),
        lines,
        count(_DIGITS),
        short,
    )


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` (doc_id, lang, source or the like) and FIELDS (long) of every row's whole text."""
    text_batches(docs.sparkSession)
    columns = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t) for t in b.column(len(keep)).to_pylist()]
            stats = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *stats], names=[*keep, *FIELDS])

    return columns.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in FIELDS))


def features() -> dict[str, F.Column]:
    """Length-stabilised features: rates with 40 words' worth of typical text added, so that short texts stay near it."""
    c = {f: F.col(f).cast("double") for f in FIELDS}
    words, chars = c["n_words"] + 40, c["word_chars"] + 240
    return {
        "x_word": F.log(chars / words) * 4,
        "x_symbol": F.log1p(c["n_symbols"] / words * 20),
        "x_upper": F.log((c["n_upper"] + 6) / chars),
        "x_punct": F.log((c["n_punct"] + 6) / words),
        "x_lines": F.log((c["n_lines"] + 2.5) / words),
        "x_repeat": F.sqrt(c["n_repeat_words"] / words) * 4,
        "x_dup": F.sqrt(c["n_dup_lines"] / (c["n_lines"] + 3)) * 4,
        "x_digit": F.log1p(c["n_digits"] / words * 5),
    }
